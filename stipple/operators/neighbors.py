"""Exact nearest neighbours, neighbour graphs and pairwise-distance sums.

Points are cut into blocks of bounded size and blocks meet blocks; a task holds
two blocks, multiplies tiles of them with BLAS and returns only the best k per
point or per-label sums, so pairs of points are never rows of a table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions.columns import vec_distance
from stipple.operators.vectors import batches, matrix, sql_type
from stipple.session import Scratch, cut

#: least points per block; a task holds two blocks
BLOCK = 4096
#: rows of a distance block worked on at once
STRIP = 512
#: blocks that a point may be sent to before blocks grow beyond the least, and doubles that a block may hold
SENT, BLOCK_MOST = 8, 2_000_000
#: partitions that blocks are dealt into, for a slot: their work is not told by their bytes
DEALT = 8
#: candidates within reach, in multiples of k, that need no further cut; candidates whose distances are recomputed at once
FEW, HITS = 4, 65_536


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = _products(x, y)
    return np.maximum(d, 0.0, out=d)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances with their rounding, below 0 at times."""
    d = x @ y.T
    d *= 2.0
    return np.subtract((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :], d, out=d)


def _best(q: np.ndarray, q_rank: np.ndarray, s: np.ndarray, s_rank: np.ndarray, k: int, reach: np.ndarray | None = None):
    """(query row, candidate row, distance) of the k nearest others, ties by id.

    Candidates come from the fast product form with its rounding error added
    to the cut-off; their distances are then recomputed by subtraction, so
    ranks and ties are exact.  Where ``reach``, how far a query looks, leaves
    few candidates, they are not searched for the k-th nearest.
    """
    rows, cols, dist = [], [], []
    s_norm = float((s * s).sum(axis=1).max(initial=0.0))
    strip = max(16, STRIP * BLOCK // max(len(s), BLOCK))
    for at in range(0, len(q), strip):
        qs, ranks = q[at:at + strip], q_rank[at:at + strip]
        d = _squared(qs, s)
        d[ranks[:, None] == s_rank[None, :]] = np.inf
        slack = 1e-13 * ((qs * qs).sum(axis=1) + s_norm)
        hit = None
        if reach is not None:
            r, c = np.nonzero(d <= (reach[at:at + strip] ** 2 * (1 + 1e-12) + slack)[:, None])
            if len(r) <= FEW * len(qs) * k:
                hit = r, c
        if hit is None:
            take = min(k, len(s))
            limit = np.partition(d, take - 1, axis=1)[:, take - 1] + slack
            hit = np.nonzero(d <= limit[:, None])
        r, c = hit
        real = np.isfinite(d[r, c])
        r, c = r[real], c[real]
        ends = np.searchsorted(r, np.arange(len(qs) + 1))
        lo = 0
        while lo < len(qs):  # some rows at a time: equal points are all candidates
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + HITS, "right")) - 1)
            row, col = r[ends[lo]:ends[hi]], c[ends[lo]:ends[hi]]
            exact = np.sqrt(((s[col] - qs[row]) ** 2).sum(axis=1))
            order = np.lexsort((s_rank[col], exact, row))
            row = row[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            rows.append(row[first] + at)
            cols.append(col[order][first])
            dist.append(exact[order][first])
            lo = hi
    cat = np.concatenate
    return (cat(rows), cat(cols), cat(dist)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _id_ranks(ids: pa.Array) -> np.ndarray:
    """Position of every id in sorted id order, equal ids sharing one."""
    return np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1].reshape(-1)


#: most children of a tree node, and points that a task gives to children at once
FAN, ASSIGNED = 64, 16_384


def _hash(seed: int, turn: int, key: Column | str = "cell_id") -> Column:
    return F.xxhash64(F.lit(seed), F.lit(turn), key)


def _split_nodes(points: DataFrame, big: DataFrame, seed: int, level: int) -> DataFrame:
    """Give the points of the ``big`` nodes (node, n, fan) to the nearest of ``fan`` pivots, points of least hash:
    cell_id, vec, node (the child), dp (its distance to the pivot), parent, and one row a child with its pivot and no cell_id."""
    id_type = sql_type(points, "cell_id")
    inside = points.join(big, "node")
    first = Window.partitionBy("node").orderBy(_hash(seed, 2 * level), "cell_id")
    pivots = inside.withColumn("j", F.row_number().over(first)).where(F.col("j") <= FAN).where(F.col("j") <= F.col("fan"))
    chunks = F.ceil(F.col("n") / ASSIGNED).cast("int")
    each = F.explode(F.sequence(F.lit(0), chunks - 1))
    told = pivots.select("node", each.alias("chunk"), F.lit(None).cast(id_type).alias("cell_id"), "vec", "j")
    asked = inside.select("node", F.pmod(_hash(seed, 2 * level + 1), chunks).cast("int").alias("chunk"), "cell_id", "vec", F.lit(0).alias("j"))

    def assign(t: pa.Table) -> pa.Table:
        j, x, parent = t.column("j").to_numpy(), matrix(t), t.column("node")[0].as_py()
        p = np.flatnonzero(j)
        p = p[np.argsort(j[p])]
        q = np.flatnonzero(j == 0)
        child, dp = np.zeros(len(q), int), np.zeros(len(q))
        for at in range(0, len(q), STRIP):
            d = _squared(x[q[at:at + STRIP]], x[p])
            child[at:at + STRIP] = d.argmin(axis=1)
            # by subtraction: products lose the small distances
            dp[at:at + STRIP] = np.sqrt(((x[q[at:at + STRIP]] - x[p[child[at:at + STRIP]]]) ** 2).sum(axis=1))
        told = p if t.column("chunk")[0].as_py() == 0 else p[:0]
        names = np.array([f"{parent}.{c}" for c in range(len(p))], dtype=object)
        rows = pa.array(np.concatenate([q, told]))
        return pa.table({
            "cell_id": t.column("cell_id").take(rows), "vec": t.column("vec").take(rows),
            "node": pa.array(np.concatenate([names[child], names[: len(told)]]), pa.string()),
            "dp": pa.array(np.concatenate([dp, np.zeros(len(told))])), "parent": pa.array([parent] * len(rows), pa.string())})

    return told.unionByName(asked).groupBy("node", "chunk").applyInArrow(
        assign, f"cell_id {id_type}, vec array<double>, node string, dp double, parent string")


def _tree(store: Scratch, points: DataFrame, block: int, seed: int) -> tuple[DataFrame, list[DataFrame]]:
    """(points with their leaf and its size, node tables by level).

    A node of more than ``block`` points is split around pivots until its
    children fit; one whose points all go to the same pivot (copies of one
    vector) stays.  Nodes: node, parent, pivot, n, lo, hi (least and largest
    distance of a point to the pivot), leaf.
    """
    n = points.count()
    placed = points.select("cell_id", "vec", F.lit("r").alias("node"))
    sizes = points.sparkSession.createDataFrame([("r", n, n > block)], "node string, n bigint, big boolean")
    leaves, levels = None, []
    while True:
        done = placed.join(sizes.where("not big"), "node").select("cell_id", "vec", F.col("node").alias("leaf"), "n")
        leaves = done if leaves is None else leaves.unionByName(done)
        big = sizes.where("big").select("node", "n", F.least(F.lit(FAN), F.ceil(2 * F.col("n") / block)).alias("fan"))
        if big.limit(1).count() == 0:
            return leaves, levels
        split = store.save(_split_nodes(placed, big, seed, len(levels)), f"split{len(levels)}")
        parents = big.select(F.col("node").alias("parent"), F.col("n").alias("whole"))
        nodes = split.groupBy("node", "parent").agg(
            F.count("cell_id").alias("n"), F.min(F.when(F.col("cell_id").isNotNull(), F.col("dp"))).alias("lo"),
            F.max("dp").alias("hi"), F.max(F.when(F.col("cell_id").isNull(), F.col("vec"))).alias("pivot")).where("n > 0")
        nodes = nodes.join(parents, "parent").withColumn("leaf", (F.col("n") <= block) | (F.col("n") == F.col("whole")))
        levels.append(store.save(nodes.drop("whole"), f"nodes{len(levels)}"))
        placed = split.where("cell_id is not null").select("cell_id", "vec", "node")
        sizes = levels[-1].select("node", "n", (~F.col("leaf")).alias("big"))


def _near_pairs(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Pairs of different leaves a, b where a point of a can have something within its ``reach`` in b.

    ``leaves``: leaf, reach (the largest distance a point of it looks around).
    Level by level the children of a node stay whose ball is near enough.
    """
    nodes = None
    for level in levels:
        part = level.where("leaf").select("node", F.col("pivot").alias("p"), F.col("hi").alias("r"))
        nodes = part if nodes is None else nodes.unionByName(part)
    looking = leaves.join(nodes, leaves.leaf == nodes.node).select(F.col("leaf").alias("a"), "p", "r", "reach")
    pairs = None
    for i, level in enumerate(levels):
        child = level.select("node", "parent", "pivot", "hi", F.col("leaf").alias("ends"))
        # the root has at most FAN children
        met = looking.join(F.broadcast(child)) if i == 0 else looking.join(child, looking.at == child.parent)
        near = vec_distance(F.col("p"), F.col("pivot")) - F.col("r") - F.col("hi") <= _roomy(F.col("reach"))
        met = met.where(near).select("a", "p", "r", "reach", F.col("node").alias("at"), "ends")
        found = met.where(F.col("ends") & (F.col("a") != F.col("at"))).select("a", F.col("at").alias("b"))
        pairs = found if pairs is None else pairs.unionByName(found)
        looking = met.where(~F.col("ends")).drop("ends")
    return pairs


def _roomy(bound: Column) -> Column:
    """A bound with room for rounding."""
    return bound * (1 + 1e-9) + 1e-6


def knn(embedding: DataFrame, k: int, n_dims: int | None = None, block: int | None = None, seed: int = 0) -> DataFrame:
    """Exact k-nearest-neighbour edges ``src, dst, dist, rank``.

    ``k`` counts the point itself, so every point gets its k - 1 nearest
    others; equal distances go by id.  Of equal vectors only the k of least id
    are looked for, since they come before the others for every point; the
    others' neighbours are the one of least id and its neighbours.
    :func:`_nearest` finds the rest.
    """
    vec = F.col("vec") if n_dims is None else F.slice("vec", 1, n_dims)
    store = Scratch(embedding.sparkSession, "knn")
    points = store.save(embedding.select("cell_id", vec.cast("array<double>").alias("vec")), "points")
    n, ids, width = points.agg(F.count(F.lit(1)), F.countDistinct("cell_id"), F.max(F.size("vec"))).first()
    size = max(BLOCK, min(n // SENT, BLOCK_MOST // max(width or 1, 1))) if block is None else block
    if n <= size or ids < n or k < 2:
        return _nearest(store, points, k, size, seed)
    place = F.row_number().over(Window.partitionBy("vec").orderBy("cell_id"))
    firsts = store.save(points.withColumn("place", place).where(F.col("place") <= k), "firsts")
    m = firsts.count()
    if m == n:
        return _nearest(store, points, k, size, seed)
    if block is None and 2 * m < n:
        size = max(BLOCK, min(m // SENT, BLOCK_MOST // max(width or 1, 1)))
    found = store.save(_nearest(store, firsts.select("cell_id", "vec"), k, size, seed), "found")
    crowds = firsts.where(F.col("place") == k).select("vec")
    heads = firsts.where("place = 1").join(crowds, "vec").select("vec", F.col("cell_id").alias("head"))
    lists = found.join(heads.select(F.col("head").alias("src")), "src").groupBy(F.col("src").alias("head")).agg(
        F.collect_list(F.struct("dist", "dst")).alias("near"))
    itself = F.array(F.struct(F.lit(0.0).alias("dist"), F.col("head").alias("dst")))
    heads = heads.join(lists, "head").select("vec", F.slice(F.array_sort(F.concat(itself, "near")), 1, k - 1).alias("near"))
    others = points.join(firsts.select("cell_id"), "cell_id", "left_anti").join(heads, "vec").select(
        F.col("cell_id").alias("src"), F.posexplode("near").alias("rank", "e"))
    return found.unionByName(others.select("src", "e.dst", "e.dist", (F.col("rank") + 1).alias("rank")))


def _nearest(store: Scratch, points: DataFrame, k: int, block: int, seed: int) -> DataFrame:
    """The edges of :func:`knn` by a tree of pivots.

    The points are the leaves of a tree of pivots, written as tables: nodes
    split until a leaf fits a block (a leaf of equal points is cut by id hash).
    A point first meets its own block, which bounds the distance it has to
    look around; by the triangle inequality pairs of leaves, then points and
    leaves that are too far apart are left out, level by level of the tree, in
    joins.  Without structure a point is sent to every block, so blocks grow
    with the table, as far as the memory of a task allows.
    """
    id_type = sql_type(points, "cell_id")
    parts = points.sparkSession.sparkContext.defaultParallelism * DEALT
    leaves, levels = _tree(store, points, block, seed)
    subs = F.ceil(F.col("n") / block).cast("int")
    home = store.save(leaves.select(
        "cell_id", "vec", "leaf", subs.alias("subs"), F.pmod(_hash(seed, -1), subs).cast("int").alias("sub")), "home")

    def meet(t: pa.Table) -> pa.Table:
        """Nearest held points of every asking one within its reach; without one asking, all ask."""
        ids = t.column("cell_id").combine_chunks()
        rank, x = _id_ranks(ids), matrix(t)
        qi = si = np.arange(len(x))
        reach = None
        if "asks" in t.column_names:
            asks = t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            qi, si = np.flatnonzero(asks), np.flatnonzero(~asks)
            reach = t.column("reach").to_numpy(zero_copy_only=False)[qi]
        if not len(qi) or not len(si):
            return pa.table({"src": ids.slice(0, 0), "dst": ids.slice(0, 0), "dist": pa.array([], pa.float64())})
        r, c, d = _best(x[qi], rank[qi], x[si], rank[si], k - 1, reach)
        if reach is not None:
            near = d <= reach[r]
            r, c, d = r[near], c[near], d[near]
        return pa.table({"src": ids.take(pa.array(qi[r])), "dst": ids.take(pa.array(si[c])), "dist": pa.array(d)})

    edge = f"src {id_type}, dst {id_type}, dist double"
    local = store.save(home.repartition(parts, "leaf", "sub").groupBy("leaf", "sub").applyInArrow(meet, edge), "local")
    order = Window.partitionBy("src").orderBy("dist", "dst")
    if not levels and home.where("subs > 1").limit(1).count() == 0:
        return local.withColumn("rank", F.row_number().over(order))
    far = F.lit(float("inf"))
    bound = local.groupBy(F.col("src").alias("cell_id")).agg(F.count(F.lit(1)).alias("c"), F.max("dist").alias("d"))
    asking = store.save(home.join(bound, "cell_id", "left").withColumn(
        "reach", F.when(F.col("c") >= k - 1, F.col("d")).otherwise(far)).drop("c", "d"), "asking")

    # the other blocks of the own leaf, then the leaves that are near enough
    own = asking.where("subs > 1").select("cell_id", "vec", "reach", "leaf", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("to"), "sub").where(
        "to <> sub").drop("sub")
    targets = own
    if levels:
        pairs = store.save(_near_pairs(asking.groupBy("leaf").agg(F.max("reach").alias("reach")), levels), "pairs")
        nodes = None
        for level in levels:
            part = level.where("leaf").select("node", "parent", "pivot", "lo", "hi", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
            nodes = part if nodes is None else nodes.unionByName(part)
        mine = nodes.select(F.col("node").alias("a"), F.col("parent").alias("a_parent"), F.col("pivot").alias("a_pivot"))
        lanes = pairs.join(nodes, pairs.b == nodes.node).join(mine, "a").select(
            F.col("a").alias("leaf"), "b", "pivot", "lo", "hi", "blocks",
            F.when(F.col("parent") == F.col("a_parent"), F.col("a_pivot")).alias("beside"))
        d, side = vec_distance(F.col("vec"), F.col("pivot")), vec_distance(F.col("vec"), F.col("beside"))
        # a point of b is nearer to its own pivot than to a sibling of that
        plane = F.coalesce(F.try_divide(F.col("d") * F.col("d") - side * side, 2 * vec_distance(F.col("pivot"), F.col("beside"))), F.lit(0.0))
        lower = F.greatest(F.col("d") - F.col("hi"), F.col("lo") - F.col("d"), plane)
        routed = asking.select("cell_id", "vec", "reach", "leaf").join(lanes, "leaf").withColumn("d", d).where(lower <= _roomy(F.col("reach")))
        targets = own.unionByName(routed.select(
            "cell_id", "vec", "reach", F.col("b").alias("leaf"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to")))
    targets = store.save(targets, "targets")
    load = targets.groupBy("leaf", F.col("to").alias("sub")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    load = store.save(load, "load")
    questions = targets.withColumnRenamed("to", "sub").join(load, ["leaf", "sub"]).select(
        "leaf", "sub", F.pmod(_hash(seed, -2), F.col("chunks")).cast("int").alias("chunk"), "cell_id", "vec", "reach", F.lit(True).alias("asks"))
    held = home.join(load, ["leaf", "sub"]).select(
        "leaf", "sub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "cell_id", "vec",
        F.lit(0.0).alias("reach"), F.lit(False).alias("asks"))
    met = questions.unionByName(held).repartition(parts, "leaf", "sub", "chunk").groupBy("leaf", "sub", "chunk").applyInArrow(meet, edge)
    return local.unionByName(met).withColumn("rank", F.row_number().over(order)).where(F.col("rank") < k)


def connectivities(edges: DataFrame) -> DataFrame:
    """Fuzzy symmetric graph ``src, dst, weight`` from nearest-neighbour edges.

    Per point the nearest positive distance rho and a bandwidth sigma with
    sum exp(-(d - rho) / sigma) = log2 k; directed weights a, b of a pair join
    as a + b - ab.  Lists hold the k neighbours of one point.
    """
    id_type = sql_type(edges, "src")
    lists = edges.groupBy("src").agg(
        F.sort_array(F.collect_list(F.struct("dist", "dst"))).alias("nb")
    ).select("src", F.col("nb.dst").alias("dst"), F.col("nb.dist").alias("dist"))

    def smooth(it):
        for b in it:
            if not b.num_rows:
                continue
            lens = b.column("dist").value_lengths().to_numpy(zero_copy_only=False)
            flat = b.column("dist").flatten().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(b.num_rows), lens)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
            d = np.full((b.num_rows, lens.max()), np.inf)
            d[rows, at] = flat
            rho = np.where(d > 0, d, np.inf).min(axis=1)
            rho = np.where(np.isfinite(rho), rho, 0.0)
            gap = np.maximum(d - rho[:, None], 0.0)
            goal = np.log2(lens + 1.0)
            low, high, mid = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
            for _ in range(64):
                total = np.exp(-gap / mid[:, None]).sum(axis=1)
                big = total > goal
                high = np.where(big, mid, high)
                low = np.where(big, low, mid)
                mid = np.where(np.isfinite(high), (low + high) / 2, mid * 2)
            mean = np.where(np.isfinite(d), d, 0.0).sum(axis=1) / (lens + 1.0)
            sigma = np.maximum(mid, 1e-3 * mean)
            sigma = np.where(sigma > 0, sigma, 1.0)
            w = np.exp(-gap / sigma[:, None])[rows, at]
            yield from batches(src=b.column("src").take(pa.array(rows)), dst=b.column("dst").flatten(), w=w)

    directed = lists.mapInArrow(smooth, f"src {id_type}, dst {id_type}, w double")
    # every edge is sent to both orders in place: one shuffle, no self join
    two = F.explode(F.array(
        F.struct("src", "dst", F.col("w").alias("a"), F.lit(0.0).alias("b")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("a"), F.col("w").alias("b")),
    ))
    return directed.select(two.alias("e")).select("e.*").groupBy("src", "dst").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")
    ).select("src", "dst", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("weight"))


#: doubles that one side of a pair of super-blocks may hold, rows from which a block is worth a task, tasks for a slot
SIDE_DOUBLES, LEAST_BLOCK, TASKS = 4_000_000, 1024, 2
#: rows of a super-block; the time of a task grows with their square
MOST_BLOCK = 16_384
#: columns of a distance tile
TILE = 2048


def grid_side(points: DataFrame, count: Column, block: int | None) -> Column:
    """Into how many super-blocks a group of ``count`` rows is cut, every pair of which is a task.

    A vector is sent to as many tasks as there are super-blocks, which is the
    square root of twice the tasks.  Blocks are as large as the slots in use
    and the memory of a task allow; ``block`` sets their size instead.
    """
    if block is not None:
        return F.ceil(count / block).cast("int")
    slots = points.sparkSession.sparkContext.defaultParallelism * TASKS
    width = points.select(F.max(F.size("vec"))).first()[0] or 1
    most = max(LEAST_BLOCK, min(MOST_BLOCK, SIDE_DOUBLES // width))
    wanted = F.least(F.ceil(count / LEAST_BLOCK), F.lit(math.ceil(math.sqrt(2 * slots))))
    return F.greatest(F.ceil(count / most), wanted).cast("int")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances; 0 where rounding hides the difference."""
    d = _products(x, y)
    a, b = (x * x).sum(axis=1), (y * y).sum(axis=1)
    r, c = np.nonzero(d <= 2e-14 * (a.max(initial=0.0) + b.max(initial=0.0)))  # few, so only these are looked at closely
    d[r, c] = np.where(d[r, c] <= 1e-14 * (a[r] + b[c]), 0.0, d[r, c])
    return np.sqrt(d, out=d)


def distance_sums(
    points: DataFrame, labels: Sequence[str], group: str | None = None, per_point: bool = True,
    block: int | None = None,
) -> DataFrame:
    """Sums of Euclidean distances from points to the points of each label.

    Exact over all ordered pairs (a point with itself adds 0), within each
    ``group``.  Every unordered pair of super-blocks is one task, which goes
    through its pairs in tiles.  With ``per_point``: ``[group,] cell_id,
    labelling, other, s``; otherwise ``[group,] labelling, own, other, s``.
    Several label columns share the distances; ``labelling`` is the position
    of the column.  A null label is no label.
    """
    id_type = sql_type(points, "cell_id")
    store = Scratch(points.sparkSession, "pairs")
    g = F.lit("") if group is None else F.col(group).cast("string")
    # labels travel as hashes and get their names back at the end
    codes = F.array(*[F.xxhash64(F.lit(i), F.col(c).cast("string")) for i, c in enumerate(labels)])
    base = store.save(points.select(
        g.alias("grp"), "cell_id", F.col("vec").cast("array<double>").alias("vec"), codes.alias("lab"),
        F.array(*[F.col(c).cast("string") for c in labels]).alias("names")), "points")
    names = store.save(base.select(F.explode(F.arrays_zip("lab", "names")).alias("p")).select(
        F.col("p.lab").alias("code"), F.col("p.names").alias("name")).where("name is not null").distinct(), "names")
    sizes = base.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("grp", grid_side(base, F.col("n"), block).alias("nb"))
    h = F.pmod(F.xxhash64("cell_id"), F.col("nb")).cast("int")
    placed = base.drop("names").join(sizes, "grp").withColumn("blk", h)
    # point -> all pairs its super-block is part of
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    sent = placed.withColumn("o", other).select(
        "grp", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "cell_id", "vec", "lab")
    m = len(labels)

    def sums(t: pa.Table) -> pa.Table:
        blk = t.column("blk").to_numpy()
        i, j = int(t.column("i")[0].as_py()), int(t.column("j")[0].as_py())
        x = matrix(t)
        lab = t.column("lab").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
        ids = t.column("cell_id").combine_chunks()
        grp = t.column("grp")[0].as_py()
        a, b = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        values, places = zip(*[np.unique(lab[:, c], return_inverse=True) for c in range(m)])
        ends = np.cumsum([len(v) for v in values])
        hot = np.zeros((len(x), ends[-1]))
        for c in range(m):
            hot[np.arange(len(x)), places[c].reshape(-1) + ends[c] - len(values[c])] = 1.0
        left, right = np.zeros((len(a), ends[-1])), np.zeros((len(b), ends[-1]))
        for at in range(0, len(a), STRIP):
            rows = a[at:at + STRIP]
            for to in range(0, len(b), TILE):
                cols = b[to:to + TILE]
                d = distances(x[rows], x[cols])
                left[at:at + STRIP] += d @ hot[cols]
                if i != j:
                    right[to:to + TILE] += d.T @ hot[rows]
        sides = [(a, left)] if i == j else [(a, left), (b, right)]
        out = []
        for c in range(m):
            span = slice(ends[c] - len(values[c]), ends[c])
            for rows, s in sides:
                if per_point:
                    part = s[:, span]
                    r, q = np.nonzero(part)
                    key = {"cell_id": ids.take(pa.array(rows[r]))}
                else:
                    part = hot[rows, span].T @ s[:, span]
                    r, q = np.nonzero(np.ones_like(part))
                    key = {"own": pa.array(values[c][r])}
                out.append(pa.table({
                    "grp": pa.array([grp] * len(r), pa.string()), **key, "labelling": pa.array(np.full(len(r), c, dtype=np.int32)),
                    "other": pa.array(values[c][q]), "s": pa.array(part[r, q])}))
        return pa.concat_tables(out)

    own = f"cell_id {id_type}" if per_point else "own bigint"
    parts = points.sparkSession.sparkContext.defaultParallelism * DEALT
    raw = sent.repartition(parts, "grp", "i", "j").groupBy("grp", "i", "j").applyInArrow(sums, f"grp string, {own}, labelling int, other bigint, s double")
    key = "cell_id" if per_point else "own"
    total = raw.groupBy("grp", key, "labelling", "other").agg(F.sum("s").alias("s"))
    for c in ["other"] if per_point else ["own", "other"]:
        total = total.withColumnRenamed(c, "code").join(names, "code").withColumnRenamed("name", c).drop("code")
    total = total.select("grp", key, "labelling", "other", "s")
    return total.drop("grp") if group is None else total.withColumnRenamed("grp", group)


def silhouettes(points: DataFrame, labels: Sequence[str], block: int | None = None) -> DataFrame:
    """Exact mean Euclidean silhouette of one or more labellings.

    ``labelling`` (column name), ``silhouette``, ``n_clusters``; null when a
    labelling has one cluster or only singletons.
    """
    points = cut(points.select("cell_id", "vec", *labels), "labelled")
    sums = distance_sums(points, labels, block=block)
    pairs = F.posexplode(F.array(*[F.col(c).cast("string") for c in labels])).alias("labelling", "own")
    mine = cut(points.select("cell_id", pairs), "own")
    sizes = cut(mine.groupBy("labelling", "own").agg(F.count(F.lit(1)).alias("size")), "sizes")
    whole = sizes.groupBy("labelling").agg(
        F.collect_list(F.struct(F.col("own").alias("other"), F.col("size").alias("other_size"))).alias("all"),
        F.count(F.lit(1)).alias("n_clusters"), F.sum("size").alias("n"))
    # a zero sum (identical points) has no row, so labels are spread out first
    grid = mine.join(whole.select("labelling", "all"), "labelling").select(
        "cell_id", "labelling", "own", F.explode("all").alias("o")).select("cell_id", "labelling", "own", "o.*")
    full = grid.join(sums, ["cell_id", "labelling", "other"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    per = full.groupBy("cell_id", "labelling").agg(
        F.max(F.when(F.col("own") == F.col("other"), F.try_divide(F.col("s"), F.col("other_size") - 1))).alias("a"),
        F.min(F.when(F.col("own") != F.col("other"), F.col("s") / F.col("other_size"))).alias("b"),
    )
    value = F.when(F.col("a").isNull(), 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    names = F.array(*[F.lit(c) for c in labels])
    valid = (F.col("n_clusters") > 1) & (F.col("n_clusters") < F.col("n"))
    return (
        per.groupBy("labelling").agg(F.avg(value).alias("score"))
        .join(whole.select("labelling", "n_clusters", "n"), "labelling")
        .select(F.get(names, F.col("labelling")).alias("labelling"),
                F.when(valid, F.col("score")).alias("silhouette"), "n_clusters")
    )
