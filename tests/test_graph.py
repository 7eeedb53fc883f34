"""Neighbours, clusters, trajectories and shifts on planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.operators import cluster, neighbors, shift, trajectory
from stipple.operators.layout import curve, layout
from stipple.session import cut


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


@pytest.mark.parametrize("block", [4096, 48])
def test_knn_is_exact_with_many_copies(vec_table, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    x[:150] = x[0]
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    got = neighbors.knn(vec_table(x), 8, block=block).orderBy("src", "rank").toPandas()
    assert (got.dst.to_numpy().reshape(400, 7) == np.argsort(d, axis=1, kind="stable")[:, :7]).all()
    assert np.allclose(got.dist.to_numpy().reshape(400, 7), np.sort(d, axis=1)[:, :7], atol=0)


def test_connectivities_bandwidth(vec_table):
    x = np.random.default_rng(1).normal(size=(120, 4))
    e = cut(neighbors.knn(vec_table(x), 10))
    g = neighbors.connectivities(e).toPandas()
    w = {(r.src, r.dst): r.weight for r in g.itertuples()}
    assert all(abs(w[(b, a)] - v) < 1e-12 for (a, b), v in w.items()) and 0 < min(w.values()) and max(w.values()) <= 1
    p = e.toPandas().sort_values(["src", "rank"])
    a = {}
    for src, part in p.groupby("src"):
        gap = part.dist.to_numpy() - part.dist.min()
        lo, hi = 1e-9, 1e3
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.exp(-gap / mid).sum() < np.log2(10) else (lo, mid)
        a.update({(src, t): v for t, v in zip(part.dst, np.exp(-gap / lo))})
    for (i, j), v in w.items():
        p1, p2 = a.get((i, j), 0.0), a.get((j, i), 0.0)
        assert v == pytest.approx(p1 + p2 - p1 * p2, abs=1e-6)


@pytest.mark.parametrize("block", [4096, 50])
def test_silhouette_and_energy(vec_table, block):
    rng = np.random.default_rng(2)
    lab = np.arange(150) % 3
    x = rng.normal(size=(150, 5)) + lab[:, None]
    cond = np.where(np.arange(150) % 2 == 0, "WT", "KO")
    t = vec_table(x, cluster=lab, condition=cond)
    d = distances(x)
    own = np.array([d[i, lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1) for i in range(150)])
    oth = np.array([min(d[i, lab == c].mean() for c in range(3) if c != lab[i]) for i in range(150)])
    got = neighbors.silhouettes(t, ["cluster", "condition"], block=block).toPandas().set_index("labelling")
    assert got.silhouette["cluster"] == pytest.approx(((oth - own) / np.maximum(own, oth)).mean(), abs=1e-9)
    e = shift.energy_distance(t, block=block).toPandas().set_index("cluster").edistance
    for c in range(3):
        a, b = x[(lab == c) & (cond == "WT")], x[(lab == c) & (cond == "KO")]
        both = np.vstack([a, b])
        q = distances(both)
        n = len(a)
        want = 2 * q[:n, n:].mean() - q[:n, :n].mean() - q[n:, n:].mean()
        assert e[str(c)] == pytest.approx(want, abs=1e-9)


def test_leiden_finds_blobs_and_ignores_partitioning(vec_table):
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 4, 400)
    x = (rng.normal(size=(4, 10)) * 4)[truth] + rng.normal(size=(400, 10))
    t = vec_table(x, truth=truth)
    g = cut(neighbors.connectivities(cut(neighbors.knn(t, 15))))
    got = cluster.leiden(g, [0.5, 1.0]).join(t.select("cell_id", "truth"), "cell_id").toPandas()
    half = got[got.resolution == 0.5]
    assert half.cluster.nunique() == 4 and (half.groupby("cluster").truth.nunique() == 1).all()
    assert (got[got.resolution == 1.0].groupby("cluster").truth.nunique() == 1).all()
    again = cluster.leiden(g.repartition(3), [0.5]).toPandas()
    key = ["resolution", "cell_id"]
    assert half.sort_values(key).cluster.tolist() == again.sort_values(key).cluster.tolist()


def gains(graph, label, gamma):
    """Best gain of a move of one node, to any community or alone, on a dense graph."""
    n = len(label)
    w = np.zeros((n, n))
    w[graph.src, graph.dst] = graph.weight
    k, m2 = w.sum(1), w.sum()
    hot = np.eye(label.max() + 2)[label]  # the last community is empty
    into = (w - np.diag(np.diag(w))) @ hot - gamma * k[:, None] * (hot.T @ k) / m2
    own = hot.astype(bool)
    stay = into[own] + gamma * k * k / m2
    return np.where(own, -np.inf, into).max(1) - stay


@pytest.mark.parametrize("nodes", [20_000, 40])  # one block; many, and communities that fit none
def test_leiden_ends_where_nobody_gains(vec_table, monkeypatch, nodes):
    monkeypatch.setattr(cluster, "NODES", nodes)
    rng = np.random.default_rng(13)
    n = 300 if nodes > 60 else 90
    x = rng.normal(size=(n, 6)) + rng.integers(0, 3, n)[:, None] * 2
    g = cut(neighbors.connectivities(cut(neighbors.knn(vec_table(x), 12))))
    got = cluster.leiden(g, [0.4, 1.5] if nodes > 60 else [1.0]).orderBy("cell_id").toPandas()
    table = g.toPandas()
    for gamma, part in got.groupby("resolution"):
        label = part.cluster.astype(int).to_numpy()
        assert gains(table, label, gamma).max() < 1e-8
        w = np.zeros((n, n))
        w[table.src, table.dst] = table.weight
        hot = np.eye(label.max() + 1)[label]
        between, k = hot.T @ w @ hot, hot.T @ w.sum(1)
        merge = between - gamma * np.outer(k, k) / w.sum()
        assert (merge[~np.eye(len(merge), dtype=bool)] < 1e-8).all()  # no two communities gain by merging
        for c in range(label.max() + 1):  # connected
            inside = np.flatnonzero(label == c)
            seen, todo = {inside[0]}, [inside[0]]
            while todo:
                new = set(inside[w[todo.pop()][inside] > 0]) - seen
                seen |= new
                todo += new
            assert len(seen) == len(inside)


def test_leiden_moves_few_nodes_one_by_one(vec_table, monkeypatch):
    """Several blocks, and wishing nodes with few edges: no round has to grant moves that are made together."""
    monkeypatch.setattr(cluster, "NODES", 60)
    granted, wishes, together, looks = cluster._granted, cluster._wishes, [], []
    monkeypatch.setattr(cluster, "_granted", lambda *a: together.append(1) or granted(*a))
    monkeypatch.setattr(cluster, "_wishes", lambda *a: looks.append(1) or wishes(*a))
    x = np.random.default_rng(3).normal(size=(150, 8))
    g = cut(neighbors.connectivities(cut(neighbors.knn(vec_table(x), 10))))
    label = cluster.leiden(g, [1.0]).orderBy("cell_id").toPandas().cluster.astype(int).to_numpy()
    assert looks and not together
    assert gains(g.toPandas(), label, 1.0).max() < 1e-8


def test_moves_beside_nodes_that_stay():
    # places 0 and 1 move, 2 to 4 stay; 0 hangs on 2, 1 on 0 and 3, and the community of 4 is heavy
    at, to = np.array([0, 0, 1, 1, 1]), np.array([1, 2, 0, 3, 4])
    w, k = np.array([1.0, 3.0, 1.0, 2.0, 2.5]), np.array([4.0, 5.5])
    comm = np.array([0, 1, 2, 3, 4])
    mass, size = np.array([4.0, 5.5, 3.0, 2.0, 60.0]), np.ones(5, int)
    assert cluster._moved(at, to, w, k, comm, 1 / 80, False, mass, size).tolist() == [2, 3, 2, 3, 4]
    size[:2] = 2  # no longer alone
    assert cluster._moved(at, to, w, k, comm, 1 / 80, True, mass, size).tolist() == comm.tolist()


def test_leiden_on_a_long_chain_and_on_single_nodes(spark):
    n = 200
    i = spark.range(n - 1)
    chain = i.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    both = cut(chain.unionByName(chain.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    label = cluster.leiden(both).orderBy("cell_id").toPandas().cluster.astype(int).to_numpy()
    cuts = np.flatnonzero(np.diff(label))
    assert len(cuts) == label.max()  # runs of the chain
    sizes = np.diff(np.concatenate([[0], cuts + 1, [n]]))
    m2, ends = 2.0 * (n - 1), np.concatenate([[0], cuts + 1, [n]])
    k = 2.0 * sizes
    k[0] -= 1
    k[-1] -= 1
    assert (1 - k[:-1] * k[1:] / m2 <= 1e-9).all()  # no two runs gain by merging
    loops = cut(spark.range(50).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight")))
    assert cluster.leiden(loops).select("cluster").distinct().count() == 50
    assert cluster.leiden(loops.limit(0)).count() == 0


def test_diffusion_time_follows_a_line(spark, vec_table):
    rng = np.random.default_rng(4)
    s = np.sort(rng.random(300)) * 8
    x = np.column_stack([np.sin(s / 3), np.cos(s / 3), s]) + rng.normal(size=(300, 3)) * 0.02
    g = cut(neighbors.connectivities(cut(neighbors.knn(vec_table(x), 15))))
    e, values = trajectory.diffmap(g, 10, tol=1e-8)
    e = cut(e)
    p = g.toPandas()
    w = np.zeros((300, 300))
    w[p.src, p.dst] = p.weight
    q = w.sum(0)
    k = w / np.outer(q, q)
    z = np.sqrt(k.sum(0))
    want = np.sort(np.linalg.eigvalsh(k / np.outer(z, z)))[::-1][:10]
    assert np.allclose(values, want, atol=1e-8)
    root = spark.createDataFrame([(0,)], "cell_id bigint")
    t = trajectory.pseudotime(e, values, root).orderBy("cell_id").toPandas().pseudotime.to_numpy()
    assert np.corrcoef(np.argsort(np.argsort(t)), np.arange(300))[0, 1] > 0.99 and t.max() == 1


def test_diffusion_map_of_many_nodes_moves_few_columns(spark, monkeypatch):
    rng = np.random.default_rng(6)
    parts, size = 3, 20
    w = np.zeros((parts * size, parts * size))
    for p in range(parts):  # three separate parts: the eigenvalue 1 three times
        at = slice(p * size, (p + 1) * size)
        w[at, at] = np.triu(rng.random((size, size)) * (rng.random((size, size)) < 0.2), 1) + np.diag(np.full(size - 1, 0.5), 1)
    w += w.T
    src, dst = np.nonzero(w)
    g = cut(spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(src, dst)], "src bigint, dst bigint, weight double"))
    monkeypatch.setattr(trajectory, "WIDE_NODES", 50)
    widths, names = [], []
    add, save = trajectory.sum_arrays, trajectory.Scratch.save
    monkeypatch.setattr(trajectory, "sum_arrays", lambda t, by, c, width: widths.append(width) or add(t, by, c, width))
    monkeypatch.setattr(trajectory.Scratch, "save", lambda self, df, name: names.append(name) or save(self, df, name))
    e, values = trajectory.diffmap(g, 4, tol=1e-8)
    k = w / np.outer(w.sum(0), w.sum(0))
    k = k / np.sqrt(np.outer(k.sum(0), k.sum(0)))
    want = np.sort(np.linalg.eigvalsh(k))[::-1][:4]
    assert np.allclose(values, want, atol=1e-8) and np.allclose(want[:3], 1)
    x = np.array([r.vec for r in e.orderBy("cell_id").collect()])
    assert np.allclose(k @ x, x * values, atol=1e-6)
    assert max(widths) <= 5 and "basis" not in names


def test_permutation_p_values(vec_table):
    rng = np.random.default_rng(5)
    n = 240
    cl, cond = np.arange(n) % 2, np.where(np.arange(n) // 2 % 2 == 0, "WT", "KO")
    x = rng.normal(size=(n, 4))
    x[(cl == 1) & (cond == "KO")] += 0.8
    t = vec_table(x, cluster=cl, condition=cond)
    a = shift.expression_shift(t, n_perms=199, cap=50).orderBy("cluster").toPandas()
    assert a.pvalue[0] > 0.05 and a.pvalue[1] == pytest.approx(1 / 200) and a.significant.tolist() == [False, True]
    b = shift.permutation_test(t.repartition(5), n_perms=199, cap=50, per_task=17).orderBy("cluster").toPandas()
    assert a.pvalue.tolist() == b.pvalue.tolist()


def test_layout_keeps_blobs_apart(vec_table):
    rng = np.random.default_rng(6)
    truth = np.arange(200) % 2
    x = rng.normal(size=(200, 6)) + truth[:, None] * 6
    t = vec_table(x, truth=truth)
    g = cut(neighbors.connectivities(cut(neighbors.knn(t, 10))))
    got = layout(g, t.select("cell_id", "vec"), epochs=5).orderBy("cell_id").toPandas()
    y = np.array(got.vec.tolist())
    a, b = y[truth == 0], y[truth == 1]
    gap = np.linalg.norm(a.mean(0) - b.mean(0))
    assert np.isfinite(y).all() and gap > 1.5 * max(a.std(), b.std())
    assert curve(0.1, 1.0) == pytest.approx((1.577, 0.895), abs=0.02)


def test_split_finds_connected_parts_of_long_paths(spark):
    from stipple.operators.cluster import _split
    from stipple.session import Scratch

    store = Scratch(spark, "split")
    pairs = [(f"{i:04d}", f"{i + 1:04d}") for i in range(199)] + [("x1", "x2")]
    edges = store.save(spark.createDataFrame(
        [(0, a, b, 1.0) for a, b in pairs] + [(0, b, a, 1.0) for a, b in pairs], "r int, src string, dst string, w double"), "edges")
    nodes = sorted({n for p in pairs for n in p})
    state = store.save(spark.createDataFrame([(0, n, "c", 1.0) for n in nodes], "r int, node string, comm string, k double"), "state")
    parts, joined = _split(store, edges, state)
    got = {r.node: r.comm for r in parts.collect()}
    assert joined == 200
    assert {got[f"{i:04d}"] for i in range(200)} == {"0000"} and got["x1"] == got["x2"] != "0000"


def test_permutations_use_all_cells(vec_table):
    rng = np.random.default_rng(8)
    n = 1500
    cond = np.where(np.arange(n) < 900, "WT", "KO")
    x = rng.normal(size=(n, 3)) + 0.12 * (cond == "KO")[:, None]
    t = vec_table(x, cluster=np.zeros(n, int), condition=cond)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    v = np.where(cond == "KO", 1 / 600, -1 / 900)
    a = shift.permutation_test(t, n_perms=99).toPandas()
    assert a.edistance_sample[0] == pytest.approx(-v @ d @ v, rel=1e-9)
    b = shift.permutation_test(t, n_perms=99, block=300).toPandas()  # 15 block pairs
    assert b.edistance_sample[0] == pytest.approx(-v @ d @ v, rel=1e-9)
    null = [-w @ d @ w for w in (rng.permutation(v) for _ in range(999))]
    dense = (1 + sum(s >= -v @ d @ v for s in null)) / 1000
    assert abs(a.pvalue[0] - dense) < 0.06 and abs(b.pvalue[0] - dense) < 0.06


def test_shuffled_places():
    at = shift._shuffled(np.arange(10), 10, 7, np.arange(4000))
    assert (np.sort(at, axis=0) == np.arange(10)[:, None]).all()
    first = np.bincount(np.sort(at.argsort(axis=0)[:2], axis=0)[0] * 10 + np.sort(at.argsort(axis=0)[:2], axis=0)[1], minlength=100)
    assert (first > 0).sum() == 45 and first.max() < 150 and first[first > 0].min() > 45  # each pair near 4000 / 45 = 89
    big = shift._shuffled(np.arange(5000), 5000, 7, np.arange(3))
    assert (np.sort(big, axis=0) == np.arange(5000)[:, None]).all()


def test_a_crowd_wishing_into_one_community_moves_in_part(spark):
    n, k, m2 = 4000, 1.0, 5000.0
    wishes = spark.range(n).selectExpr("0 r", "id node", "id comm", f"{k}D k", "-1L target", "0.3D + id * 1e-9D gain")
    got = cluster._granted(wishes, [1.0], m2)
    assert got.count() == n
    moved = got.where("granted").count()
    # the last one's gain is what all before it have left of 0.3
    assert n / 8 < moved <= 0.3 * m2


def test_hubs_of_a_crowd_settle(spark, monkeypatch):
    monkeypatch.setattr(cluster, "NODES", 30)
    monkeypatch.setattr(cluster, "EDGES", 250)
    rng = np.random.default_rng(8)
    pairs = {(i, int(j)) for i in range(8, 90) for j in rng.choice(8, 5, replace=False)} | {(i, i + 1) for i in range(90, 94)}
    rows = [(a, b, 1.0) for i, j in pairs for a, b in ((i, j), (j, i))]
    g = cut(spark.createDataFrame(rows, "src bigint, dst bigint, weight double"))
    rounds, wishes = [], cluster._wishes
    monkeypatch.setattr(cluster, "_wishes", lambda *a: (rounds.append(1), wishes(*a))[1])
    got = cluster.leiden(g, [1.0]).toPandas()
    assert len(got) == 95 and len(rounds) < 60
    label = dict(zip(got.cell_id, got.cluster))
    degree, mass = {}, {}
    for a, _, w in rows:
        degree[a] = degree.get(a, 0) + w
    for a, k in degree.items():
        mass[label[a]] = mass.get(label[a], 0) + k
    m2, link = sum(degree.values()), {}
    for a, b, w in rows:
        link.setdefault(a, {}).setdefault(label[b], 0.0)
        link[a][label[b]] += w
    for a, to in link.items():
        stay = to.get(label[a], 0) - degree[a] * (mass[label[a]] - degree[a]) / m2
        assert all(w - degree[a] * mass[c] / m2 <= stay + 1e-6 for c, w in to.items() if c != label[a])
