"""Distributional shifts between two conditions in an embedding."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions.columns import vec_distance
from stipple.operators.composition import bh
from stipple.operators.neighbors import STRIP, TILE, distance_sums, distances, grid_side
from stipple.operators.summary import gate
from stipple.operators.vectors import matrix
from stipple.session import cut

#: permutations whose weights a task holds at once
PERMUTATIONS_PER_TASK = 125
#: places that go through the network at once: they stay in a core's cache
PLACES = 16_384


def energy_distance(
    points: DataFrame, by: str = "cluster", ref: str = "WT", test: str = "KO", min_n: int = 1,
    block: int | None = None,
) -> DataFrame:
    """2 mean|x-y| - mean|x-x'| - mean|y-y'| per group, over all ordered pairs
    including each point with itself: ``by, n_ref, n_test, edistance``."""
    points = cut(points.where(F.col("condition").isin(ref, test)).select(
        "cell_id", F.col(by).cast("string").alias(by), "condition", "vec"), "energy")
    ok = gate(points, by, "condition", ref, test, min_n)
    sums = distance_sums(points.join(ok.select(by), by, "left_semi"), ["condition"], by, per_point=False, block=block)

    def total(a: str, b: str):
        return F.sum(F.when((F.col("own") == a) & (F.col("other") == b), F.col("s")).otherwise(0.0))

    g = sums.groupBy(by).agg(total(ref, test).alias("xy"), total(ref, ref).alias("xx"), total(test, test).alias("yy"))
    n1, n2 = F.col("n_ref"), F.col("n_test")
    e = 2 * F.col("xy") / (n1 * n2) - F.col("xx") / (n1 * n1) - F.col("yy") / (n2 * n2)
    return ok.join(g, by).select(by, "n_ref", "n_test", e.alias("edistance"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _shuffled(index: np.ndarray, n: int, key: int, turns: np.ndarray) -> np.ndarray:
    """Place of each ``index`` (of 0 .. n - 1) in each of the permutations ``turns``, cell by permutation.

    A Feistel network over as many bits as n needs; places past n walk on, so
    every place is known without the others, and none occurs twice.
    """
    bits = max(2, (n - 1).bit_length())
    half = np.uint64(bits // 2)
    low, high = (np.uint64(1) << half) - np.uint64(1), (np.uint64(1) << np.uint64(bits - bits // 2)) - np.uint64(1)
    keys = _mixed(_mixed(np.uint64(key) + np.asarray(turns, np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
                  + np.arange(1, 9, dtype=np.uint64)[:, None] * np.uint64(0xD1B54A32D192ED03))

    def network(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for i in range(0, 8, 2):
            left = left ^ _mixed(right + keys[i]) & high
            right = right ^ _mixed(left + keys[i + 1]) & low
        return left << half | right

    out = np.empty((len(index), len(turns)), np.int64)
    step = max(1, PLACES // max(1, len(turns)))
    for at in range(0, len(index), step):
        start = np.asarray(index[at:at + step], np.uint64)[:, None]
        x = network(np.broadcast_to(start, (len(start), len(turns))), keys)
        row, turn = np.nonzero(x >= n)
        while len(row):
            moved = network(x[row, turn], keys[:, turn])
            x[row, turn] = moved
            out_of = moved >= n
            row, turn = row[out_of], turn[out_of]
        out[at:at + step] = x
    return out


def permutation_test(
    points: DataFrame, by: str = "cluster", ref: str = "WT", test: str = "KO", n_perms: int = 999,
    cap: int | None = None, min_n: int = 5, seed: int = 42, per_task: int = PERMUTATIONS_PER_TASK,
    block: int | None = None,
) -> DataFrame:
    """Permutation p-values of the energy distance per group.

    All cells enter the observed and every permuted statistic, which are sums
    over pairs of super-blocks for all permutations at once.  With a ``cap`` each
    statistic takes min(n_ref, n_test, cap) cells a side, drawn anew from all
    cells of the group in every permutation.  Cells are numbered by id hash and
    id, so permutations do not depend on partitioning.  A task holds two
    super-blocks and the weights of ``per_task`` permutations for a part of
    their cells.
    """
    points = cut(points.where(F.col("condition").isin(ref, test)).select(
        "cell_id", F.col(by).cast("string").alias(by), "condition", "vec"), "permute")
    ok = gate(points, by, "condition", ref, test, min_n)
    placed = points.join(ok, by).withColumn("nb", grid_side(points, F.col("n_ref") + F.col("n_test"), block)).withColumn(
        "blk", F.pmod(F.xxhash64("cell_id"), F.col("nb")).cast("int"))
    # numbers from 0 in the group and on the cell's side: those of the blocks before and the rank in the block
    is_test = F.col("condition") == test
    sizes = placed.groupBy(by, "blk").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_test).alias("t"))
    before = Window.partitionBy(by).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    sizes = sizes.select(by, "blk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                         F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    inside = Window.partitionBy(by, "blk").orderBy("cell_id")  # one block
    sided = Window.partitionBy(by, "blk", "condition").orderBy("cell_id")
    placed = placed.join(sizes, [by, "blk"]).withColumn("place", F.col("n0") + F.row_number().over(inside) - 1).withColumn(
        "own", F.when(is_test, F.col("t0")).otherwise(F.col("n0") - F.col("t0")) + F.row_number().over(sided) - 1)
    sent = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        by, F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "place", "own",
        is_test.alias("is_test"), "n_ref", "n_test", "vec")

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("place").to_numpy(), kind="stable")))
        group, x, blk = t.column(by)[0].as_py(), matrix(t), t.column("blk").to_numpy()
        i, j, n_ref, n_test = (int(t.column(c)[0].as_py()) for c in ("i", "j", "n_ref", "n_test"))
        place, own = t.column("place").to_numpy(), t.column("own").to_numpy()
        tested = t.column("is_test").to_numpy()
        a, b = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        key = zlib.crc32(group.encode()) << 32 | seed & 0xFFFFFFFF
        m_test, m_ref = (n_test, n_ref) if cap is None else (min(n_ref, n_test, cap),) * 2

        drawn = own
        if cap is not None:
            drawn = np.empty(len(own), np.int64)
            for side, n in ((tested, n_test), (~tested, n_ref)):
                drawn[side] = _shuffled(own[side], n, key, np.zeros(1, np.int64))[:, 0]
        observed = np.where(tested, (drawn < m_test) / m_test, (drawn < m_ref) / -m_ref)

        def weights(rows: np.ndarray, turns: np.ndarray) -> np.ndarray:
            at = _shuffled(place[rows], n_ref + n_test, key, turns)
            v = np.where(at < m_test, 1.0 / m_test, np.where(at < m_test + m_ref, -1.0 / m_ref, 0.0))
            v[:, turns == 0] = observed[rows, None]
            return v

        # the distances of a pair of tiles serve all permutations
        stat = np.zeros(n_perms + 1)
        groups = [np.arange(at, min(at + per_task, n_perms + 1)) for at in range(0, n_perms + 1, per_task)]
        for to in range(0, len(b), TILE):
            cols = b[to:to + TILE]
            v = [weights(cols, turns) for turns in groups]
            for at in range(0, len(a), TILE):
                rows = a[at:at + TILE]
                if i == j and at > to:
                    continue  # the pair of tiles is met the other way round
                twice = 1 if i == j and at == to else 2
                d = np.vstack([distances(x[rows[k:k + STRIP]], x[cols]) for k in range(0, len(rows), STRIP)])
                for turns, w in zip(groups, v):
                    u = w if i == j and at == to else weights(rows, turns)
                    stat[turns] -= twice * (u * (d @ w)).sum(axis=0)
        return pa.table({by: pa.array([group] * len(stat), pa.string()), "p": pa.array(np.arange(len(stat))), "part": pa.array(stat)})

    parts = sent.groupBy(by, "i", "j").applyInArrow(run, f"{by} string, p bigint, part double")
    per = cut(parts.groupBy(by, "p").agg(F.sum("part").alias("stat")), "statistics")
    seen = per.where("p = 0").select(by, F.col("stat").alias("edistance_sample"))
    # equal splits of the cells may differ in rounding
    reached = F.col("stat") >= F.col("edistance_sample") - 1e-12 - 1e-9 * F.abs("edistance_sample")
    counts = per.join(seen, by).groupBy(by).agg(
        F.max("edistance_sample").alias("edistance_sample"), (F.count_if(reached) / (n_perms + 1)).alias("pvalue"))
    return ok.join(counts, by).select(by, "n_ref", "n_test", "edistance_sample", "pvalue")


def expression_shift(
    points: DataFrame, by: str = "cluster", ref: str = "WT", test: str = "KO", n_perms: int = 999,
    cap: int | None = None, min_n: int = 5, seed: int = 42, alpha: float = 0.05,
) -> DataFrame:
    """Energy distance over all cells with permutation p and BH adjustment."""
    points = cut(points.select("cell_id", F.col(by).cast("string").alias(by), "condition", "vec"), "shift")
    p = permutation_test(points, by, ref, test, n_perms, cap, min_n, seed)
    if cap is None:  # the observed statistic is the distance itself
        p = p.withColumn("edistance", F.col("edistance_sample"))
    else:
        p = p.join(energy_distance(points, by, ref, test, min_n).select(by, "edistance"), by)
    return bh(p, "pvalue", alpha, tie=[by])


def shift_z(points: DataFrame, ref: str = "WT") -> DataFrame:
    """Every row with ``edist_z``: its z-scored (population sd) distance to
    the centroid of the reference condition."""
    points = cut(points, "points")
    mean = points.where(F.col("condition") == ref).select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(
        F.avg("x").alias("m"))
    centre = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_c"))
    dist = points.join(F.broadcast(centre)).withColumn("_d", vec_distance(F.col("vec"), F.col("_c"))).drop("_c")
    dist = cut(dist, "distances")
    stats = dist.agg(F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_s"))
    return dist.join(F.broadcast(stats)).withColumn(
        "edist_z", F.try_divide(F.col("_d") - F.col("_m"), F.col("_s"))).drop("_d", "_m", "_s")
