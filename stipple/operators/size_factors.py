"""Pooled size factors by deconvolution.

The cells of a group stand on a ring, ordered so that neighbours have similar
totals.  Every run of neighbours of some sizes is a pool, whose median ratio to
the group's average profile is an equation for the factors of its cells.  The
normal equations of a ring are circulant, and their inverse is a kernel that
dies out: a cell's factor follows from the right sides of its neighbours.  Both
steps run over segments of the ring that see a little of the next ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions.order import numbered, quantiles
from stipple.operators.normalize import cell_totals
from stipple.operators.vectors import gene_index
from stipple.session import Scratch

#: pool sizes (fixed values): 21, 26, ..., 101
POOLS = tuple(range(21, 102, 5))
#: weight of the equations that make the system solvable
WEAK = 1e-6
#: cells of a segment whose pools are formed, and whose equations are solved
POOLED, SOLVED = 512, 16_384
#: neighbours beyond which the inverse kernel is below 1e-14 of its peak
REACH = 4096


def _sizes(n: int) -> list[int]:
    return [w for w in POOLS if w <= n] or [n]


def _overlap(n: int, cells: int) -> np.ndarray:
    """First row of the normal equations on a ring of n cells, with the pools of ``cells``: how many pools a lag shares."""
    lag, out = np.arange(n), np.zeros(n)
    for w in _sizes(cells):
        out += np.maximum(w - lag, 0) + np.maximum(w - (n - lag), 0) * (lag > 0)
    out[0] += WEAK
    return out


def _segments(table: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Rows sent to the segments of their ring that need them: seg, q (place, past 0 and n where the ring closes) and own.

    ``table`` has n and pos.  A ring is cut evenly into segments of at least
    ``size`` cells; a segment gets the ``before`` cells in front of it and the
    ``after`` cells behind it, a ring of one segment nothing twice.
    """
    k = F.greatest(F.lit(1).cast("bigint"), F.expr(f"n div {size}"))
    seg = F.expr("(pos * k) div n")
    low, high = F.expr("(seg * n + k - 1) div k"), F.expr("((seg + 1) * n + k - 1) div k")
    placed = table.withColumn("k", k).withColumn("seg", seg).withColumns({"low": low, "high": high})

    def sent(to: Column, q: Column, own: bool) -> Column:
        return F.struct(to.cast("bigint").alias("seg"), q.alias("q"), F.lit(own).alias("own"))

    def when(rule: Column, out: Column) -> Column:
        return F.when(rule & (F.col("k") > 1), F.array(out)).otherwise(F.array().cast("array<struct<seg:bigint,q:bigint,own:boolean>>"))

    place, last = F.col("pos"), F.col("k") - 1
    back = sent(F.pmod(F.col("seg") - 1, F.col("k")), F.when(F.col("seg") == 0, place + F.col("n")).otherwise(place), False)
    on = sent(F.pmod(F.col("seg") + 1, F.col("k")), F.when(F.col("seg") == last, place - F.col("n")).otherwise(place), False)
    all_ = F.concat(F.array(sent(F.col("seg"), place, True)), when(place - F.col("low") < after, back), when(F.col("high") - place <= before, on))
    return placed.withColumn("to", F.explode(all_)).drop("seg", "low", "high").select("*", "to.*").drop("to")


def _pooled(t: pa.Table) -> pa.Table:
    """Sums of the pool medians over the cells of each pool, from the pools that start in a segment: pos, rhs."""
    t = t.sort_by("q")
    n, genes, segments = (int(t.column(c)[0].as_py()) for c in ("n", "used", "k"))
    own = t.column("own").to_numpy(zero_copy_only=False).astype(bool)
    lens = t.column("val").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    _, col = np.unique(t.column("genes").combine_chunks().flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    x = np.zeros((t.num_rows, genes))  # genes without counts here are columns of zeros
    x[np.repeat(np.arange(len(x)), lens), col] = t.column("val").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes, m = _sizes(n), int(own.sum())
    if segments == 1:  # the ring closes inside the segment
        x = np.vstack([x, x[: max(sizes) - 1]])
    sums = np.vstack([np.zeros((1, genes)), np.cumsum(x, axis=0)])
    out = np.zeros(m + max(sizes) - 1)
    for w in sizes:
        pool = np.median(sums[w:w + m] - sums[:m], axis=1)
        out[: m + w - 1] += np.convolve(pool, np.ones(w))
    first = int(t.column("q")[0].as_py())
    return pa.table({"grp": pa.array([t.column("grp")[0].as_py()] * len(out), pa.string()),
                     "pos": pa.array((first + np.arange(len(out))) % n), "rhs": pa.array(out)})


def _solved(t: pa.Table) -> pa.Table:
    """The rates of the own cells of a segment: the right sides times the inverse kernel."""
    t = t.sort_by("q")
    n, segments = (int(t.column(c)[0].as_py()) for c in ("n", "k"))
    own = t.column("own").to_numpy(zero_copy_only=False).astype(bool)
    rhs = t.column("rhs").to_numpy()
    if segments == 1:
        rate = np.fft.irfft(np.fft.rfft(rhs) / np.fft.rfft(_overlap(n, n)), n)
    else:
        kernel = np.fft.irfft(1 / np.fft.rfft(_overlap(4 * REACH, n)), 4 * REACH)
        rate = np.convolve(rhs, np.concatenate([kernel[-REACH:], kernel[: REACH + 1]]), "valid")
    return pa.table({"grp": t.column("grp").filter(pa.array(own)), "pos": t.column("pos").filter(pa.array(own)), "rate": pa.array(rate)})


def pooled_size_factors(counts: DataFrame, groups: DataFrame, min_mean: float = 0.1) -> DataFrame:
    """``cell_id, size_factor`` with mean one.

    A group of any size is one ring.  Groups are brought to one scale by the
    median ratio of their average profiles to a reference group.  A cell whose
    factor would not be positive takes the typical factor of its group for its
    total; so do all cells of a group without a gene of ``min_mean``.
    """
    store = Scratch(counts.sparkSession, "factors")
    counts = store.save(counts.where("n > 0").select("cell_id", "gene", "n"), "counts")
    index = store.save(gene_index(counts), "index")
    lab = cell_totals(counts).join(groups.select("cell_id", F.col("group").cast("string").alias("grp")), "cell_id")
    r, n = F.col("r"), F.col("n")
    # even ranks go up, odd ranks come back
    pos = F.when(r % 2 == 0, F.expr("r div 2")).otherwise(n - 1 - F.expr("r div 2"))
    cells = store.save(numbered(lab, ["total", "cell_id"], ["grp"], "r", size="n").withColumn("pos", pos).drop("r"), "cells")
    shape = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("cells"), F.avg("total").alias("depth"))
    profile = counts.withColumnRenamed("n", "c").join(cells.select("cell_id", "grp", "total"), "cell_id").groupBy("grp", "gene").agg(
        F.sum(F.col("c") / F.col("total")).alias("s"))
    profile = store.save(profile.join(shape, "grp").select("grp", "gene", (F.col("s") / F.col("cells") * F.col("depth")).alias("ave")), "profile")
    used = store.save(profile.where(F.col("ave") >= min_mean).join(index, "gene"), "used")
    each = store.save(used.groupBy("grp").agg(F.count(F.lit(1)).alias("used"), F.sum("ave").alias("mass")), "each")

    entries = counts.withColumnRenamed("n", "c").join(cells.select("cell_id", "grp", "total"), "cell_id").join(used, ["grp", "gene"])
    entries = entries.groupBy("grp", "cell_id").agg(F.collect_list(F.struct(
        "i", (F.col("c") / F.col("total") / F.col("ave")).alias("v"))).alias("p"))
    rows = cells.where("n > 1").join(each, "grp").join(entries, ["grp", "cell_id"], "left").select(
        "grp", "n", "pos", "used", F.coalesce(F.col("p.i"), F.array().cast("array<int>")).alias("genes"),
        F.coalesce(F.col("p.v"), F.array().cast("array<double>")).alias("val"))
    sides = _segments(rows, POOLED, 0, max(POOLS) - 1).groupBy("grp", "seg").applyInArrow(_pooled, "grp string, pos bigint, rhs double")
    sides = store.save(sides.groupBy("grp", "pos").agg(F.sum("rhs").alias("rhs")), "sides")
    ring = sides.join(each, "grp").join(shape, "grp").select(
        "grp", "pos", F.col("cells").alias("n"), (F.col("rhs") + WEAK / F.col("mass")).alias("rhs"))
    rates = _segments(ring, SOLVED, REACH, REACH).groupBy("grp", "seg").applyInArrow(_solved, "grp string, pos bigint, rate double")
    rates = store.save(rates, "rates")
    typical = quantiles(rates.where("rate > 0"), ["grp"], ["rate"], {"typical": 0.5}).select("grp", "typical")
    solved = cells.join(rates, ["grp", "pos"], "left").join(shape, "grp").join(typical, "grp", "left").select(
        "grp", "cell_id", (F.col("total") * F.when(F.col("rate") > 0, F.col("rate")).otherwise(
            F.coalesce("typical", 1 / F.col("depth")))).alias("nf"))

    widest = profile.groupBy("grp").agg(F.count(F.lit(1)).alias("g")).agg(F.max_by("grp", F.struct("g", "grp")).alias("grp"))
    ref = profile.join(F.broadcast(widest), "grp").select("gene", F.col("ave").alias("ref"))  # one group
    ratio = profile.join(ref, "gene").where((F.col("ave") + F.col("ref")) / 2 >= min_mean).select("grp", (F.col("ave") / F.col("ref")).alias("ratio"))
    scale = quantiles(ratio, ["grp"], ["ratio"], {"scale": 0.5}).select("grp", "scale")
    scaled = store.save(solved.join(scale, "grp", "left").select("cell_id", (F.col("nf") * F.coalesce("scale", F.lit(1.0))).alias("sf")), "scaled")
    mean = scaled.agg(F.avg("sf").alias("_m"))
    return scaled.join(F.broadcast(mean)).select("cell_id", (F.col("sf") / F.col("_m")).alias("size_factor"))
