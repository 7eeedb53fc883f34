"""Normalisations that keep the sparse long form, and dense residuals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.functions.order import median
from stipple.session import cut
from stipple.operators.vectors import BLOCK_DOUBLES, list_array, sql_type


def cell_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell_id").agg(F.sum("n").alias("total"))


def shifted_log(
    counts: DataFrame, target: float | None = None, by: Sequence[str] = ("sample",)
) -> DataFrame:
    """``log1p(n * target / total)``; the default target is the median total
    of cells with counts, per ``by`` group.  Zeros stay zero, so the result is
    as sparse as the input."""
    by = list(by) if target is None else []
    totals = counts.groupBy("cell_id", *by).agg(F.sum("n").alias("total")).where("total > 0")
    if target is None:
        totals = cut(totals, "totals")  # one row per cell, read twice
        mid = median(totals, by, "total", "target")
        totals = totals.join(mid, by) if by else totals.join(F.broadcast(mid))
    else:
        totals = totals.withColumn("target", F.lit(float(target)))
    scale = totals.select("cell_id", (F.col("target") / F.col("total")).alias("_s"))
    return counts.join(scale, "cell_id").select(
        "cell_id", "gene", F.log1p(F.col("n") * F.col("_s")).alias("value")
    )


def apply_size_factors(counts: DataFrame, size_factors: DataFrame) -> DataFrame:
    """``log1p(n / size_factor)``; the job fails on a factor <= 0."""
    bad = F.raise_error(F.concat(F.lit("size factor not positive: "), F.col("cell_id")))
    sf = size_factors.select(
        "cell_id",
        F.when(F.col("size_factor") > 0, F.col("size_factor")).otherwise(bad.cast("double")).alias("_sf"),
    )
    return counts.join(sf, "cell_id").select(
        "cell_id", "gene", F.log1p(F.col("n") / F.col("_sf")).alias("value")
    )


def gene_moments(expr: DataFrame, cells: DataFrame, value: str = "value") -> DataFrame:
    """Mean and sample variance per gene with absent entries as zeros."""
    n = cells.agg(F.count(F.lit(1)).cast("double").alias("n_cells"))
    x = F.col(value)
    return (
        expr.groupBy("gene").agg(F.sum(x).alias("s1"), F.sum(x * x).alias("s2"))
        .join(F.broadcast(n))  # one row
        .withColumn("mean", F.col("s1") / F.col("n_cells"))
        .withColumn(
            "var",
            F.greatest(
                F.try_divide(F.col("s2") - F.col("n_cells") * F.col("mean") * F.col("mean"),
                             F.col("n_cells") - 1),
                F.lit(0.0),
            ),
        )
    )


def scale(expr: DataFrame, cells: DataFrame, max_value: float | None = 10.0) -> DataFrame:
    """Divide by the gene's standard deviation (zeros included) without
    centring and cap; a constant gene is divided by one."""
    sd = gene_moments(expr, cells).select(
        "gene", F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0).alias("_sd")
    )
    v = F.col("value") / F.col("_sd")
    return expr.join(sd, "gene").select(
        "cell_id", "gene", (v if max_value is None else F.least(v, F.lit(float(max_value)))).alias("value")
    )


def pearson_residuals(
    vecs: DataFrame, gene_totals: DataFrame, n_cells: int, theta: float = 100.0, clip: float | None = None,
    dense: bool = True,
) -> DataFrame:
    """Analytic residuals, one array per cell over the gene index.

    ``vecs`` holds count vectors; ``gene_totals`` has the total ``t`` of every
    gene ``i`` of the same index.  A block of cells meets the totals once, in
    a task; neither passes through the driver.

    With ``dense`` off the same residuals come without their repeats:
    ``cell_id, idx, val`` for the genes a cell has counts of, and for each
    distinct total, ascending, the residual ``zero`` of the ``left`` genes of
    that total without counts in the cell.
    """
    if not dense:
        return _residuals_by_total(vecs, gene_totals, n_cells, theta, clip)
    width = gene_totals.count()
    step = max(1, BLOCK_DOUBLES // max(width, 1))
    blocks = max(1, -(-n_cells // step))
    bound = float(np.sqrt(n_cells)) if clip is None else float(clip)
    told = gene_totals.agg(F.sort_array(F.collect_list(F.struct("i", F.col("t").cast("double").alias("t")))).alias("p"))  # one row
    told = told.select(F.col("p.t").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"))
    placed = vecs.withColumn("blk", F.pmod(F.xxhash64("cell_id"), F.lit(blocks)).cast("int"))

    def residuals(cells: pa.Table, told: pa.Table) -> pa.Table:
        totals = told.column("t").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        lens = cells.column("idx").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        x = np.zeros((cells.num_rows, width))
        x[np.repeat(np.arange(len(x)), lens), cells.column("idx").combine_chunks().flatten().to_numpy(zero_copy_only=False)] = (
            cells.column("val").combine_chunks().flatten().to_numpy(zero_copy_only=False))
        mu = x.sum(axis=1, keepdims=True) * (totals / totals.sum())[None, :]
        sd = np.sqrt(mu + mu * mu / theta)
        z = np.divide(x - mu, sd, out=np.zeros_like(x), where=sd > 0)
        return pa.table({"cell_id": cells.column("cell_id"), "vec": list_array(np.clip(z, -bound, bound))})

    return placed.groupBy("blk").cogroup(told.groupBy("blk")).applyInArrow(
        residuals, f"cell_id {sql_type(vecs, 'cell_id')}, vec array<double>")


def _residuals_by_total(
    vecs: DataFrame, gene_totals: DataFrame, n_cells: int, theta: float, clip: float | None,
) -> DataFrame:
    """Where a cell has no count, a gene's residual depends on the gene's total only: work goes by non-zeros and
    by cells times distinct totals, of which whole counts have at most the root of twice their sum."""
    t = F.col("t").cast("double").alias("t")
    totals = gene_totals.select("i", t)
    classes = cut(totals.groupBy("t").agg(F.count(F.lit(1)).alias("m")), "gene_totals")
    told = classes.agg(F.collect_list(F.struct(F.coalesce("t", F.lit(float("nan"))).alias("t"), "m")).alias("p"))  # one row
    entries = vecs.agg(F.sum(F.size("idx"))).first()[0] or 0
    step = max(1, BLOCK_DOUBLES // max(classes.count(), 1))
    blocks = max(1, -(-n_cells // step), -(-entries // BLOCK_DOUBLES))
    told = told.select("p.t", "p.m", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"))
    bound = float(np.sqrt(n_cells)) if clip is None else float(clip)
    long = vecs.withColumn("row", F.monotonically_increasing_id())
    long = long.select("cell_id", "row", F.explode_outer(F.arrays_zip("idx", "val")).alias("e")).select("cell_id", "row", F.col("e.idx").alias("i"), F.col("e.val").alias("v")).join(totals, "i", "left")
    some = F.when(F.col("i").isNotNull(), F.struct("i", "v", "t"))
    placed = long.groupBy("row").agg(F.first("cell_id").alias("cell_id"), F.sort_array(F.collect_list(some)).alias("p")).select(
        "cell_id", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("blk"), "p.i", "p.v", "p.t")

    def residual(x: np.ndarray, mu: np.ndarray) -> np.ndarray:
        sd = np.sqrt(mu + mu * mu / theta)
        return np.clip(np.divide(x - mu, sd, out=np.zeros_like(mu), where=sd > 0), -bound, bound)

    def flat(cells: pa.Table, name: str) -> np.ndarray:
        return cells.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

    def residuals(cells: pa.Table, told: pa.Table) -> pa.Table:
        n = cells.num_rows
        t, m = flat(told, "t"), flat(told, "m")
        t, m = t[by := np.argsort(t)], m[by]
        all_counts = (t * m).sum()
        lens = cells.column("i").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        row, i = np.repeat(np.arange(n), lens), flat(cells, "i")
        last = np.append((row[1:] != row[:-1]) | (i[1:] != i[:-1]), True)[:len(row)]  # a gene given twice counts once
        row, i, v, own = row[last], i[last], flat(cells, "v")[last], flat(cells, "t")[last]
        size = np.bincount(row, v, n)
        left = np.tile(m, (n, 1))
        np.subtract.at(left, (row, np.searchsorted(t, own)), 1)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
        mu = size[:, None] * (t / all_counts)[None, :]
        return pa.table({
            "cell_id": cells.column("cell_id"),
            "idx": pa.ListArray.from_arrays(ends, pa.array(i, pa.int32())),
            "val": pa.ListArray.from_arrays(ends, pa.array(residual(v, size[row] * (own / all_counts)))),
            "zero": list_array(residual(np.zeros_like(mu), mu)),
            "left": pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(t), pa.array(left.ravel()))})

    tasks = min(blocks, 2000)  # small rows, much work: not to be put together by their size
    return placed.repartition(tasks, "blk").groupBy("blk").cogroup(told.repartition(tasks, "blk").groupBy("blk")).applyInArrow(
        residuals, f"cell_id {sql_type(vecs, 'cell_id')}, idx array<int>, val array<double>, zero array<double>, left array<bigint>")
