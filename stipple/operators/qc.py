"""Quality control: gene flags, per-cell and per-gene metrics, outlier rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions.order import quantiles
from stipple.schema import require
from stipple.session import cut

#: default gene flags (fixed patterns): mitochondrial, ribosomal, hemoglobin
GENE_FLAGS = {"mt": "^mt-", "ribo": "^Rp[sl]", "hb": "^Hb[^(p)]"}


def flag_genes(genes: DataFrame, patterns: dict[str, str], name: str = "gene") -> DataFrame:
    """One boolean column per pattern."""
    return genes.withColumns({k: F.col(name).rlike(p) for k, p in patterns.items()})


def cell_qc(
    counts: DataFrame,
    cells: DataFrame,
    genes: DataFrame | None = None,
    flags: Sequence[str] = (),
    top: int | None = 20,
    log1p: bool = True,
) -> DataFrame:
    """Per-cell totals, genes detected, flagged shares (0-100) and top share.

    Cells without counts keep zero totals and null shares.  With a top share
    the counts are read once and hashed by cell once: ranks and all sums share
    that partitioning (a cell has at most one row per gene).
    """
    require(counts, "cell_id", "gene", "n")
    flagged = counts
    if flags:
        # joined on gene; the flag table is one row per gene, so the engine
        # broadcasts it only when its measured size allows
        flagged = counts.join(genes.select("gene", *flags), "gene", "left")
    aggs = [
        F.sum("n").alias("total_counts"),
        F.count_if(F.col("n") > 0).alias("n_genes_by_counts"),
    ]
    aggs += [
        F.sum(F.when(F.col(f), F.col("n")).otherwise(0.0)).alias(f"total_counts_{f}")
        for f in flags
    ]
    if top:
        w = Window.partitionBy("cell_id").orderBy(F.desc("n"))
        flagged = flagged.withColumn("_rn", F.row_number().over(w))
        aggs.append(F.sum(F.when(F.col("_rn") <= top, F.col("n"))).alias("_top"))
    per_cell = flagged.groupBy("cell_id").agg(*aggs)
    out = cells.join(per_cell, "cell_id", "left")
    sums = ["total_counts", *[f"total_counts_{f}" for f in flags]]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in sums})
    out = out.withColumn("n_genes_by_counts", F.coalesce("n_genes_by_counts", F.lit(0)))

    def pct(part: Column) -> Column:
        return F.try_divide(part * 100.0, F.col("total_counts"))

    new: dict[str, Column] = {}
    if log1p:
        for c in ["total_counts", "n_genes_by_counts", *sums[1:]]:
            new[f"log1p_{c}"] = F.log1p(F.col(c).cast("double"))
    for f in flags:
        new[f"pct_counts_{f}"] = pct(F.col(f"total_counts_{f}"))
    if top:
        new[f"pct_counts_in_top_{top}_genes"] = pct(F.col("_top"))
    return out.withColumns(new).drop("_top") if new else out


def gene_qc(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Per-gene metrics; means and dropout divide by *all* cells."""
    n_cells = cells.agg(F.count(F.lit(1)).cast("double").alias("_cells"))
    per_gene = counts.groupBy("gene").agg(
        F.count_if(F.col("n") > 0).alias("n_cells_by_counts"),
        F.sum("n").alias("total_counts"),
    )
    mean = F.col("total_counts") / F.col("_cells")
    return (
        per_gene.join(F.broadcast(n_cells))  # one row
        .withColumns({
            "mean_counts": mean,
            "log1p_mean_counts": F.log1p(mean),
            "pct_dropout_by_counts": (1 - F.col("n_cells_by_counts") / F.col("_cells")) * 100.0,
            "log1p_total_counts": F.log1p("total_counts"),
        })
        .drop("_cells")
    )


def mad_outlier(
    df: DataFrame, columns: Sequence[str], nmads: float, by: Sequence[str] = ("sample",)
) -> DataFrame:
    """``<column>_outlier``: beyond median +- nmads x unscaled MAD, strictly."""
    by, columns = list(by), list(columns)
    df = cut(df, "metrics")  # read three times below
    med = quantiles(df, by, columns, {"med": 0.5}).select(*by, "metric", "med")
    wide = med.groupBy(*by).agg(*[
        F.max(F.when(F.col("metric") == c, F.col("med"))).alias(f"_med_{c}") for c in columns
    ])
    joined = df.join(wide, by, "left") if by else df.join(F.broadcast(wide))
    dev = joined.select(*by, *[F.abs(F.col(c) - F.col(f"_med_{c}")).alias(c) for c in columns])
    mad = quantiles(dev, by, columns, {"mad": 0.5}).groupBy(*by).agg(*[
        F.max(F.when(F.col("metric") == c, F.col("mad"))).alias(f"_mad_{c}") for c in columns
    ])
    joined = joined.join(mad, by, "left") if by else joined.join(F.broadcast(mad))
    flags = {}
    for c in columns:
        centre, width = F.col(f"_med_{c}"), F.col(f"_mad_{c}") * float(nmads)
        flags[f"{c}_outlier"] = F.coalesce(
            (F.col(c) < centre - width) | (F.col(c) > centre + width), F.lit(False)
        )
    return joined.withColumns(flags).drop(
        *[f"_med_{c}" for c in columns], *[f"_mad_{c}" for c in columns]
    )


OUTLIER_METRICS = ("log1p_total_counts", "log1p_n_genes_by_counts", "pct_counts_in_top_20_genes")


def qc_flags(
    cells: DataFrame,
    nmads: float,
    pct_column: str,
    max_pct: float,
    by: Sequence[str] = ("sample",),
    metrics: Sequence[str] = OUTLIER_METRICS,
) -> DataFrame:
    """``outlier`` (any MAD rule) and ``mt_outlier`` (share above ``max_pct``).

    ``max_pct`` is a percentage on the 0-100 scale of ``pct_column``.
    """
    flagged = mad_outlier(cells, metrics, nmads, by)
    any_rule = F.lit(False)
    for m in metrics:
        any_rule = any_rule | F.col(f"{m}_outlier")
    return flagged.withColumns({
        "outlier": any_rule,
        "mt_outlier": F.coalesce(F.col(pct_column) > float(max_pct), F.lit(False)),
    }).drop(*[f"{m}_outlier" for m in metrics])


def passing(cells: DataFrame) -> DataFrame:
    return cells.where(~F.col("outlier") & ~F.col("mt_outlier"))


def apply_qc(counts: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and cells that pass."""
    kept = passing(cells)
    return counts.join(kept.select("cell_id"), "cell_id", "left_semi"), kept


def qc_report(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells before and after filtering, and how many each rule flagged."""
    keep = ~F.col("outlier") & ~F.col("mt_outlier")
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells_before"),
        F.count_if(F.col("outlier")).alias("n_outlier"),
        F.count_if(F.col("mt_outlier")).alias("n_mt_outlier"),
        F.count_if(keep).alias("cells_after"),
    )


def filter_genes(counts: DataFrame, min_cells: int) -> DataFrame:
    """Keep genes detected in at least ``min_cells`` cells."""
    kept = (
        counts.where(F.col("n") > 0)
        .groupBy("gene")
        .agg(F.count(F.lit(1)).alias("_c"))
        .where(F.col("_c") >= min_cells)
        .select("gene")
    )
    return counts.join(kept, "gene", "left_semi")


def keep_singlets(counts: DataFrame, cells: DataFrame, genes: DataFrame | None = None,
                  flags: Sequence[str] = (), class_column: str = "class", singlet: int = 1) -> DataFrame:
    """Singlet cells with recomputed plain metrics and a constant label."""
    keep = cells.where(F.col(class_column) == singlet)
    base = keep.select(*[c for c in keep.columns if not c.startswith(("total_counts", "pct_counts", "n_genes_by"))])
    sub = counts.join(base.select("cell_id"), "cell_id", "left_semi")
    return cell_qc(sub, base, genes, flags, top=None, log1p=False).withColumn(
        class_column, F.lit("singlet")
    )
