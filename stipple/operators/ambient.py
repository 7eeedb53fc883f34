"""Ambient (background) count estimation and removal."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions.order import average_ranks, numbered, quantiles, running_sum_before
from stipple.functions.stats import hypergeometric_tail, log_gamma_density, poisson_tail
from stipple.operators.composition import bh
from stipple.session import cut


def ambient_profile(counts: DataFrame) -> DataFrame:
    """Share of each gene in all counts of its sample, from the given cells."""
    per = counts.groupBy("sample", "gene").agg(F.sum("n").alias("counts"))
    total = per.groupBy("sample").agg(F.sum("counts").alias("_t"))
    return per.join(total, "sample").select(
        "sample", "gene", "counts", (F.col("counts") / F.col("_t")).alias("est")
    )


def _by_group(counts: DataFrame, groups: DataFrame, detected: float) -> DataFrame:
    """Counts and detections per (sample, group, gene)."""
    return counts.join(groups.select("cell_id", "group"), "cell_id").groupBy("sample", "group", "gene").agg(
        F.sum("n").alias("obs"), F.count_if(F.col("n") > detected).alias("cells_with"))


def group_markers(counts: DataFrame, groups: DataFrame, detected: float = 0.9, fdr: float = 0.01) -> DataFrame:
    """tf-idf markers of each group inside its sample, kept when enriched by a
    hypergeometric test at ``fdr``: sample, group, gene, tfidf."""
    per = cut(_by_group(counts, groups, detected), "by_group")
    sizes = counts.select("sample", "cell_id").distinct().join(groups.select("cell_id", "group"), "cell_id").groupBy(
        "sample", "group").agg(F.count(F.lit(1)).alias("cells"))
    sample_n = sizes.groupBy("sample").agg(F.sum("cells").alias("all_cells"))
    gene_n = per.groupBy("sample", "gene").agg(F.sum("cells_with").alias("all_with"))
    t = per.join(sizes, ["sample", "group"]).join(sample_n, "sample").join(gene_n, ["sample", "gene"]).where(
        "cells_with > 0")
    t = t.withColumn("tfidf", F.col("cells_with") / F.col("cells") * F.ln(F.col("all_cells") / F.col("all_with")))
    t = t.withColumn("pvalue", hypergeometric_tail("cells_with", "all_with", "all_cells", "cells"))
    return bh(t, "pvalue", fdr, by=["sample", "group"], tie=["gene"]).where("significant").select(
        "sample", "group", "gene", "tfidf")


def contamination(
    counts: DataFrame, groups: DataFrame, profile: DataFrame, lo: float = 0.01, hi: float = 0.1,
    tfidf_min: float = 1.0, quantile: float = 0.9, max_markers: int = 100, fdr: float = 0.2,
    prior_mean: float = 0.05, prior_sd: float = 0.1,
) -> DataFrame:
    """Contamination fraction per sample: ``sample, rho, n_pairs``.

    Marker genes that are common in the background are looked at in the groups
    that do not express them; every such (gene, group) pair gives a gamma
    posterior, and rho is the mode of their mean on a grid within [lo, hi].
    A sample without usable pairs gets ``lo`` with ``n_pairs`` 0.
    """
    floor = quantiles(profile, ["sample"], ["est"], {"floor": quantile}).select("sample", "floor")
    common = profile.join(floor, "sample").where("est > floor").select("sample", "gene", "est")
    marks = group_markers(counts, groups).where(F.col("tfidf") >= tfidf_min).groupBy("sample", "gene").agg(
        F.max("tfidf").alias("tfidf"))
    first = Window.partitionBy("sample").orderBy(F.desc("tfidf"), "gene")
    targets = cut(marks.join(common, ["sample", "gene"]).withColumn("rn", F.row_number().over(first)).where(
        F.col("rn") <= max_markers).select("sample", "gene", "est"), "targets")

    cells = cut(counts.groupBy("sample", "cell_id").agg(F.sum("n").alias("umi")).join(
        groups.select("cell_id", "group"), "cell_id"), "cells")
    # cells that hold more of a target than the largest contamination explains
    seen = counts.join(targets, ["sample", "gene"]).join(cells.select("cell_id", "umi", "group"), "cell_id")
    seen = cut(seen.select("sample", "gene", "group", "n", poisson_tail("n", F.col("umi") * F.col("est") * hi).alias("p")), "seen")
    n_cells = cells.groupBy("sample").agg(F.count(F.lit(1)).alias("m"))
    ranked = average_ranks(seen, ["sample", "gene"], "p").join(n_cells, "sample")
    top_rank = F.col("rank") + (F.col("ties") - 1) / 2
    limit = ranked.where(F.col("p") * F.col("m") / top_rank < fdr).groupBy("sample", "gene").agg(F.max("p").alias("limit"))
    expressing = seen.join(limit, ["sample", "gene"]).where("p <= limit").select("sample", "gene", "group").distinct()

    group_umi = cells.groupBy("sample", "group").agg(F.sum("umi").alias("umi"))
    observed = seen.groupBy("sample", "gene", "group").agg(F.sum("n").alias("obs"))
    pairs = (
        targets.join(group_umi, "sample").join(expressing, ["sample", "gene", "group"], "left_anti")
        .join(observed, ["sample", "gene", "group"], "left")
        .select("sample", F.coalesce("obs", F.lit(0.0)).alias("obs"), (F.col("est") * F.col("umi")).alias("exp"))
    )
    v2 = (prior_sd / prior_mean) ** 2
    shape = 1 + v2**-2 / 2 * (1 + math.sqrt(1 + 4 * v2))
    theta = prior_mean / (shape - 1)
    steps = [i / 1000 for i in range(1001) if lo - 1e-12 <= i / 1000 <= hi + 1e-12]
    grid = pairs.withColumn("rho", F.explode(F.array(*[F.lit(s) for s in steps])))
    dens = F.exp(log_gamma_density("rho", F.col("obs") + shape, theta / (1 + theta * F.col("exp"))))
    mean = grid.groupBy("sample", "rho").agg(F.avg(dens).alias("d"), F.count(F.lit(1)).alias("n_pairs"))
    best = mean.groupBy("sample").agg(
        F.max_by("rho", F.struct(F.col("d"), -F.col("rho"))).alias("rho"), F.max("n_pairs").alias("n_pairs"))
    return n_cells.select("sample").join(best, "sample", "left").select(
        "sample", F.coalesce("rho", F.lit(float(lo))).alias("rho"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


def ambient_genes(
    counts: DataFrame, groups: DataFrame, profile: DataFrame, rho: DataFrame, cutoff: float = 0.01
) -> DataFrame:
    """Per (sample, group, gene): the test whether the group's counts of the
    gene are background only, and ``keep``.

    Genes of a group are taken from the most to the least background-like, and
    a gene's own Poisson tail is combined with the tail of the background
    counts already used up, a running sum over ranges of tails (Fisher's method, 4 degrees of freedom, for which
    the chi-square tail is p (1 - ln p))."""
    per = counts.join(groups.select("cell_id", "group"), "cell_id").groupBy("sample", "group", "gene").agg(
        F.sum("n").alias("obs"))
    per = cut(per, "by_group")
    umi = per.groupBy("sample", "group").agg(F.sum("obs").alias("umi"))
    t = per.join(umi, ["sample", "group"]).join(rho.select("sample", "rho"), "sample").join(
        profile.select("sample", "gene", "est"), ["sample", "gene"])
    t = t.withColumn("p", poisson_tail("obs", F.col("umi") * F.col("est") * F.col("rho")))
    # tails that differ by rounding only go by gene
    ordered = numbered(t.withColumn("down", -F.round("p", 9)), ["down", "gene"], ["sample", "group"], "at", part="part")
    t = running_sum_before(ordered, F.col("obs").cast("double"), ["sample", "group"], "at", "part", "before")
    t = t.withColumn("p_all", poisson_tail("before", F.col("umi") * F.col("rho")))
    pp = F.col("p") * F.col("p_all")
    t = t.withColumn("q", F.when(pp > 0, pp * (1 - F.ln(pp))).otherwise(0.0))
    return t.select("sample", "group", "gene", "obs", "p", "q", (F.col("q") < cutoff).alias("keep"))


def remove_ambient(
    counts: DataFrame, groups: DataFrame, profile: DataFrame, rho: DataFrame, cutoff: float = 0.01
) -> DataFrame:
    """Corrected counts: a gene's counts go from all cells of a group where
    the test explains them by background alone, and stay whole elsewhere, so
    counts remain whole numbers."""
    keep = ambient_genes(counts, groups, profile, rho, cutoff).where("keep").select("sample", "group", "gene")
    return counts.join(groups.select("cell_id", "group"), "cell_id").join(
        keep, ["sample", "group", "gene"], "left_semi").select("sample", "cell_id", "gene", "n")
