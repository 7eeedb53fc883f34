"""Gene-set scores, cell-cycle phase, lineage calls and marker ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions.order import average_ranks, quantiles
from stipple.functions.stats import normal_two_sided
from stipple.operators.composition import bh
from stipple.operators.normalize import gene_moments
from stipple.session import cut


def score_genes(
    expr: DataFrame, cells: DataFrame, gene_sets: DataFrame, n_bins: int = 25, ctrl: int = 50,
    seed: int = 0,
) -> DataFrame:
    """Mean of the set minus mean of control genes from the same mean bins.

    All sets are scored in one pass: members weigh 1/size and controls
    -1/size, so a score is one weighted sum per cell.  Controls are the first
    ``ctrl`` genes of each bin in a seeded hash order.  Returns
    ``cell_id, set_name, score`` for every cell and set with a known gene.
    """
    means = gene_moments(expr, cells).select("gene", F.round("mean", 9).alias("m"))
    ranked = average_ranks(means, [], "m", extra=[F.collect_list("gene").alias("genes")])
    items = F.greatest(F.lit(1), F.bround(F.col("group_n") / float(n_bins - 1)).cast("int"))
    low_rank = F.col("rank") - (F.col("ties") - 1) / 2
    bins = cut(ranked.select(  # one row per gene, read twice
        F.explode("genes").alias("gene"), F.floor(low_rank / items).alias("bin")
    ), "bins")
    order = Window.partitionBy("bin").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "gene")))
    pool = bins.withColumn("_o", F.row_number().over(order)).where(F.col("_o") <= ctrl)

    members = cut(gene_sets.select("set_name", "gene").distinct().join(bins, "gene"), "members")
    controls = (
        members.select("set_name", "bin").distinct()
        .join(pool.select("bin", "gene"), "bin")
        .join(members.select("set_name", "gene"), ["set_name", "gene"], "left_anti")
    )
    both = members.select("set_name", "gene", F.lit(1.0).alias("side")).unionByName(
        controls.select("set_name", "gene", F.lit(-1.0).alias("side"))
    )
    size = F.count(F.lit(1)).over(Window.partitionBy("set_name", "side"))
    weights = both.withColumn("w", F.col("side") / size)
    sums = (
        expr.join(weights, "gene").groupBy("cell_id", "set_name")
        .agg(F.sum(F.col("value") * F.col("w")).alias("score"))
    )
    names = members.agg(F.sort_array(F.collect_set("set_name")).alias("_sets"))  # one row
    grid = cells.select("cell_id").join(F.broadcast(names)).select(
        "cell_id", F.explode("_sets").alias("set_name")
    )
    return grid.join(sums, ["cell_id", "set_name"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


def score_cell_cycle(
    expr: DataFrame, cells: DataFrame, s_genes: Sequence[str] | DataFrame, g2m_genes: Sequence[str] | DataFrame,
    seed: int = 0, n_bins: int = 25,
) -> DataFrame:
    """``cell_id, s_score, g2m_score``; controls per bin = the smaller set.
    A set is a list of names or a table with a column ``gene``."""

    def named(genes: Sequence[str] | DataFrame, name: str) -> DataFrame:
        if not isinstance(genes, DataFrame):
            genes = expr.sparkSession.createDataFrame([(g,) for g in genes], "gene string")
        return genes.select(F.lit(name).alias("set_name"), "gene").distinct()

    sets = cut(named(s_genes, "S").unionByName(named(g2m_genes, "G2M")), "sets")
    sizes = sets.agg(*[F.count_if(F.col("set_name") == name) for name in ("S", "G2M")]).first()
    ctrl = min(sizes)
    long = score_genes(expr, cells, sets, n_bins=n_bins, ctrl=ctrl, seed=seed)
    return long.groupBy("cell_id").agg(
        F.max(F.when(F.col("set_name") == "S", F.col("score"))).alias("s_score"),
        F.max(F.when(F.col("set_name") == "G2M", F.col("score"))).alias("g2m_score"),
    )


def phase(cells: DataFrame, s: str = "s_score", g2m: str = "g2m_score",
          g1_if_both_negative: bool = False) -> DataFrame:
    """S or G2M by the larger score, G1 on exact ties (and, if asked, when
    both scores are negative)."""
    call = F.when(F.col(s) > F.col(g2m), "S").when(F.col(g2m) > F.col(s), "G2M").otherwise("G1")
    if g1_if_both_negative:
        call = F.when((F.col(s) < 0) & (F.col(g2m) < 0), "G1").otherwise(call)
    return cells.withColumn("phase", call)


def dominant(
    scores: DataFrame, cells: DataFrame, panel_order: Sequence[str], cluster: str = "cluster"
) -> DataFrame:
    """Per cluster the set with the largest mean score (first in
    ``panel_order`` on ties), ``Unassigned`` for clusters without scores."""
    rank = F.array_position(F.array(*[F.lit(p) for p in panel_order]), F.col("set_name"))
    means = (
        scores.join(cells.select("cell_id", cluster), "cell_id")
        .groupBy(cluster, "set_name").agg(F.avg("score").alias("mean_score"))
        .withColumn("_o", rank)
    )
    best = means.groupBy(cluster).agg(
        F.max_by(F.struct("set_name", "mean_score"), F.struct(F.col("mean_score"), -F.col("_o"))).alias("_b")
    ).select(cluster, F.col("_b.set_name").alias("lineage"), F.col("_b.mean_score").alias("mean_score"))
    return cells.select(cluster).distinct().join(best, cluster, "left").withColumn(
        "lineage", F.coalesce("lineage", F.lit("Unassigned"))
    )


def rank_genes(
    expr: DataFrame, cells: DataFrame, cluster: str = "cluster", n_genes: int | None = 20,
) -> DataFrame:
    """One-vs-rest rank-sum test per cluster and gene, best ``n_genes`` each.

    Values must be >= 0.  The zeros of a gene share one average rank in closed
    form; only non-zero values are ranked, distributed over (gene, value
    slice), so a gene present in every cell is never sorted in one task.
    """
    bad = F.raise_error(F.lit("rank_genes needs values >= 0"))
    nz = (
        expr.where("value != 0")
        .withColumn("value", F.when(F.col("value") > 0, F.col("value")).otherwise(bad.cast("double")))
        .join(cells.select("cell_id", F.col(cluster).alias("cluster")), "cell_id")
    )
    by_value = cut(nz.groupBy("gene", "value", "cluster").agg(F.count(F.lit(1)).alias("c")), "values")
    ranks = average_ranks(by_value, ["gene"], "value", weight="c").select(
        "gene", "value", "rank", F.col("group_n").alias("nz")
    )
    per = cut(
        by_value.join(ranks, ["gene", "value"])
        .groupBy("gene", "cluster")
        .agg(
            F.sum(F.col("c") * F.col("rank")).alias("rank_sum"),
            F.sum("c").alias("nz_c"),
            F.sum(F.col("c") * F.col("value")).alias("sum_c"),
            F.max("nz").alias("nz"),
        ),
        "per_gene",
    )
    gene_all = per.groupBy("gene").agg(F.max("nz").alias("nz"), F.sum("sum_c").alias("sum_all"))
    sizes = cells.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).cast("double").alias("n_c"))
    sizes = sizes.agg(
        F.collect_list(F.struct("cluster", "n_c")).alias("_cl"), F.sum("n_c").alias("n"))  # one row
    grid = gene_all.join(F.broadcast(sizes)).select(
        "gene", "nz", "sum_all", "n", F.explode("_cl").alias("_c")
    ).select("gene", "nz", "sum_all", "n", "_c.cluster", "_c.n_c")
    full = grid.join(per.drop("nz"), ["gene", "cluster"], "left").fillna(
        0, ["rank_sum", "nz_c", "sum_c"])
    n0 = F.col("n") - F.col("nz")
    w = F.col("rank_sum") + F.col("nz_c") * n0 + (F.col("n_c") - F.col("nz_c")) * (n0 + 1) / 2
    sd = F.sqrt(F.col("n_c") * (F.col("n") - F.col("n_c")) * (F.col("n") + 1) / 12)
    mean_c = F.col("sum_c") / F.col("n_c")
    mean_r = F.try_divide(F.col("sum_all") - F.col("sum_c"), F.col("n") - F.col("n_c"))
    lfc = F.log2((F.expm1(mean_c) + 1e-9) / (F.expm1(mean_r) + 1e-9))
    scored = full.select(
        "cluster", "gene",
        F.try_divide(w - F.col("n_c") * (F.col("n") + 1) / 2, sd).alias("z"),
        lfc.alias("logfoldchange"),
    ).withColumn("pvalue", normal_two_sided("z"))
    scored = bh(scored, "pvalue", by=["cluster"], tie=["gene"])
    if n_genes is None:
        return scored
    order = Window.partitionBy("cluster").orderBy(F.desc("z"), "gene")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_genes)


def unique_top(rank_table: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One gene per cluster, greedy in cluster order (ids that are numbers by
    their value, before the others); a cluster whose genes are all taken falls
    back to its first.

    Input is the top-k table (clusters x k rows); the greedy pass over it is
    sequential by definition and runs as one fold inside one row.
    """
    lists = rank_table.groupBy(cluster).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "gene"))), lambda s: s["gene"]).alias("genes")
    )
    ordered = lists.agg(
        F.sort_array(F.collect_list(F.struct(
            F.coalesce(F.col(cluster).try_cast("double"), F.lit(float("inf"))).alias("number"),
            F.col(cluster).alias("cluster"), "genes"))).alias("_l")
    )
    empty = F.array().cast("array<struct<cluster:string,gene:string>>")
    folded = F.aggregate(
        "_l", empty,
        lambda acc, x: F.concat(acc, F.array(F.struct(
            x["cluster"].cast("string").alias("cluster"),
            F.coalesce(
                F.get(F.filter(x["genes"], lambda g: ~F.exists(acc, lambda a: a["gene"] == g)), F.lit(0)),
                F.get(x["genes"], F.lit(0)),
            ).alias("gene"),
        ))),
    )
    return ordered.select(F.explode(folded).alias("r")).select(
        F.col("r.cluster").alias(cluster), F.col("r.gene").alias("gene")
    )


def marker_summary(
    expr: DataFrame, cells: DataFrame, gene_sets: DataFrame, cluster: str = "cluster"
) -> DataFrame:
    """Mean, detection fraction and 99th percentile cap of each panel gene per
    cluster, zeros included (the zero block of a gene is one weighted row)."""
    markers = gene_sets.select("gene").distinct()
    sub = cut(expr.join(markers, "gene", "left_semi").where("value != 0"), "markers")
    lab = cells.select("cell_id", cluster)
    sizes = lab.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_c"))
    per = sub.join(lab, "cell_id").groupBy(cluster, "gene").agg(
        F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("c")
    )
    total = cells.agg(F.count(F.lit(1)).alias("_n"))
    zeros = sub.groupBy("gene").agg(F.count(F.lit(1)).alias("_nz")).join(F.broadcast(total)).select(
        "gene", F.lit(0.0).alias("value"), (F.col("_n") - F.col("_nz")).alias("w")
    )
    weighted = sub.select("gene", "value", F.lit(1).cast("bigint").alias("w")).unionByName(zeros)
    caps = quantiles(weighted, ["gene"], ["value"], {"p99": 0.99}, weight="w").select("gene", "p99")
    seen = sub.select("gene").distinct()
    grid = gene_sets.select("set_name", "gene").distinct().join(seen, "gene", "left_semi")
    all_sizes = sizes.agg(F.collect_list(F.struct(cluster, "n_c")).alias("_s"))  # one row
    grid = grid.join(F.broadcast(all_sizes)).select(
        "set_name", "gene", F.explode("_s").alias("_x")
    ).select("set_name", "gene", f"_x.{cluster}", "_x.n_c")
    return (
        grid.join(per, [cluster, "gene"], "left").join(caps, "gene", "left")
        .select(
            cluster, "set_name", "gene",
            (F.coalesce("s", F.lit(0.0)) / F.col("n_c")).alias("mean"),
            (F.coalesce("c", F.lit(0)) / F.col("n_c")).alias("fraction"),
            "p99",
        )
    )


def tf_shift(
    expr: DataFrame, cells: DataFrame, targets: DataFrame, ref: str = "WT", test: str = "KO",
    by: str | None = None,
) -> DataFrame:
    """test - ref mean of each target gene, zeros included, 0 when absent."""
    keys = [by] if by else []
    lab = cells.select("cell_id", "condition", *keys)
    sizes = lab.groupBy(*keys).agg(
        F.count_if(F.col("condition") == ref).alias("n_ref"),
        F.count_if(F.col("condition") == test).alias("n_test"),
    )
    sums = (
        expr.join(targets.select("gene").distinct(), "gene", "left_semi")
        .join(lab, "cell_id").groupBy("gene", *keys)
        .agg(
            F.sum(F.when(F.col("condition") == ref, F.col("value")).otherwise(0.0)).alias("s_ref"),
            F.sum(F.when(F.col("condition") == test, F.col("value")).otherwise(0.0)).alias("s_test"),
        )
    )
    rows = sizes.agg(F.collect_list(F.struct(*keys, "n_ref", "n_test")).alias("_z"))  # one row
    grid = targets.select("gene").distinct().join(F.broadcast(rows)).select(
        "gene", F.explode("_z").alias("_g")
    ).select("gene", *[f"_g.{k}" for k in keys], "_g.n_ref", "_g.n_test")
    fc = F.try_divide(F.col("s_test"), F.col("n_test")) - F.try_divide(F.col("s_ref"), F.col("n_ref"))
    return grid.join(sums, ["gene", *keys], "left").select(
        "gene", *keys, F.coalesce(fc, F.lit(0.0)).alias("fc")
    ).orderBy("fc", "gene")
