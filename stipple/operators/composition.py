"""Compositional tests between conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions.order import average_ranks, median, numbered, running_min_from_end
from stipple.functions.stats import mann_whitney_p, student_t_p, student_t_upper
from stipple.operators.labels import sample_meta
from stipple.session import cut
from stipple.operators.summary import crosstab, gate


def bh(
    df: DataFrame, p: str = "pvalue", alpha: float = 0.05, by: Sequence[str] = (),
    tie: Sequence[str] = (),
) -> DataFrame:
    """Benjamini-Hochberg ``padj`` and ``significant`` within each ``by`` group.

    Any number of tests: they are numbered over ranges of p-values, and the
    running minimum from the largest p-value is carried from range to range.
    ``tie`` orders equal p-values and lets a frequent one spread over ranges.
    A null p-value is not a test: its ``padj`` and ``significant`` are null.
    """
    ranked = numbered(df.where(F.col(p).isNotNull()), [p, *tie], by, "_rank", size="_m", part="_part")
    q = F.col(p) * F.col("_m") / (F.col("_rank") + 1)
    tests = running_min_from_end(ranked, q, by, "_rank", "_part", "_q").withColumn(
        "padj", F.least(F.lit(1.0), "_q")).drop("_rank", "_m", "_part", "_q")
    untested = df.where(F.col(p).isNull()).withColumn("padj", F.lit(None).cast("double"))
    return tests.unionByName(untested).withColumn("significant", F.col("padj") < alpha)


def significant(df: DataFrame, key: str = "cluster") -> DataFrame:
    return df.where("significant").select(key)


def proportions(cells: DataFrame, sample: str = "sample", cluster: str = "cluster") -> DataFrame:
    """Share of each cluster in each sample, zeros present."""
    total = F.sum("n").over(Window.partitionBy(sample))
    return crosstab(cells, sample, cluster).withColumn("sample_n", total).withColumn(
        "proportion", F.col("n") / F.col("sample_n")
    )


def clr(props: DataFrame, sample: str = "sample") -> DataFrame:
    """Centred log-ratio with one pseudo-count, half over the mean sample size."""
    eps = props.select(sample, "sample_n").distinct().agg(
        (F.lit(0.5) / F.avg("sample_n")).alias("_eps")
    )
    logp = F.ln(F.col("proportion") + F.col("_eps"))
    return (
        props.join(F.broadcast(eps))  # one row
        .withColumn("_l", logp)
        .withColumn("clr", F.col("_l") - F.avg("_l").over(Window.partitionBy(sample)))
        .drop("_l", "_eps")
    )


def welch(
    clr_table: DataFrame, meta: DataFrame, cluster: str = "cluster", sample: str = "sample",
    ref: str = "WT", test: str = "KO", min_samples: int = 2,
) -> DataFrame:
    """Welch t-test per cluster over samples.

    The p-value uses the Welch degrees of freedom and the interval the pooled
    ones (n1 + n2 - 2); both are reported.
    """
    x = clr_table.join(meta, sample)

    def side(label: str, cond: str) -> list:
        v = F.when(F.col("condition") == cond, F.col("clr"))
        return [F.count(v).alias(f"n_{label}"), F.avg(v).alias(f"m_{label}"), F.var_samp(v).alias(f"v_{label}")]

    g = x.groupBy(cluster).agg(*side("r", ref), *side("t", test)).where(
        (F.col("n_r") >= min_samples) & (F.col("n_t") >= min_samples)
    )
    a, b = F.col("v_r") / F.col("n_r"), F.col("v_t") / F.col("n_t")
    g = g.withColumns({
        "effect": F.col("m_t") - F.col("m_r"),
        "se": F.sqrt(a + b),
        "df_welch": F.try_divide(
            (a + b) * (a + b), a * a / (F.col("n_r") - 1) + b * b / (F.col("n_t") - 1)),
        "df_pooled": (F.col("n_r") + F.col("n_t") - 2).cast("double"),
    }).withColumn("t", F.try_divide("effect", "se"))
    half = student_t_upper("df_pooled") * F.col("se")
    return g.withColumns({
        "ci_lo": F.col("effect") - half,
        "ci_hi": F.col("effect") + half,
        # samples that do not vary at all are apart for certain
        "pvalue": F.when((F.col("se") == 0) & (F.col("effect") != 0), 0.0).otherwise(student_t_p("t", "df_welch")),
    }).select(cluster, "effect", "se", "t", "df_welch", "df_pooled", "ci_lo", "ci_hi", "pvalue")


def compositional_shift(
    cells: DataFrame, cluster: str = "cluster", ref: str = "WT", test: str = "KO", alpha: float = 0.05
) -> DataFrame:
    """Proportions, CLR, Welch test and BH in one call, sorted by effect."""
    table = clr(proportions(cells, "sample", cluster))
    tests = welch(table, sample_meta(cells), cluster, ref=ref, test=test)
    return bh(tests, "pvalue", alpha, tie=[cluster]).orderBy("effect", cluster)


def mann_whitney(
    df: DataFrame, by: str, value: str, ref: str = "WT", test: str = "KO", min_n: int = 5,
    condition: str = "condition",
) -> DataFrame:
    """Two-sided Mann-Whitney U of test against ref per group, with medians."""
    df = cut(df.select(by, condition, value), "values")  # read three times
    ok = gate(df, by, condition, ref, test, min_n)
    data = df.where(F.col(condition).isin(ref, test)).join(ok.select(by), by, "left_semi")
    is_test = F.count_if(F.col(condition) == test).alias("_t")
    ranks = average_ranks(data, [by], value, extra=[is_test])
    g = ranks.groupBy(by).agg(
        F.sum(F.col("_t") * F.col("rank")).alias("rank_sum"),
        F.sum("_t").cast("double").alias("n2"),
        F.max("group_n").cast("double").alias("n"),
        F.sum(F.pow(F.col("ties").cast("double"), 3) - F.col("ties")).alias("tie"),
    ).withColumn("n1", F.col("n") - F.col("n2"))
    u = F.col("rank_sum") - F.col("n2") * (F.col("n2") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12 * (
        (F.col("n") + 1) - F.try_divide(F.col("tie"), F.col("n") * (F.col("n") - 1)))
    dev = F.greatest(u, F.col("n1") * F.col("n2") - u) - F.col("n1") * F.col("n2") / 2 - 0.5
    g = g.withColumns({"u": u, "z": F.try_divide(dev, F.sqrt(var))})
    g = g.withColumn("pvalue", F.least(F.lit(1.0), F.when(
        F.col("z") < 0, 1.0).otherwise(mann_whitney_p("u", "z", "n1", "n2", F.col("tie") > 0))))
    med = median(data.withColumn("_c", F.col(condition)), [by, "_c"], value)
    med = med.groupBy(by).agg(
        F.max(F.when(F.col("_c") == ref, F.col("median"))).alias("median_ref"),
        F.max(F.when(F.col("_c") == test, F.col("median"))).alias("median_test"),
    )
    return g.join(med, by).select(by, "n1", "n2", "u", "z", "pvalue", "median_ref", "median_test")


def plot_order(df: DataFrame, by: str, value: str, sig: DataFrame) -> DataFrame:
    """Groups ordered by median, non-significant ones first."""
    med = median(df, [by], value)
    flagged = med.join(sig.select(by, F.lit(True).alias("significant")), by, "left").withColumn(
        "significant", F.coalesce("significant", F.lit(False))
    )
    w = Window.orderBy("significant", "median", by)  # one row per group
    return flagged.withColumn("position", F.row_number().over(w))
