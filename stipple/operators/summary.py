"""Group summaries: describe, histograms, quartiles, counts, compositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions.order import quantiles
from stipple.session import cut


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max: one row per column."""
    by = list(by)
    df = cut(df.select(*by, *columns), "describe")  # read twice below
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns
    ])
    moments = (
        df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.metric", "p.v")
        .groupBy(*by, "metric")
        .agg(
            F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
            F.min("v").alias("min"), F.max("v").alias("max"),
        )
    )
    q = quantiles(df, by, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("n")
    return moments.join(q, [*by, "metric"], "left")


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Equal-width bins over the range; the maximum falls in the last bin."""
    df = cut(df.select(column), "histogram")  # read twice below
    x = F.col(column).cast("double")
    span = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / float(bins)
    b = F.least(
        F.floor(F.try_divide(x - F.col("_lo"), width)), F.lit(bins - 1).cast("bigint")
    )
    counted = (
        df.where(x.isNotNull()).join(F.broadcast(span))  # one row
        .groupBy(F.coalesce(b, F.lit(0).cast("bigint")).alias("bin"), "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("left"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("right"),
        "n",
    )


def group_quartiles(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    return quantiles(df, by, [column], {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("metric")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def n_clusters(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct labels and whether a silhouette is defined (1 < k < n)."""
    sizes = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_c"))
    return sizes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_clusters"), F.sum("_c").alias("n_cells")
    ).withColumn("valid", (F.col("n_clusters") > 1) & (F.col("n_clusters") < F.col("n_cells")))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of every (a, b) combination, zeros included, in long form.

    Only the distinct labels of ``a`` and ``b`` meet, never their rows.
    """
    seen = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    labels = seen.agg(F.collect_set(a).alias("_a"), F.collect_set(b).alias("_b"))
    grid = labels.select(F.explode("_a").alias(a), "_b").select(a, F.explode("_b").alias(b))
    return grid.join(seen, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def composition(df: DataFrame, cluster: str, by: str) -> DataFrame:
    """Share of each ``by`` label inside every cluster; missing is zero."""
    total = F.sum("n").over(Window.partitionBy(cluster))
    return crosstab(df, cluster, by).withColumn("proportion", F.col("n") / total)


def centroids(embedding: DataFrame, labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean coordinate per cluster and dimension (combined map-side)."""
    return (
        embedding.select("cell_id", "vec").join(labels.select("cell_id", cluster), "cell_id")
        .select(cluster, F.posexplode("vec").alias("dim", "x"))
        .groupBy(cluster, "dim").agg(F.avg("x").alias("mean"))
    )


def layer_sums(expr: DataFrame, layer: str | None = None) -> DataFrame:
    e = expr if layer is None else expr.where(F.col("layer") == layer)
    return e.groupBy("cell_id").agg(F.sum("value").alias("layer_sum"))


def gate(df: DataFrame, by: str, condition: str, ref: str, test: str, min_n: int) -> DataFrame:
    """Groups with at least ``min_n`` rows on each side."""
    return df.groupBy(by).agg(
        F.count_if(F.col(condition) == ref).alias("n_ref"),
        F.count_if(F.col(condition) == test).alias("n_test"),
    ).where((F.col("n_ref") >= min_n) & (F.col("n_test") >= min_n))
