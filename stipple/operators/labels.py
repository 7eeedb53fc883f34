"""Labels, lookups, membership and sample selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decode(df: DataFrame, column: str, mapping: dict, alias: str) -> DataFrame:
    """Translate codes; codes outside ``mapping`` become null."""
    lookup = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return df.withColumn(alias, F.try_element_at(lookup, F.col(column)))


def exclude(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def filter_samples(
    cells: DataFrame, min_cells: int, deny: Sequence[str] = (), sample: str = "sample"
) -> DataFrame:
    """Cells of samples with at least ``min_cells`` cells and not denied."""
    big = (
        cells.groupBy(sample).agg(F.count(F.lit(1)).alias("_c"))
        .where(F.col("_c") >= min_cells).select(sample)
    )
    if deny:
        big = big.where(~F.col(sample).isin(*deny))
    return cells.join(big, sample, "left_semi")


def apply_labels(
    cells: DataFrame, label_map: DataFrame, cluster: str = "cluster", alias: str = "cluster_name"
) -> DataFrame:
    """Cluster id -> name in a fixed order.

    An id without a name falls back to the id itself, and a name outside the
    fixed order (no ``ord``) then becomes null, as in an ordered categorical.
    """
    m = label_map.select(
        F.col("cluster").alias("_k"), F.col("name").alias("_name"), F.col("ord").alias("_ord")
    )
    order = label_map.where(F.col("ord").isNotNull()).select(
        F.col("name").alias("_valid"), F.col("ord").alias(f"{alias}_ord")
    ).distinct()
    named = cells.join(m, F.col(cluster) == F.col("_k"), "left").withColumn(
        "_n", F.coalesce("_name", F.col(cluster).cast("string"))
    )
    return (
        named.join(order, F.col("_n") == F.col("_valid"), "left")
        .withColumn(alias, F.col("_valid"))
        .drop("_k", "_name", "_ord", "_n", "_valid")
    )


def apply_fate(
    cells: DataFrame, label_map: DataFrame, name: str = "cluster_name",
    categories: Sequence[str] | None = None,
) -> DataFrame:
    """Name -> fate group, ``unknown`` when unmapped; fates outside
    ``categories`` (when given) become null."""
    m = label_map.where(F.col("fate").isNotNull()).select(
        F.col("name").alias("_k"), F.col("fate").alias("_fate")
    ).distinct()
    out = cells.join(m, F.col(name) == F.col("_k"), "left").withColumn(
        "fate_group", F.coalesce("_fate", F.lit("unknown"))
    )
    if categories is not None:
        out = out.withColumn(
            "fate_group", F.when(F.col("fate_group").isin(*categories), F.col("fate_group"))
        )
    return out.drop("_k", "_fate")


def present(gene_sets: DataFrame, genes: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Gene-set rows whose gene exists; optionally matched without case,
    taking the spelling of the data."""
    if not ignore_case:
        return gene_sets.join(genes.select("gene").distinct(), "gene", "left_semi")
    known = genes.select(F.col("gene").alias("_g")).distinct().withColumn("_l", F.lower("_g"))
    return (
        gene_sets.join(known, F.lower("gene") == F.col("_l"))
        .withColumn("gene", F.col("_g")).drop("_g", "_l")
    )


def sets_present(gene_sets: DataFrame, genes: DataFrame) -> DataFrame:
    """Per set: size, genes present, and whether it can be scored."""
    found = genes.select("gene").distinct().withColumn("_hit", F.lit(1))
    return (
        gene_sets.join(found, "gene", "left").groupBy("set_name")
        .agg(F.count(F.lit(1)).alias("n_genes"), F.count("_hit").alias("n_present"))
        .withColumn("scorable", F.col("n_present") > 0)
    )


def cells_expressing(expr: DataFrame, cells: DataFrame, genes: Sequence[str], value: str = "value") -> DataFrame:
    """Cells with a positive value for any of ``genes``."""
    hit = expr.where((F.col(value) > 0) & F.col("gene").isin(*genes)).select("cell_id")
    return cells.join(hit, "cell_id", "left_semi")


def head_per_group(gene_sets: DataFrame, k: int) -> DataFrame:
    """First ``k`` genes of every set, then each gene once."""
    w = Window.partitionBy("set_name").orderBy("ord")
    return (
        gene_sets.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
        .select("gene").distinct()
    )


def split_conditions(df: DataFrame, column: str = "condition", both: str = "all") -> DataFrame:
    """Every row under its condition and once more under ``both``.

    One pass over the input: rows are duplicated in place, so a following
    ``groupBy('panel')`` yields the per-condition and pooled panels together.
    """
    return df.withColumn("panel", F.explode(F.array(F.col(column), F.lit(both))))


def save_layer(expr: DataFrame, source: str, name: str) -> DataFrame:
    """All rows plus a copy of layer ``source`` called ``name``."""
    return expr.unionByName(
        expr.where(F.col("layer") == source).withColumn("layer", F.lit(name))
    )


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """Left lookup of ``value`` by ``key`` with a default for misses."""
    out = df.join(table.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def members(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return df.join(table.select(key), key, "left_semi")


def non_members(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return df.join(table.select(key), key, "left_anti")


def sample_meta(cells: DataFrame, sample: str = "sample", condition: str = "condition") -> DataFrame:
    """One row per sample; fails the job when a sample has two conditions."""
    meta = cells.groupBy(sample).agg(
        F.min(condition).alias(condition), F.max(condition).alias("_other")
    )
    bad = F.raise_error(F.concat(F.lit("sample with two conditions: "), F.col(sample)))
    return meta.withColumn(
        condition,
        F.when(F.col(condition).eqNullSafe(F.col("_other")), F.col(condition)).otherwise(
            bad.cast("string")),
    ).drop("_other")


def concat_samples(parts: Sequence[DataFrame], key: str = "sample") -> DataFrame:
    """Stack samples; columns a part lacks become null, and cell ids get the
    ``-<sample>`` suffix so they are unique.  In long form the union of genes
    needs no join: a gene absent from a sample simply has no rows there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("cell_id", F.concat_ws("-", "cell_id", key))


def gene_overlap(counts: DataFrame) -> DataFrame:
    """Sum of per-sample gene counts against distinct genes overall."""
    pairs = counts.select("sample", "gene").distinct()
    per_gene = pairs.groupBy("gene").agg(F.count(F.lit(1)).alias("_s"))
    return per_gene.agg(
        F.sum("_s").alias("sum_of_genes"), F.count(F.lit(1)).alias("unique_genes")
    )


def combine_regulons(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack sources in priority order; each target keeps its first source."""
    out = None
    for i, p in enumerate(parts):
        p = p.select("target", "weight").withColumn("_priority", F.lit(i))
        out = p if out is None else out.unionByName(p)
    first = F.min_by(F.struct("weight"), F.struct("_priority", "weight"))
    return out.groupBy("target").agg(first.alias("_f")).select("target", "_f.weight")


def repressed(regulon: DataFrame) -> DataFrame:
    return regulon.where(F.col("weight") < 0)
