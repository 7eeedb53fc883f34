"""The supplied tables seen as count matrices.

basket:  customer = cell, part = gene, summed quantity = count, nation =
         sample, parity of the region key = condition, market segment = cluster
tokens:  document = cell, word = gene, occurrences = count, source = sample
vectors: embedding = principal components of a cell
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def basket_cells(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("cell_id"),
        F.col("n_name").alias("sample"),
        F.when(F.col("n_regionkey") % 2 == 0, "WT").otherwise("KO").alias("condition"),
        F.col("c_mktsegment").alias("cluster"),
    )


def basket_counts(spark: SparkSession, sf: str) -> DataFrame:
    """sample, cell_id, gene, n.

    Rows travel with the numeric keys and one shuffle by customer serves the
    sums and the join; the names are made at the end.
    """
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    c, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    bought = li.join(o, li.l_orderkey == o.o_orderkey).select("o_custkey", "l_partkey", "l_quantity")
    n = bought.repartition("o_custkey").groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("n"))
    sample = c.join(nation, c.c_nationkey == nation.n_nationkey).select("c_custkey", F.col("n_name").alias("sample"))
    return n.join(sample, n.o_custkey == sample.c_custkey).select(
        "sample", F.col("o_custkey").cast("string").alias("cell_id"), F.col("l_partkey").cast("string").alias("gene"), "n")


def basket_genes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("gene"),
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"), F.col("p_size").alias("size"),
    )


#: flag patterns on part names, standing in for the gene-name prefixes
PART_FLAGS = {"mt": "^red", "ribo": "^(blue|hot)", "hb": "^sm[^(p)]"}

FLAG_COLUMNS = ("mt", "ribo", "hb")


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Word occurrences per document, over whole texts."""
    d = table(spark, sf, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return (
        d.select("source", "doc_id", F.explode(words).alias("gene"))
        .groupBy(F.col("source").alias("sample"), F.col("doc_id").cast("string").alias("cell_id"), "gene")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )


def token_cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("cell_id"), F.col("source").alias("sample"),
        F.col("lang").alias("cluster"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """cell_id (bigint), vec, cluster, condition."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("cell_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").cast("string").alias("cluster"),
        F.when(F.col("vec_id") % 2 == 0, "WT").otherwise("KO").alias("condition"),
    )
