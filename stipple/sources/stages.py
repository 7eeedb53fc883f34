"""Stages: named sets of Parquet tables passed between analysis steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: partition columns used when a table has them
PARTITIONED = ("layer",)


def write_stage(root: str, name: str, tables: dict[str, DataFrame]) -> str:
    """Write every table of a stage; layered tables are partitioned by layer
    so a reader of one layer touches only its files."""
    for table, df in tables.items():
        w = df.write.mode("overwrite")
        parts = [c for c in PARTITIONED if c in df.columns]
        if parts:
            w = w.partitionBy(*parts)
        w.parquet(f"{root}/{name}/{table}")
    return f"{root}/{name}"


def read_stage(spark: SparkSession, root: str, name: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/{table}")


def layers(spark: SparkSession, root: str, name: str, table: str = "expr") -> DataFrame:
    """Names of the layers of a stage (a partition column: no data columns
    are read)."""
    return read_stage(spark, root, name, table).select("layer").distinct()


def read_layer(
    spark: SparkSession, root: str, name: str, layer: str, genes: DataFrame | None = None,
    table: str = "expr",
) -> DataFrame:
    """One layer, optionally only some genes; partition pruning picks the
    files and the gene list is a semi join."""
    df = read_stage(spark, root, name, table).where(F.col("layer") == layer).select("cell_id", "gene", "value")
    return df if genes is None else df.join(genes.select("gene"), "gene", "left_semi")


def write_result(df: DataFrame, path: str) -> str:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
