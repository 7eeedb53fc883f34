"""Prior-knowledge regulons from files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.schema import REGULON

#: confidence levels kept by default
LEVELS = ("A", "B", "C")


def from_wide(df: DataFrame, db: str, gene: str = "gene", tfs: Sequence[str] | None = None) -> DataFrame:
    """Genes x regulators matrix -> ``db, tf, target, weight`` of its non-zero
    cells.  Name the regulators wanted to read only their columns."""
    tfs = list(tfs) if tfs else [c for c in df.columns if c != gene]
    return (
        df.select(gene, *[F.col(f"`{t}`").cast("double").alias(t) for t in tfs])
        .unpivot([gene], tfs, "tf", "weight").where("weight <> 0")
        .select(F.lit(db).alias("db"), "tf", F.col(gene).alias("target"), "weight")
    )


def from_long(df: DataFrame, db: str, source: str = "source", levels: Sequence[str] | None = None) -> DataFrame:
    """``source, target, weight [, level]`` -> regulon rows."""
    if levels is not None:
        df = df.where(F.col("level").isin(*levels))
    return df.select(
        F.lit(db).alias("db"), F.col(source).alias("tf"), "target", F.col("weight").cast("double").alias("weight")
    )


def read_regulon(
    spark: SparkSession, path: str, db: str, layout: str = "long", fmt: str = "parquet",
    levels: Sequence[str] | None = LEVELS, tfs: Sequence[str] | None = None,
) -> DataFrame:
    """Read a regulon file; a missing source gives an empty table."""
    reader = spark.read.option("header", True)
    try:
        df = reader.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REGULON)
    if layout == "wide":
        return from_wide(df, db, tfs=tfs)
    return from_long(df, db, levels=levels if "level" in df.columns else None)
