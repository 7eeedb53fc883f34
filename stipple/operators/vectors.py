"""Per-cell vectors: building them and moving them through Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.functions.order import numbered

#: doubles per dense working block inside a task (32 MB)
BLOCK_DOUBLES = 4_000_000


def sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def gene_index(genes: DataFrame) -> DataFrame:
    """``gene, i`` with i = 0.. in gene order, for any number of genes."""
    return numbered(genes.select("gene").distinct(), ["gene"], name="i").withColumn("i", F.col("i").cast("int"))


def cell_vectors(expr: DataFrame, index: DataFrame, value: str = "value",
                 cells: DataFrame | None = None) -> DataFrame:
    """One row per cell: parallel arrays ``idx`` (sorted) and ``val``.

    The arrays are bounded by the number of indexed genes.  With ``cells``
    given, cells without any entry get empty arrays.
    """
    pairs = F.sort_array(F.collect_list(F.struct("i", F.col(value).cast("double").alias("v"))))
    v = expr.join(index, "gene").groupBy("cell_id").agg(pairs.alias("_p")).select(
        "cell_id", F.col("_p.i").alias("idx"), F.col("_p.v").alias("val")
    )
    if cells is not None:
        v = cells.select("cell_id").join(v, "cell_id", "left").select(
            "cell_id",
            F.coalesce("idx", F.array().cast("array<int>")).alias("idx"),
            F.coalesce("val", F.array().cast("array<double>")).alias("val"),
        )
    return v


def _list_matrix(col: pa.Array) -> np.ndarray:
    """Equal-length list column as a 2-D float array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def matrix(table: pa.RecordBatch | pa.Table, column: str = "vec") -> np.ndarray:
    return _list_matrix(table.column(column))


def list_array(m: np.ndarray) -> pa.Array:
    """2-D array as a list<double> column."""
    n, d = m.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * d, type=pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m).ravel(), type=pa.float64()))


def batches(**columns) -> Iterator[pa.RecordBatch]:
    """One record batch; 2-D arrays become list columns."""
    arrays = []
    for v in columns.values():
        if isinstance(v, np.ndarray) and v.ndim == 2:
            v = list_array(v)
        elif not isinstance(v, (pa.Array, pa.ChunkedArray)):
            v = pa.array(v)
        arrays.append(v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v)
    yield pa.RecordBatch.from_arrays(arrays, names=list(columns))
