"""Canonical tables and the checks made at operator boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


#: sparse counts: a (cell, gene) pair without a row is zero
COUNTS = _struct(sample=_S, cell_id=_S, gene=_S, n=_D)
#: sparse layers of derived values on the same grid
EXPR = _struct(layer=_S, cell_id=_S, gene=_S, value=_D)
#: one row per cell over a fixed gene index, for linear algebra
CELL_VEC = _struct(cell_id=_S, idx=T.ArrayType(_I), val=T.ArrayType(_D))
CELLS = _struct(cell_id=_S, sample=_S, sex=_S, condition=_S)
EMBEDDING = _struct(cell_id=_S, vec=T.ArrayType(_D))
#: directed nearest-neighbour edges
KNN = _struct(src=_S, dst=_S, dist=_D, rank=_I)
#: symmetric weighted graph, both directions present
GRAPH = _struct(src=_S, dst=_S, weight=_D)
REGULON = _struct(db=_S, tf=_S, target=_S, weight=_D)
GENE_SETS = _struct(set_name=_S, ord=_I, gene=_S)
LABEL_MAP = _struct(cluster=_S, name=_S, ord=_I, fate=_S)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail early, at plan time, when a needed column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df
