"""Named queries over the supplied tables with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its text for the reference SQL engine."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and widen integers so both engines return equal values."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


#: SQL views of the same matrices as in :mod:`stipple.plans.tables`
CELLS = """cells AS (
  SELECT CAST(c_custkey AS VARCHAR) cell_id, n_name sample,
         CASE WHEN n_regionkey % 2 = 0 THEN 'WT' ELSE 'KO' END condition, c_mktsegment cluster
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
COUNTS = """counts AS (
  SELECT n_name sample, CAST(o_custkey AS VARCHAR) cell_id, CAST(l_partkey AS VARCHAR) gene, SUM(l_quantity) n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
GENES = """genes AS (
  SELECT CAST(p_partkey AS VARCHAR) gene, p_partkey ord, p_name "name", p_brand brand, p_type "type", p_size size,
         regexp_matches(p_name, '^red') mt, regexp_matches(p_name, '^(blue|hot)') ribo,
         regexp_matches(p_name, '^sm[^(p)]') hb
  FROM part)"""
QC = """qc0 AS (
  SELECT cell_id, SUM(n) total_counts, COUNT(*) n_genes_by_counts,
         SUM(CASE WHEN mt THEN n ELSE 0 END) total_counts_mt,
         SUM(CASE WHEN ribo THEN n ELSE 0 END) total_counts_ribo,
         SUM(CASE WHEN hb THEN n ELSE 0 END) total_counts_hb
  FROM counts JOIN genes USING (gene) GROUP BY cell_id),
top20 AS (SELECT cell_id, SUM(n) t FROM (
  SELECT cell_id, n, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY n DESC) rn FROM counts) WHERE rn <= 20
  GROUP BY cell_id),
qc AS (SELECT cells.*, COALESCE(total_counts, 0) total_counts,
  CAST(COALESCE(n_genes_by_counts, 0) AS BIGINT) n_genes_by_counts,
  COALESCE(total_counts_mt, 0) total_counts_mt, COALESCE(total_counts_ribo, 0) total_counts_ribo,
  COALESCE(total_counts_hb, 0) total_counts_hb,
  ln(1 + COALESCE(total_counts, 0)) log1p_total_counts,
  ln(1 + COALESCE(n_genes_by_counts, 0)) log1p_n_genes_by_counts,
  ln(1 + COALESCE(total_counts_mt, 0)) log1p_total_counts_mt,
  ln(1 + COALESCE(total_counts_ribo, 0)) log1p_total_counts_ribo,
  ln(1 + COALESCE(total_counts_hb, 0)) log1p_total_counts_hb,
  100 * total_counts_mt / total_counts pct_counts_mt,
  100 * total_counts_ribo / total_counts pct_counts_ribo,
  100 * total_counts_hb / total_counts pct_counts_hb,
  100 * t / total_counts pct_counts_in_top_20_genes
  FROM cells LEFT JOIN qc0 USING (cell_id) LEFT JOIN top20 USING (cell_id))"""
FLAGGED = """med AS (SELECT sample, median(log1p_total_counts) m1, median(log1p_n_genes_by_counts) m2,
    median(pct_counts_in_top_20_genes) m3 FROM qc GROUP BY sample),
mads AS (SELECT sample, median(abs(log1p_total_counts - m1)) d1, median(abs(log1p_n_genes_by_counts - m2)) d2,
    median(abs(pct_counts_in_top_20_genes - m3)) d3 FROM qc JOIN med USING (sample) GROUP BY sample),
flagged AS (SELECT qc.*, COALESCE(
    log1p_total_counts < m1 - 3 * d1 OR log1p_total_counts > m1 + 3 * d1 OR
    log1p_n_genes_by_counts < m2 - 3 * d2 OR log1p_n_genes_by_counts > m2 + 3 * d2 OR
    pct_counts_in_top_20_genes < m3 - 3 * d3 OR pct_counts_in_top_20_genes > m3 + 3 * d3, FALSE) outlier,
    COALESCE(pct_counts_mt > 20, FALSE) mt_outlier
  FROM qc JOIN med USING (sample) JOIN mads USING (sample))"""
NORM = """totals AS (SELECT sample, cell_id, SUM(n) total FROM counts GROUP BY ALL),
targets AS (SELECT sample, median(total) target FROM totals GROUP BY sample),
norm AS (SELECT cell_id, gene, ln(1 + n * (target / total)) "value"
  FROM counts JOIN totals USING (sample, cell_id) JOIN targets USING (sample))"""
VECTORS = """vectors AS (
  SELECT vec_id cell_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) vec,
         CAST(label AS VARCHAR) cluster, CASE WHEN vec_id % 2 = 0 THEN 'WT' ELSE 'KO' END condition
  FROM embeddings)"""
TOKENS = """counts AS (
  SELECT source sample, CAST(doc_id AS VARCHAR) cell_id, gene, CAST(COUNT(*) AS DOUBLE) n FROM (
    SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) gene FROM documents) GROUP BY ALL),
cells AS (SELECT CAST(doc_id AS VARCHAR) cell_id, source sample, lang cluster FROM documents)"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
