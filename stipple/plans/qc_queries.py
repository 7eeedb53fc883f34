"""Queries on sources, quality control, labels and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipple.functions import columns as C
from stipple.operators import labels, qc, summary
from stipple.plans import tables as tb
from stipple.plans.registry import CELLS, COUNTS, FLAGGED, GENES, NORM, QC, TOKENS, query, rounded, with_
from stipple.operators.normalize import shifted_log
from stipple.session import Scratch, cut
from stipple.sources import matrix_csv, regulons, stages

BASE = with_(CELLS, COUNTS, GENES, QC)
QC_COLUMNS = ["total_counts", "n_genes_by_counts", "pct_counts_mt", "pct_counts_ribo",
              "pct_counts_hb", "pct_counts_in_top_20_genes"]


def flagged_genes(spark, sf):
    return qc.flag_genes(tb.basket_genes(spark, sf), tb.PART_FLAGS, "name")


def cell_metrics(spark, sf):
    return qc.cell_qc(tb.basket_counts(spark, sf), tb.basket_cells(spark, sf),
                      flagged_genes(spark, sf), tb.FLAG_COLUMNS)


def flagged_cells(spark, sf):
    return qc.qc_flags(cell_metrics(spark, sf), 3, "pct_counts_mt", 20.0)


def norm_layer(spark, sf):
    return shifted_log(cut(tb.basket_counts(spark, sf), "counts"))  # read twice


# ---- sources -------------------------------------------------------------------------------


def write_wide_csv(spark, sf, scratch, spoil: bool = False):
    """The basket matrix as wide text files, one folder per sample, named
    ``<n>_<region>_M_<condition>_qc_norm.csv`` like sample files.

    With ``spoil``, samples whose number leaves 1, 2 or 3 of 7 have an entry
    too many in every line of a gene that ends in 5, a word instead of the first number there, or
    a file name with an unknown condition."""
    cells = tb.basket_cells(spark, sf)
    order = cells.groupBy("sample", "condition").agg(
        F.array_sort(F.collect_list("cell_id")).alias("ids"))
    counts = tb.basket_counts(spark, sf)
    per_gene = counts.groupBy("sample", "gene").agg(
        F.map_from_entries(F.collect_list(F.struct("cell_id", F.col("n").cast("bigint")))).alias("m"))
    # places of the counts; the zeros between them are written at the end, after the shuffle
    found = F.array_sort(F.filter(F.transform(F.map_entries("m"), lambda e: F.struct(
        F.array_position("ids", e["key"]).cast("int").alias("pos"), F.coalesce(e["value"], F.lit(0)).alias("n"))), lambda e: e["pos"] > 0))

    def zeros(n):
        return F.repeat(F.lit(",0"), n)

    before = lambda i: F.coalesce(F.get("found", i - 1)["pos"], F.lit(0))
    pieces = F.transform("found", lambda e, i: F.concat(zeros(e["pos"] - before(i) - 1), F.lit(","), e["n"].cast("string")))
    values = F.concat(F.array_join(pieces, ""), zeros(F.col("n_ids") - before(F.size("found"))))
    line = F.coalesce(F.concat("gene", values), F.substr(values, F.lit(2)))
    number = F.regexp_extract("sample", r"(\d+)", 1)
    condition = F.col("condition")
    if spoil:
        kind = number.cast("int") % 7
        condition = F.when(kind == 3, "XX").otherwise(condition)
        line = F.when(F.col("gene").endswith("5") & (F.col("kind") == 1), F.concat(line, F.lit(",0"))).when(
            F.col("gene").endswith("5") & (F.col("kind") == 2), F.concat(F.col("gene"), F.lit(",many"), zeros(F.col("n_ids") - 1))).otherwise(line)
    name = F.concat_ws("_", number, F.lit("0"), F.lit("M"), condition, F.lit("qc"), F.lit("norm.csv"))
    kept = [name.alias("f"), (number.cast("int") % 7).alias("kind"), F.size("ids").alias("n_ids")]
    body = per_gene.join(order, "sample").select(*kept, F.lit(1).alias("o"), "gene", found.alias("found"), F.lit(None).cast("string").alias("top"))
    head = order.select(*kept, F.lit(0).alias("o"), F.lit("").alias("gene"), F.lit(None).cast(body.schema["found"].dataType).alias("found"),
                        F.concat_ws(",", F.lit("Gene"), F.array_join("ids", ",")).alias("top"))
    path = f"{scratch.root}/wide"
    (body.unionByName(head).repartition("f").sortWithinPartitions("f", "o", "gene")
     .select("f", F.when(F.col("o") == 0, F.col("top")).otherwise(line).alias("value")).write.mode("overwrite").partitionBy("f").text(path))
    return path


@query("csv_matrix_read", with_(CELLS, COUNTS) + """
SELECT sample, condition, gene, COUNT(*) n_cells, ROUND(SUM(n), 6) total
FROM counts JOIN (SELECT cell_id, condition FROM cells) USING (cell_id) GROUP BY ALL""")
def csv_matrix_read(spark, sf):
    path = write_wide_csv(spark, sf, Scratch(spark, "csv"))
    lines = matrix_csv.read_counts(spark, path, folder="f")
    return rounded(lines.groupBy(F.concat(F.lit("NATION_"), F.split_part("sample", F.lit("_"), F.lit(1))).alias("sample"),
                                 "condition", "gene")
                   .agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("total")))


NUMBERED = """num AS (SELECT counts.sample, CAST(regexp_extract(counts.sample, '(\\d+)', 1) AS INT) number, condition, gene, cell_id, n
  FROM counts JOIN (SELECT cell_id, condition FROM cells) USING (cell_id))"""


@query("quarantine", with_(CELLS, COUNTS, NUMBERED) + """SELECT number || '_0_M_' || CASE number % 7 WHEN 3 THEN 'XX' ELSE condition END sample,
CASE number % 7 WHEN 1 THEN 'ragged row' WHEN 2 THEN 'not a number' ELSE 'bad file name' END reason, COUNT(DISTINCT gene) n_lines
FROM num WHERE number % 7 = 3 OR number % 7 IN (1, 2) AND gene LIKE '%5' GROUP BY ALL""")
def quarantine(spark, sf):
    path = write_wide_csv(spark, sf, Scratch(spark, "csv"), spoil=True)
    return rounded(matrix_csv.quarantine(spark, path, folder="f").select("sample", "reason", "n_lines"))


@query("read_samples", with_(CELLS, COUNTS, NUMBERED) + """SELECT number || '_0_M_' || condition sample, 'M' sex, condition, cell_id, COUNT(*) n_genes, ROUND(SUM(n), 6) total
FROM num WHERE number % 7 NOT IN (1, 2, 3) GROUP BY ALL""")
def read_samples(spark, sf):
    path = write_wide_csv(spark, sf, Scratch(spark, "csv"), spoil=True)
    counts, cells, _ = matrix_csv.read_samples(spark, path, folder="f")
    per = counts.groupBy("sample", "cell_id").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("n").alias("total"))
    return rounded(cells.join(per, ["sample", "cell_id"]).select("sample", "sex", "condition", "cell_id", "n_genes", "total"))


@query("sample_fields", """
WITH f AS (SELECT n_nationkey || '_' || n_regionkey || '_' || CASE WHEN n_nationkey % 2 = 0 THEN 'M' ELSE 'F' END
  || '_' || CASE WHEN n_regionkey % 2 = 0 THEN 'WT' ELSE 'KO' END || '_qc_norm.h5ad' f FROM nation)
SELECT f "file", replace(f, '_qc_norm.h5ad', '') sample, split_part(f, '_', 3) sex, split_part(f, '_', 4) condition
FROM f""")
def sample_fields(spark, sf):
    n = tb.table(spark, sf, "nation")
    f = F.concat_ws("_", "n_nationkey", "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, "M").otherwise("F"),
                    F.when(F.col("n_regionkey") % 2 == 0, "WT").otherwise("KO"), F.lit("qc"), F.lit("norm.h5ad"))
    return n.select(f.alias("file")).select("file", *[c.alias(k) for k, c in matrix_csv.sample_fields(F.col("file")).items()])


@query("make_unique", """
SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE p_name || '-' || (rn - 1) END unique_name FROM (
  SELECT p_partkey, p_name, ROW_NUMBER() OVER (PARTITION BY p_name ORDER BY p_partkey) rn FROM part)""")
def make_unique(spark, sf):
    p = tb.table(spark, sf, "part").select("p_partkey", "p_name")
    return matrix_csv.make_unique(p, "p_name", "p_partkey", "unique_name").select("p_partkey", "unique_name")


STAGE_SQL = with_(CELLS, COUNTS, NORM)


def _stage(spark, sf):
    s = Scratch(spark, "stage")
    counts = tb.basket_counts(spark, sf)
    raw = counts.select(F.lit("raw_counts").alias("layer"), "cell_id", "gene", F.col("n").alias("value"))
    norm = norm_layer(spark, sf).select(F.lit("log1p_norm").alias("layer"), "cell_id", "gene", "value")
    stages.write_stage(s.root, "normalised", {"expr": raw.unionByName(norm), "cells": tb.basket_cells(spark, sf)})
    return s.root


@query("stage_roundtrip", STAGE_SQL + """SELECT 'raw_counts' layer, cell_id, COUNT(*) n, ROUND(SUM(n), 6) total
FROM counts GROUP BY cell_id UNION ALL
SELECT 'log1p_norm', cell_id, COUNT(*), ROUND(SUM("value"), 6) FROM norm GROUP BY cell_id""")
def stage_roundtrip(spark, sf):
    root = _stage(spark, sf)
    return rounded(stages.read_stage(spark, root, "normalised", "expr").groupBy("layer", "cell_id")
                   .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query("read_layer", STAGE_SQL + """, f AS (SELECT CAST(p_partkey AS VARCHAR) gene FROM part WHERE p_name LIKE 'red%')
SELECT cell_id, gene, ROUND("value", 6) "value" FROM norm SEMI JOIN f USING (gene)""")
def read_layer(spark, sf):
    root = _stage(spark, sf)
    wanted = flagged_genes(spark, sf).where("mt").select("gene")
    return rounded(stages.read_layer(spark, root, "normalised", "log1p_norm", wanted))


@query("list_layers", """SELECT unnest(['raw_counts', 'log1p_norm']) layer""")
def list_layers(spark, sf):
    return stages.layers(spark, _stage(spark, sf), "normalised")


def regulon_long(spark, sf):
    """A long regulon derived from ``part``: brand -> type, confidence level
    from the brand number, weight from size."""
    p = tb.basket_genes(spark, sf)
    num = F.regexp_extract("brand", r"(\d+)", 1).cast("int")
    return p.select(F.col("type").alias("source"), F.col("gene").alias("target"),
                    F.element_at(F.split(F.lit("A,B,C,D,E"), ","), num % 5 + 1).alias("level"),
                    ((F.col("size") - 25) / 25.0).alias("weight"))


REGULON_SQL = """reg AS (SELECT p_type "source", CAST(p_partkey AS VARCHAR) target,
  split_part('A,B,C,D,E', ',', CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 5 + 1) "level",
  (p_size - 25) / 25.0::DOUBLE weight FROM part)"""


@query("read_regulon_long", f"""WITH {REGULON_SQL} SELECT 'a' db, "source" tf, target, ROUND(weight, 6) weight FROM reg
WHERE "level" IN ('A', 'B', 'C')""")
def read_regulon_long(spark, sf):
    s = Scratch(spark, "regulon")
    s.save(regulon_long(spark, sf), "long")
    found = regulons.read_regulon(spark, f"{s.root}/long-0", "a")
    missing = regulons.read_regulon(spark, f"{s.root}/absent", "b")
    return rounded(found.unionByName(missing))


@query("read_regulon_wide", f"""WITH {REGULON_SQL} SELECT 'w' db, "source" tf, target, ROUND(SUM(weight), 6) weight FROM reg
GROUP BY ALL HAVING SUM(weight) <> 0""")
def read_regulon_wide(spark, sf):
    s = Scratch(spark, "regulon")
    long = regulon_long(spark, sf)
    tfs = [r[0] for r in long.select("source").distinct().orderBy("source").collect()]  # a handful of types
    wide = long.groupBy(F.col("target").alias("gene")).pivot("source", tfs).sum("weight").fillna(0.0)
    s.save(wide, "wide")
    return rounded(regulons.read_regulon(spark, f"{s.root}/wide-0", "w", layout="wide"))


@query("write_result", """SELECT c_mktsegment cluster, COUNT(*) n FROM customer GROUP BY ALL""")
def write_result(spark, sf):
    s = Scratch(spark, "result")
    small = summary.value_counts(tb.basket_cells(spark, sf), "cluster")
    path = stages.write_result(small, f"{s.root}/value_counts")
    return stages.read_result(spark, path, "cluster string, n bigint")


# ---- quality control -------------------------------------------------------------------------


@query("flag_genes", with_(GENES) + "SELECT gene, mt, ribo, hb FROM genes")
def flag_genes(spark, sf):
    return flagged_genes(spark, sf).select("gene", *tb.FLAG_COLUMNS)


_R = ", ".join(f"ROUND({c}, 6) {c}" for c in [
    "total_counts", "total_counts_mt", "total_counts_ribo", "total_counts_hb", "log1p_total_counts",
    "log1p_n_genes_by_counts", "log1p_total_counts_mt", "log1p_total_counts_ribo", "log1p_total_counts_hb",
    "pct_counts_mt", "pct_counts_ribo", "pct_counts_hb", "pct_counts_in_top_20_genes"])


@query("cell_qc", BASE + f"SELECT cell_id, sample, condition, cluster, n_genes_by_counts, {_R} FROM qc")
def cell_qc(spark, sf):
    return rounded(cell_metrics(spark, sf))


@query("gene_qc", with_(CELLS, COUNTS) + """SELECT gene, COUNT(*) n_cells_by_counts, ROUND(SUM(n), 6) total_counts,
ROUND(SUM(n) / nc, 6) mean_counts, ROUND(ln(1 + SUM(n) / nc), 6) log1p_mean_counts,
ROUND((1 - COUNT(*) / nc) * 100, 6) pct_dropout_by_counts, ROUND(ln(1 + SUM(n)), 6) log1p_total_counts
FROM counts, (SELECT CAST(COUNT(*) AS DOUBLE) nc FROM cells) GROUP BY gene, nc""")
def gene_qc(spark, sf):
    return rounded(qc.gene_qc(tb.basket_counts(spark, sf), tb.basket_cells(spark, sf)))


@query("mad_outlier", BASE + """, med AS (SELECT sample, median(log1p_total_counts) m FROM qc GROUP BY sample),
d AS (SELECT sample, median(abs(log1p_total_counts - m)) d FROM qc JOIN med USING (sample) GROUP BY sample)
SELECT cell_id, log1p_total_counts < m - 3 * d OR log1p_total_counts > m + 3 * d log1p_total_counts_outlier
FROM qc JOIN med USING (sample) JOIN d USING (sample)""")
def mad_outlier(spark, sf):
    return qc.mad_outlier(cell_metrics(spark, sf), ["log1p_total_counts"], 3).select(
        "cell_id", "log1p_total_counts_outlier")


@query("qc_flags", BASE + f", {FLAGGED} SELECT cell_id, sample, outlier, mt_outlier FROM flagged")
def qc_flags(spark, sf):
    return flagged_cells(spark, sf).select("cell_id", "sample", "outlier", "mt_outlier")


@query("apply_qc", BASE + f""", {FLAGGED} SELECT sample, cell_id, COUNT(*) n_genes, ROUND(SUM(n), 6) total
FROM counts SEMI JOIN (SELECT cell_id FROM flagged WHERE NOT outlier AND NOT mt_outlier) USING (cell_id) GROUP BY ALL""")
def apply_qc(spark, sf):
    counts = cut(tb.basket_counts(spark, sf), "counts")  # read twice
    metrics = qc.cell_qc(counts, tb.basket_cells(spark, sf), flagged_genes(spark, sf), tb.FLAG_COLUMNS)
    kept, _ = qc.apply_qc(counts, qc.qc_flags(metrics, 3, "pct_counts_mt", 20.0))
    return rounded(kept.groupBy("sample", "cell_id").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("n").alias("total")))


@query("qc_report", BASE + f""", {FLAGGED} SELECT sample, COUNT(*) cells_before, COUNT(*) FILTER (outlier) n_outlier,
COUNT(*) FILTER (mt_outlier) n_mt_outlier, COUNT(*) FILTER (NOT outlier AND NOT mt_outlier) cells_after
FROM flagged GROUP BY sample""")
def qc_report(spark, sf):
    return qc.qc_report(flagged_cells(spark, sf), ["sample"])


@query("filter_genes", with_(COUNTS) + """SELECT sample, cell_id, gene, n FROM counts WHERE gene IN
(SELECT gene FROM counts WHERE n > 0 GROUP BY gene HAVING COUNT(*) >= 25)""")
def filter_genes(spark, sf):
    return qc.filter_genes(tb.basket_counts(spark, sf), 25).select("sample", "cell_id", "gene", "n")


@query("filter_genes_tokens", with_(TOKENS) + """SELECT gene, COUNT(*) n_cells, SUM(n) total FROM counts
GROUP BY gene HAVING COUNT(*) >= 10""")
def filter_genes_tokens(spark, sf):
    return qc.filter_genes(tb.token_counts(spark, sf), 10).groupBy("gene").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("total"))


CLASS_SQL = "SELECT doc_id, CAST(quality + 1 AS BIGINT) class FROM labels"


@query("decode_class", f"""SELECT doc_id, class, CASE class WHEN 1 THEN 'singlet' WHEN 2 THEN 'doublet' END class_word
FROM ({CLASS_SQL})""")
def decode_class(spark, sf):
    df = tb.table(spark, sf, "labels").select("doc_id", (F.col("quality") + 1).alias("class"))
    return rounded(labels.decode(df, "class", {1: "singlet", 2: "doublet"}, "class_word"))


@query("keep_singlets", BASE + """SELECT cell_id, 'singlet' class, ROUND(total_counts, 6) total_counts, n_genes_by_counts,
ROUND(total_counts_mt, 6) total_counts_mt, ROUND(pct_counts_mt, 6) pct_counts_mt FROM qc
WHERE cluster <> 'MACHINERY'""")
def keep_singlets(spark, sf):
    cells = tb.basket_cells(spark, sf).withColumn("class", F.when(F.col("cluster") == "MACHINERY", 2).otherwise(1))
    out = qc.keep_singlets(tb.basket_counts(spark, sf), cells, flagged_genes(spark, sf), ["mt"])
    return rounded(out.select("cell_id", "class", "total_counts", "n_genes_by_counts", "total_counts_mt", "pct_counts_mt"))


@query("clean_values", """WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'NaN'::DOUBLE
  WHEN 2 THEN 'Infinity'::DOUBLE WHEN 3 THEN '-Infinity'::DOUBLE ELSE l_discount END x FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) l_linenumber,
  CASE WHEN isnan(x) THEN 0 WHEN x = 'Infinity'::DOUBLE THEN 10 WHEN x = '-Infinity'::DOUBLE THEN 0 ELSE x END plot,
  CASE WHEN isnan(x) THEN 0 WHEN x = 'Infinity'::DOUBLE THEN 10 WHEN x = '-Infinity'::DOUBLE THEN -10 ELSE x END scaled,
  CASE WHEN isnan(x) THEN 0 WHEN x = 'Infinity'::DOUBLE THEN 0 WHEN x = '-Infinity'::DOUBLE THEN 0 ELSE x END shift
FROM v""")
def clean_values(spark, sf):
    n = F.col("l_linenumber")
    x = (F.when(n == 1, F.lit(float("nan"))).when(n == 2, F.lit(float("inf")))
         .when(n == 3, F.lit(float("-inf"))).otherwise(F.col("l_discount")))
    li = tb.table(spark, sf, "lineitem").select("l_orderkey", n.cast("bigint").alias("l_linenumber"), x.alias("x"))
    c = F.col("x")
    return li.select("l_orderkey", "l_linenumber", C.clean(c, 0, 10, 0).alias("plot"),
                     C.clean(c, 0, 10, -10).alias("scaled"), C.clean(c, 0, 0, 0).alias("shift"))


@query("std_meta", "SELECT c_custkey, upper(trim(c_mktsegment)) cluster, upper(trim(c_name)) \"name\" FROM customer")
def std_meta(spark, sf):
    return tb.table(spark, sf, "customer").select(
        "c_custkey", C.standard(F.col("c_mktsegment")).alias("cluster"), C.standard(F.col("c_name")).alias("name"))


@query("exclude_cluster", with_(CELLS) + "SELECT * FROM cells WHERE cluster <> 'MACHINERY'")
def exclude_cluster(spark, sf):
    return labels.exclude(tb.basket_cells(spark, sf), "cluster", "MACHINERY")


@query("filter_samples", with_(CELLS) + """, k AS (SELECT * FROM cells WHERE cluster <> 'MACHINERY')
SELECT * FROM k WHERE sample <> 'NATION_3' AND sample IN (SELECT sample FROM k GROUP BY sample HAVING COUNT(*) >= 48)""")
def filter_samples(spark, sf):
    kept = labels.exclude(tb.basket_cells(spark, sf), "cluster", "MACHINERY")
    return labels.filter_samples(kept, 48, ["NATION_3"]).select("cell_id", "sample", "condition", "cluster")


#: names for three of the segments; one has no place in the order
SEGMENTS = [("AUTOMOBILE", "auto", 1, "vehicle"), ("BUILDING", "build", 2, "site"),
            ("FURNITURE", "home", None, "indoor"), ("HOUSEHOLD", "house", 3, None)]
MAP_SQL = """m(cluster, "name", ord, fate) AS (VALUES ('AUTOMOBILE', 'auto', 1, 'vehicle'), ('BUILDING', 'build', 2, 'site'),
('FURNITURE', 'home', NULL, 'indoor'), ('HOUSEHOLD', 'house', 3, NULL))"""


def _named(spark, sf):
    m = spark.createDataFrame(SEGMENTS, "cluster string, name string, ord int, fate string")
    return labels.apply_labels(tb.basket_cells(spark, sf), m), m


@query("apply_labels", with_(CELLS, MAP_SQL) + """SELECT cell_id, o."name" cluster_name, CAST(COALESCE(o.ord, -1) AS BIGINT) cluster_name_ord
FROM cells LEFT JOIN m USING (cluster) LEFT JOIN (SELECT "name", ord FROM m WHERE ord IS NOT NULL) o
ON o."name" = COALESCE(m."name", cluster)""")
def apply_labels(spark, sf):
    return rounded(_named(spark, sf)[0].select("cell_id", "cluster_name", F.coalesce("cluster_name_ord", F.lit(-1)).alias("cluster_name_ord")))


@query("apply_fate", with_(CELLS, MAP_SQL) + """, n AS (SELECT cell_id, CASE WHEN ord IS NULL THEN NULL ELSE "name" END nm
FROM cells LEFT JOIN m USING (cluster)), f AS (SELECT cell_id, COALESCE(fate, 'unknown') fate_group
FROM n LEFT JOIN m ON nm = m."name")
SELECT cell_id, fate_group, CASE WHEN fate_group IN ('vehicle', 'site') THEN fate_group END fate_known FROM f""")
def apply_fate(spark, sf):
    cells, m = _named(spark, sf)
    a = labels.apply_fate(cells, m).select("cell_id", "fate_group")
    b = labels.apply_fate(cells, m, categories=["vehicle", "site"]).select("cell_id", F.col("fate_group").alias("fate_known"))
    return a.join(b, "cell_id")


def part_sets(spark, sf):
    """Gene sets from ``part``: one set per type, every part a member."""
    return tb.basket_genes(spark, sf).select(F.col("type").alias("set_name"), "ord", "gene")


@query("present_genes", with_(COUNTS) + """SELECT p_type set_name, CAST(p_partkey AS VARCHAR) gene FROM part
WHERE CAST(p_partkey AS VARCHAR) IN (SELECT gene FROM counts WHERE n > 60)""")
def present_genes(spark, sf):
    return labels.present(part_sets(spark, sf), tb.basket_counts(spark, sf).where("n > 60")).select("set_name", "gene")


@query("sets_present", with_(COUNTS) + """SELECT p_type set_name, COUNT(*) n_genes, COUNT(h.gene) n_present,
COUNT(h.gene) > 0 scorable FROM part LEFT JOIN (SELECT DISTINCT gene FROM counts WHERE n > 60) h
ON h.gene = CAST(p_partkey AS VARCHAR) GROUP BY ALL""")
def sets_present(spark, sf):
    return labels.sets_present(part_sets(spark, sf), tb.basket_counts(spark, sf).where("n > 60"))


@query("cells_expressing", with_(CELLS, COUNTS) + """SELECT * FROM cells WHERE cell_id IN
(SELECT cell_id FROM counts WHERE n > 0 AND gene IN ('1', '2', '3', '5'))""")
def cells_expressing(spark, sf):
    return labels.cells_expressing(tb.basket_counts(spark, sf), tb.basket_cells(spark, sf), ["1", "2", "3", "5"], "n").select(
        "cell_id", "sample", "condition", "cluster")


@query("case_names", r"""WITH n AS (SELECT p_partkey, replace(p_name, ' ', CAST(p_size AS VARCHAR)) s FROM part)
SELECT p_partkey, lower(s) low, list_aggregate(list_transform(regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]+'),
lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') title FROM n""")
def case_names(spark, sf):
    s = F.regexp_replace("p_name", " ", F.col("p_size").cast("string"))
    p = tb.table(spark, sf, "part").select("p_partkey", s.alias("s"))
    return p.select("p_partkey", F.lower("s").alias("low"), C.title_case(F.col("s")).alias("title"))


@query("head_per_group", """SELECT DISTINCT gene FROM (SELECT CAST(p_partkey AS VARCHAR) gene,
ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_partkey) rn FROM part) WHERE rn <= 2""")
def head_per_group(spark, sf):
    return labels.head_per_group(part_sets(spark, sf), 2)


@query("clip_bounds", BASE + """SELECT ROUND(quantile_cont(total_counts, 0.02), 6) p2, ROUND(quantile_cont(total_counts, 0.98), 6) p98,
ROUND(quantile_cont(total_counts, 0.99), 6) p99 FROM qc""")
def clip_bounds(spark, sf):
    from stipple.functions.order import quantiles
    return rounded(quantiles(cell_metrics(spark, sf), [], ["total_counts"], {"p2": .02, "p98": .98, "p99": .99}).select("p2", "p98", "p99"))


@query("split_conditions", with_(CELLS) + """SELECT panel, cluster, COUNT(*) n FROM (SELECT condition panel, cluster FROM cells
UNION ALL SELECT 'all', cluster FROM cells) GROUP BY ALL""")
def split_conditions(spark, sf):
    return labels.split_conditions(tb.basket_cells(spark, sf)).groupBy("panel", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query("save_layer", with_(COUNTS) + """SELECT unnest(['X', 'raw_counts']) layer, cell_id, gene, n "value" FROM counts""")
def save_layer(spark, sf):
    x = tb.basket_counts(spark, sf).select(F.lit("X").alias("layer"), "cell_id", "gene", F.col("n").alias("value"))
    return labels.save_layer(x, "X", "raw_counts")


# ---- joins and set operations ---------------------------------------------------------------


@query("concat_samples", with_(COUNTS) + "SELECT sample, cell_id || '-' || sample cell_id, gene, n FROM counts")
def concat_samples(spark, sf):
    c = tb.basket_counts(spark, sf)
    even = F.regexp_extract("sample", r"(\d+)", 1).cast("int") % 2 == 0
    return labels.concat_samples([c.where(even), c.where(~even).withColumn("extra", F.lit(1))]).select(
        "sample", "cell_id", "gene", "n")


@query("gene_overlap", with_(COUNTS) + """SELECT CAST(SUM(g) AS BIGINT) sum_of_genes, (SELECT COUNT(DISTINCT gene) FROM counts) unique_genes
FROM (SELECT sample, COUNT(DISTINCT gene) g FROM counts GROUP BY sample)""")
def gene_overlap(spark, sf):
    return labels.gene_overlap(tb.basket_counts(spark, sf))


def two_regulons(spark, sf):
    long = regulon_long(spark, sf)
    a = regulons.from_long(long, "a", levels=("A", "B", "C")).where("tf in ('SMALL', 'ECONOMY')")
    supp = tb.table(spark, sf, "supplier").select(
        F.lit("S").alias("source"), F.col("s_suppkey").cast("string").alias("target"), (F.col("s_acctbal") / 1000).alias("weight"))
    return a, regulons.from_long(supp, "b")


TWO_SQL = f"""{REGULON_SQL}, a AS (SELECT target, weight FROM reg WHERE "level" IN ('A','B','C') AND "source" IN ('SMALL','ECONOMY')),
both_ AS (SELECT target, weight, 0 pr FROM a UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_acctbal / 1000, 1 FROM supplier),
combined AS (SELECT target, weight FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY target ORDER BY pr, weight) rn FROM both_) WHERE rn = 1)"""


@query("combine_regulons", f"WITH {TWO_SQL} SELECT target, ROUND(weight, 6) weight FROM combined")
def combine_regulons(spark, sf):
    return rounded(labels.combine_regulons(two_regulons(spark, sf)))


@query("repressed_targets", f"WITH {TWO_SQL} SELECT target, ROUND(weight, 6) weight FROM combined WHERE weight < 0")
def repressed_targets(spark, sf):
    return rounded(labels.repressed(labels.combine_regulons(two_regulons(spark, sf))))


@query("lookup_default", with_(GENES) + """, s AS (SELECT CAST(s_suppkey AS VARCHAR) gene, s_acctbal v FROM supplier)
SELECT gene, COALESCE(v, 0) v FROM genes LEFT JOIN s USING (gene)""")
def lookup_default(spark, sf):
    s = tb.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("gene"), F.col("s_acctbal").alias("v"))
    return labels.lookup(tb.basket_genes(spark, sf).select("gene"), s, "gene", "v", 0.0)


@query("membership", with_(CELLS) + """SELECT cell_id, 'in' side FROM cells WHERE cluster IN ('BUILDING', 'FURNITURE')
UNION ALL SELECT cell_id, 'out' FROM cells WHERE cluster NOT IN ('BUILDING', 'FURNITURE')""")
def membership(spark, sf):
    cells = tb.basket_cells(spark, sf)
    keys = cells.where("cluster in ('BUILDING', 'FURNITURE')").select("cluster").distinct()
    a = labels.members(cells, keys, "cluster").select("cell_id", F.lit("in").alias("side"))
    return a.unionByName(labels.non_members(cells, keys, "cluster").select("cell_id", F.lit("out").alias("side")))


@query("sample_meta", with_(CELLS) + "SELECT DISTINCT sample, condition FROM cells")
def sample_meta(spark, sf):
    return labels.sample_meta(tb.basket_cells(spark, sf))


# ---- summaries ---------------------------------------------------------------------------------

_DESC = " UNION ALL ".join(
    f"""SELECT stage, '{c}' metric, COUNT({c}) "count", ROUND(AVG({c}), 6) mean, ROUND(STDDEV_SAMP({c}), 6) std,
ROUND(MIN({c}), 6) "min", ROUND(MAX({c}), 6) "max", ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) q25,
ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) q50, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) q75 FROM st GROUP BY stage"""
    for c in QC_COLUMNS)


@query("describe_qc", BASE + f""", {FLAGGED}, st AS (SELECT 'before' stage, * FROM flagged UNION ALL
SELECT 'after', * FROM flagged WHERE NOT outlier AND NOT mt_outlier) {_DESC}""")
def describe_qc(spark, sf):
    f = flagged_cells(spark, sf)
    keep = ~F.col("outlier") & ~F.col("mt_outlier")
    both = f.withColumn("stage", F.explode(F.when(keep, F.array(F.lit("before"), F.lit("after"))).otherwise(F.array(F.lit("before")))))
    return rounded(summary.describe(both, QC_COLUMNS, ["stage"]))


@query("histogram", BASE + """, s AS (SELECT MIN(total_counts) lo, MAX(total_counts) hi FROM qc),
b AS (SELECT LEAST(FLOOR((total_counts - lo) / ((hi - lo) / 100)), 99) bin, COUNT(*) n FROM qc, s GROUP BY 1)
SELECT CAST(bin AS BIGINT) bin, ROUND(lo + bin * ((hi - lo) / 100), 6) "left", ROUND(lo + (bin + 1) * ((hi - lo) / 100), 6) "right", n FROM b, s""")
def histogram(spark, sf):
    return rounded(summary.histogram(cell_metrics(spark, sf), "total_counts", 100))


@query("group_quartiles", BASE + """SELECT cluster, COUNT(*) n, ROUND(quantile_cont(total_counts, 0.25), 6) q1,
ROUND(quantile_cont(total_counts, 0.5), 6) "median", ROUND(quantile_cont(total_counts, 0.75), 6) q3 FROM qc GROUP BY cluster""")
def group_quartiles(spark, sf):
    return rounded(summary.group_quartiles(cell_metrics(spark, sf), ["cluster"], "total_counts"))


@query("value_counts", with_(CELLS) + "SELECT sample, COUNT(*) n FROM cells GROUP BY sample")
def value_counts(spark, sf):
    return summary.value_counts(tb.basket_cells(spark, sf), "sample")


@query("n_clusters", with_(CELLS) + """SELECT COUNT(DISTINCT cluster) n_clusters, COUNT(*) n_cells,
COUNT(DISTINCT cluster) > 1 AND COUNT(DISTINCT cluster) < COUNT(*) "valid" FROM cells""")
def n_clusters(spark, sf):
    return summary.n_clusters(tb.basket_cells(spark, sf), "cluster")


_XTAB = """, g AS (SELECT a.{a}, b.{b} FROM (SELECT DISTINCT {a} FROM cells) a, (SELECT DISTINCT {b} FROM cells) b),
x AS (SELECT g.{a}, g.{b}, COUNT(c.cell_id) n FROM g LEFT JOIN cells c ON c.{a} = g.{a} AND c.{b} = g.{b} GROUP BY ALL)"""


@query("composition", with_(CELLS) + _XTAB.format(a="cluster", b="condition") + """
SELECT cluster, condition, n, ROUND(n / SUM(n) OVER (PARTITION BY cluster), 6) proportion FROM x""")
def composition(spark, sf):
    return rounded(summary.composition(tb.basket_cells(spark, sf), "cluster", "condition"))


@query("crosstab", with_(CELLS) + _XTAB.format(a="sample", b="cluster") + " SELECT sample, cluster, n FROM x")
def crosstab(spark, sf):
    return summary.crosstab(tb.basket_cells(spark, sf), "sample", "cluster")


@query("layer_sums", with_(COUNTS, NORM) + """SELECT cell_id, ROUND(SUM("value"), 6) layer_sum FROM norm GROUP BY cell_id""")
def layer_sums(spark, sf):
    return rounded(summary.layer_sums(norm_layer(spark, sf)))


@query("gate", with_(CELLS) + """SELECT sample || cluster g, COUNT(*) FILTER (condition = 'WT') n_ref,
COUNT(*) FILTER (condition = 'KO') n_test FROM (SELECT cluster, cluster sample, condition FROM cells) GROUP BY ALL
HAVING n_ref >= 5 AND n_test >= 5""")
def gate(spark, sf):
    cells = tb.basket_cells(spark, sf).withColumn("g", F.concat("cluster", "cluster"))
    return summary.gate(cells, "g", "condition", "WT", "KO", 5)
