"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.llm import bayes_join, capfilters, decontaminate, lexical, licenses, maxscore, merkle, pii, quality, secrets, sentencepieces, suffix_tree, toxicity
from stipple.llm.common import documents, in_fold
from stipple.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """A public vocabulary file, where the package of vocabularies has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_bytes(name: str = "piece_bpe_32k.model") -> bytes:
    with open(tokenizer_path(name), "rb") as f:
        return f.read()


def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return sentencepieces.digests(sentencepieces.encode_documents(documents(spark, sf), tokenizer_bytes()))


QUERIES["op4_sentencepiece"] = op4_sentencepiece


def _judged(scores: DataFrame, folds: int, fold: int, threshold: float) -> DataFrame:
    return scores.select(
        "doc_id", in_fold("doc_id", folds, fold).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    model = toxicity.fit(docs, documents(spark, sf, "labels"))
    return _judged(toxicity.score_documents(docs, model), 3, 1, toxicity.THRESHOLD)


QUERIES["op9_toxicity"] = op9_toxicity


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    model = quality.fit(docs, documents(spark, sf, "labels"))
    return _judged(quality.score_documents(docs, model), 4, 2, quality.THRESHOLD)


QUERIES["op6_quality"] = op6_quality


def op7_maxscore(spark: SparkSession, sf: str) -> DataFrame:
    return maxscore.top_k(documents(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES["op7_maxscore"] = op7_maxscore
SQL["op7_maxscore"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), TRUE)),
pairs AS (
  SELECT q.vec_id query_id, r.vec_id,
         CAST(list_sum(list_transform(list_zip(q.c, r.c), lambda p: p[1] * p[2])) AS BIGINT) score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) "rank", vec_id, score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM pairs) WHERE rank <= 20
"""


def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf), documents(spark, sf, "benchmark"))


QUERIES["op10_decontaminate"] = op10_decontaminate


def op2_bayes_join(spark: SparkSession, sf: str) -> DataFrame:
    near = bayes_join.near_duplicates(documents(spark, sf))
    return near.select("doc_id", "class_id", "n_copies", "n_text_links", "n_links")


QUERIES["op2_bayes_join"] = op2_bayes_join
SQL["op2_bayes_join"] = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\t-\\r ]+'), lambda x: x <> '') w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) g
  FROM t),
n AS (SELECT doc_id, count(*) n, md5(string_agg(g, '|' ORDER BY g)) f FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b, y.f, x.f = y.f same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT d.doc_id, r.class_id, 1 + count(*) FILTER (WHERE l.same) n_copies,
       count(DISTINCT l.f) FILTER (WHERE NOT l.same) n_text_links, count(l.b) n_links
FROM documents d JOIN (SELECT a, min(b) class_id FROM reach GROUP BY a) r ON r.a = d.doc_id LEFT JOIN l ON l.a = d.doc_id
GROUP BY ALL
"""


def op5_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.report(secrets.scan(documents(spark, sf)))


QUERIES["op5_secrets"] = op5_secrets
SQL["op5_secrets"] = secrets.report_sql()


def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = cut(pii.proposed(documents(spark, sf)), "pii")
    return pii.report(found, pii.train(found))


QUERIES["op8_pii"] = op8_pii


def op3_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(documents(spark, sf))


QUERIES["op3_licenses"] = op3_licenses
SQL["op3_licenses"] = licenses.scan_sql()


def op1_suffix_tree(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_tree.score_documents(documents(spark, sf))


QUERIES["op1_suffix_tree"] = op1_suffix_tree


def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.audit(documents(spark, sf), {"text": merkle.tampered_text()})


QUERIES["op11_merkle"] = op11_merkle
SQL["op11_merkle"] = merkle.audit_sql()


def op12_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(documents(spark, sf), documents(spark, sf, "benchmark"))


QUERIES["op12_lexical"] = op12_lexical
SQL["op12_lexical"] = lexical.search_sql()


def op13_capfilters(spark: SparkSession, sf: str) -> DataFrame:
    return capfilters.links(documents(spark, sf, "embeddings")).drop("n_text_links")


QUERIES["op13_capfilters"] = op13_capfilters
SQL["op13_capfilters"] = capfilters.LINKS_SQL
