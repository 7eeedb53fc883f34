"""A cleaning pipeline over the table of documents, one operator a stage.

Every stage takes the rows that the one before kept.  Stages that filter drop
whole documents, the redaction changes texts, and the last stage returns the
encoding of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stipple.llm import bayes_join, decontaminate, pii, sentencepieces, toxicity
from stipple.llm.common import documents
from stipple.llm.queries import tokenizer_bytes
from stipple.session import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays."""
    return bayes_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind; sizes of changed texts are renewed."""
    return pii.redact(docs, size="n_chars" if "n_chars" in docs.columns else None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the encoding and of what it decodes to."""
    return sentencepieces.digests(sentencepieces.encode_documents(docs, tokenizer_bytes()))


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_benchmark),
          ("PII", redact_personal), ("SentencePiece encoding and decoding", encode)]

#: compression lengths and edit distances have no SQL form; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each reading what the one before wrote to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{n}")
    return STAGES[-1][1](spark, docs, sf_dir)
