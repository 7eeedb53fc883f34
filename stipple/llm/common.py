"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of text that one slice of a batch may hold; a longer single text is a slice of its own
SLICE_CHARS = 4_000_000


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names close to the wanted ones that clash with none taken, whatever the case of letters."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def in_fold(key: str, folds: int, fold: int) -> Column:
    """Whether crc32(key as text) mod ``folds`` is ``fold``; a null key is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece stay near ``limit`` bytes."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: dict[int, int],
                    longest: int, seed: int, key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """A bounded sample of labelled texts, the same on every run: (text, label).

    For each class the ``per_class`` usable rows of least hash, texts of up to
    ``longest`` characters.  Only this sample is held by the driver; rows with
    a null key or label and repeated labels that disagree take no part.
    """
    marks = labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).where("__k is not null")
    marks = marks.groupBy("__k").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z").drop("__z")
    rows = docs.where(usable).select(F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    rows = rows.where(F.length("__t") <= longest).withColumn("__h", F.xxhash64(F.lit(seed), "__k", "__t"))
    lots = rows.select("__k", "__h").join(marks, "__k")  # hashes are drawn first, texts only for the winners
    drawn = {}
    for value, n in per_class.items():
        for r in lots.where(F.col("__y") == value).orderBy("__h", "__k").limit(n).collect():
            drawn[r["__k"], r["__h"]] = value
    if not drawn:
        return []
    winners = docs.sparkSession.createDataFrame(
        [(*k, v) for k, v in drawn.items()], f"__k {docs.schema[key].dataType.simpleString()}, __h bigint, __y int")
    got = rows.join(F.broadcast(winners), ["__k", "__h"]).dropDuplicates(["__k", "__h"]).collect()
    return [(r["__t"], r["__y"]) for r in sorted(got, key=lambda r: (r["__h"], r["__k"]))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression by damped Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(a.shape[1])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + (penalty * w * w).sum() / 2)

    at = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(penalty), a.T @ (p - y) + penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > at:
            size /= 2
        w = w - size * step
        new = loss(w)
        if at - new < 1e-9 * max(1.0, abs(at)):
            break
        at = new
    return w


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts of a batch end to end, and where each begins (one more for the end)."""
    data = batch.column(column).cast(pa.large_binary())
    data = pa.compute.fill_null(data, b"") if data.null_count else data
    places = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
    raw = data.buffers()[2]
    held = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return held[places[0]:places[-1]], places - places[0]
