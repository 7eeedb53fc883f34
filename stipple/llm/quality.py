"""Supervised subword embeddings for text quality.

Every word, every character n-gram and every word that follows itself is hashed
into a bucket with a learned vector; the vectors of a text are averaged and a softmax layer gives
the classes.  Vectors and layer are learned together by stochastic gradient
descent in numpy on a bounded labelled sample.  Because the average is linear,
scoring sums one number per feature: the bucket's vector times the difference
of the two class rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm.common import in_fold, labelled_sample, slices, text_bytes

BITS = 17
GRAMS = (3, 4)
WIDTH = 10
THRESHOLD = 0.7
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0x5851F42D4C957F2D


def _buckets(codes: np.ndarray, kind: int) -> np.ndarray:
    """Multiplicative hash; ``kind`` keeps words and n-grams of each length apart."""
    shift = np.uint64(kind * 0xD1B54A32D192ED03 % (1 << 64))
    return ((codes + shift) * _MIX >> np.uint64(64 - BITS)).astype(np.int32)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    done = 1
    while done <= n:  # doubling: the next stretch is the first one times base^done
        step = min(done, n + 1 - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def word_places(raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the one after its last; texts lie end to end, and a word ends with its text."""
    inside = ~SPACES[raw]
    edge = np.zeros(raw.size + 1, bool)
    edge[places] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    return np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))


def stretch_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each stretch of bytes, by differences of one running sum."""
    powers = _powers(raw.size, _ODD)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    back = _powers(raw.size, pow(_ODD, -1, 1 << 64))
    codes = (total[stop] - total[start]) * back[start]
    return codes ^ codes >> np.uint64(31)


def word_hashes(raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and the text it stands in."""
    start, stop = word_places(raw, places)
    return stretch_hashes(raw, start, stop), np.searchsorted(places, start, "right") - 1


def features(raw: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None, int]]:
    """(bucket of each feature, its text or None, n-gram length): words first, then n-grams by their first byte."""
    codes, owner = word_hashes(raw, places)
    yield _buckets(codes, 1), owner, 0
    again = owner[1:][(codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])]
    yield _buckets(np.zeros(len(again), np.uint64), 1), again, 0
    flat = np.where(SPACES[raw], np.uint8(32), raw)
    for n in GRAMS:
        if raw.size >= n:
            code = np.zeros(raw.size - n + 1, np.uint64)
            for k in range(n):
                code |= flat[k:raw.size - n + 1 + k].astype(np.uint64) << np.uint64(8 * k)
            yield _buckets(code, n), None, n


def sums(values: np.ndarray, raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of its features' values and their number."""
    n_texts = len(places) - 1
    total, count = np.zeros(n_texts), np.zeros(n_texts)
    for bucket, owner, n in features(raw, places):
        v = values[bucket]
        if owner is not None:
            total += np.bincount(owner, v, n_texts)
            count += np.bincount(owner, minlength=n_texts)
        else:
            running = np.concatenate([[0.0], np.cumsum(v)])
            first = np.minimum(places[:-1], len(v))
            last = np.clip(places[1:] - n + 1, first, len(v))
            total += running[last] - running[first]
            count += last - first
    return total, count


@dataclass
class Model:
    values: np.ndarray  # one number per bucket
    bias: float


def _sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of distinct buckets with their share of a text's features: buckets, shares, row starts."""
    buckets, shares, starts = [], [], [0]
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        found = [b for b, _, _ in features(raw, np.array([0, raw.size]))]
        ids, n = np.unique(np.concatenate(found), return_counts=True)
        buckets.append(ids)
        shares.append((n / max(1, n.sum())).astype(np.float32))
        starts.append(starts[-1] + len(ids))
    return np.concatenate(buckets), np.concatenate(shares), np.array(starts)


def train(sample: list[tuple[str, int]], epochs: int = 12, rate: float = 40.0, batch: int = 32, seed: int = 6) -> Model:
    """Vectors and softmax layer by stochastic gradient descent, the rate falling linearly to nothing."""
    y = np.array([label for _, label in sample], int)
    if len(set(y.tolist())) < 2:  # one class only: the scores are constant
        return Model(np.zeros(1 << BITS, np.float32), 6.0 if y.any() or not len(y) else -6.0)
    rng = np.random.default_rng(seed)
    buckets, shares, starts = _sparse([t for t, _ in sample])
    vectors = ((rng.random((1 << BITS, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
    layer, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    weight = len(y) / (2 * np.bincount(y, minlength=2))  # both classes count alike
    steps, done = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at:at + batch]
            take = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
            owner = np.repeat(np.arange(len(rows)), starts[rows + 1] - starts[rows])
            ids, share = buckets[take], shares[take]
            held = vectors[ids] * share[:, None]
            mean = np.stack([np.bincount(owner, held[:, k], len(rows)) for k in range(WIDTH)], 1)
            z = mean @ layer.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= (weight[y[rows]] / len(rows))[:, None]
            step = rate * (1 - done / steps)
            back = (p @ layer).astype(np.float32)
            layer -= (step * 0.25 * (p.T @ mean)).astype(np.float32)
            bias -= (step * 0.002 * p.sum(0)).astype(np.float32)
            np.add.at(vectors, ids, -step * share[:, None] * back[owner])
            done += 1
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def score(model: Model, raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    total, count = sums(model.values, raw, places)
    z = np.where(count > 0, total / np.maximum(count, 1), 0) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 20_000, key: str = "doc_id",
        text: str = "text", label: str = "quality", folds: int = 4, held_out: int = 2) -> Model:
    """Learn from at most ``per_class`` texts of each class, whole, outside the held-out fold."""
    usable = ~in_fold(key, folds, held_out)
    return train(labelled_sample(docs, labels, label, usable, {0: per_class, 1: per_class}, longest, 6, key, text))


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1, higher: better) of every row, the whole text.

    A null text is an empty one and scores by the bias alone; repeated rows
    are scored each, other columns are left out.  The model is one number for
    each of 2^17 buckets, whatever the input.
    """
    docs = docs.select(F.col(key), F.col(text))
    return docs.mapInArrow(_scorer(model, key, text), f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def _scorer(model: Model, key: str, text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1_000_000):
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(score(model, *text_bytes(batch, text)))], [key, "score"])

    return run
