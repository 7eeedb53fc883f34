"""Toxicity by compression distance.

Two zstandard dictionaries are built from a bounded labelled sample.  Both end
a long stretch trained on ordinary text; in one of them it is followed by more
ordinary text, in the other by the strings that recur in toxic texts and
hardly in ordinary ones, so that prose costs the same under both.  A window is
a word between two carriers that both dictionaries hold (zstandard neither
searches the last bytes of its input nor compresses very short ones).  The
bytes that a window saves under the toxic dictionary are counted over the
whole text, and a logistic calibration turns the counts into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm.common import in_fold, labelled_sample, logistic, slices, texts

GRAM = 5
#: a string is toxic when it occurs this many times as often (by documents) as in ordinary text, and in so many texts
#: or that share of the toxic ones
CONTRAST, SUPPORT, SHARE = 8.0, 4, 0.01
ORDINARY_BYTES, TOXIC_BYTES = 8_000, 6_000
HEAD, TAIL = 40, 16
#: longer words are cut into windows of this many bytes
WINDOW = 64
#: features of a text: windows (and their share) that save at least so many bytes, the best savings of different
#: windows, the mean saving and the length
GAINS, TOP = (2, 3, 4, 5, 6), 4
FEATURES = 2 * len(GAINS) + TOP + 2
THRESHOLD = 0.7
#: words whose saving a task remembers, bytes of text that it scores at once
MEMORY, SLICE = 100_000, 500_000


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=18,
        hash_log=17, chain_log=17, search_log=4, min_match=5, target_length=32, strategy=zstandard.STRATEGY_DFAST)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=_parameters())
    return zstandard.ZstdCompressor(dict_data=d, compression_params=_parameters())


def windows(text: str) -> list[bytes]:
    """Every word of the text in lower case between spaces, long ones in pieces."""
    out = []
    for word in text.lower().split():
        w = b" " + word.encode() + b" "
        out += [w] if len(w) <= WINDOW else [w[i:i + WINDOW] for i in range(0, len(w), WINDOW - GRAM)]
    return out


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


class Scorer:
    """Scores texts in a task; remembers the gains of words it has seen."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.known: dict[bytes, int] = {}
        self.pair = _compressor(ordinary), _compressor(toxic)
        self.head, self.tail = ordinary[:HEAD], ordinary[:TAIL]

    def _learn(self, words: list[bytes]) -> None:
        sizes = np.array([len(w) for w in words], np.uint64) + np.uint64(len(self.head) + len(self.tail))
        blob = b"".join(self.head + w + self.tail for w in words)
        places = np.stack([np.cumsum(sizes) - sizes, sizes], 1).tobytes()
        a, b = (c.multi_compress_to_buffer(zstandard.BufferWithSegments(blob, places), threads=1) for c in self.pair)
        self.known.update((w, len(a[i]) - len(b[i])) for i, w in enumerate(words))

    def features(self, rows: Iterable[str]) -> np.ndarray:
        split = [windows(t) for t in rows]
        new = {w for ws in split for w in ws} - self.known.keys()
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = {w for ws in split for w in ws}
        if new:
            self._learn(sorted(new))
        out = np.zeros((len(split), FEATURES))
        for row, ws in zip(out, split, strict=True):
            if ws:
                gain = np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))
                hits = np.array([(gain >= g).sum() for g in GAINS])
                best = sorted(map(self.known.__getitem__, set(ws)), reverse=True)[:TOP]
                best += [min(best[-1], 0)] * (TOP - len(best))
                row[:] = [*np.log1p(hits), *np.sqrt(hits / len(ws)), *best, gain.mean(), np.log1p(len(ws))]
        return out


def score(model: Model, features: np.ndarray) -> np.ndarray:
    z = (features - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _stretches(word: bytes, marked: set[bytes]) -> list[bytes]:
    """Longest parts of the word whose grams are all marked."""
    out, i, n = [], 0, len(word) - GRAM + 1
    while i < n:
        j = i
        while j < n and word[j:j + GRAM] in marked:
            j += 1
        if j > i:
            out.append(word[i:j + GRAM - 1])
        i = max(j, i + 1)
    return out


def _dictionaries(split: list[list[bytes]], y: np.ndarray) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary."""
    seen = Counter(), Counter()
    common: Counter[bytes] = Counter()
    for ws, label in zip(split, y, strict=True):
        seen[label].update({w[i:i + GRAM] for w in set(ws) for i in range(len(w) - GRAM + 1)})
        if not label:
            common.update(ws)
    n0, n1 = max(1, (y == 0).sum()), max(1, (y == 1).sum())
    support = max(SUPPORT, SHARE * n1)
    marked = {g for g, n in seen[1].items() if n >= support and n / n1 >= CONTRAST * (seen[0][g] + 0.5) / n0}
    strings: Counter[bytes] = Counter()
    for ws, label in zip(split, y, strict=True):
        if label:
            strings.update({s for w in set(ws) for s in _stretches(w, marked)})
    parts: list[bytes] = []
    toxic = b""
    for s, n in sorted(strings.items(), key=lambda x: (-x[1], x[0])):
        if n >= support and s not in toxic and len(toxic) < TOXIC_BYTES:
            parts.append(s)
            toxic += s
    toxic = b"".join(reversed(parts))  # the most frequent last, where references are short
    frequent = [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))]
    samples = [b"".join(frequent[i:i + 8]) for i in range(0, min(len(frequent), 40_000), 8)]
    try:
        prose = zstandard.train_dictionary(ORDINARY_BYTES, samples, k=32, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on
        prose = b"".join(samples)[:ORDINARY_BYTES]
    prose = prose or b" the of and to in is that it for was on are as with his they at be this from "
    end = prose[:HEAD]  # the last bytes of a dictionary are not indexed
    more = b"".join(reversed(frequent[:2000])) or prose
    return prose + (more[-len(toxic):] if toxic else b"") + end, prose + toxic + end


def train(sample: list[tuple[str, int]]) -> Model:
    """Dictionaries from the whole sample; the calibration sees each text under dictionaries made without it."""
    y = np.array([label for _, label in sample], int)
    rows = [t for t, _ in sample]
    split = [windows(t) for t in rows]
    x = np.zeros((len(rows), FEATURES))
    for fold in (0, 1):
        inside = np.arange(len(rows)) % 2 == fold
        if inside.any():
            made = _dictionaries([split[i] for i in np.flatnonzero(~inside)], y[~inside])
            x[inside] = Scorer(*made).features([rows[i] for i in np.flatnonzero(inside)])
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (x.sum(0), x.sum(0) + 1)
    if len(set(y.tolist())) < 2:  # one class only: the scores are constant
        weights = np.append(np.zeros(x.shape[1]), 6.0 if y.any() else -6.0)
    else:
        weights = logistic((x - mean) / scale, y)
    return Model(*_dictionaries(split, y), weights, mean, scale)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 20_000, key: str = "doc_id",
        text: str = "text", label: str = "toxic", folds: int = 3, held_out: int = 1) -> Model:
    """Learn from at most ``per_class`` toxic and twice as many ordinary texts outside the held-out fold."""
    usable = ~in_fold(key, folds, held_out)
    return train(labelled_sample(docs, labels, label, usable, {1: per_class, 0: 2 * per_class}, longest, 9, key, text))


def _scores(model: Model, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray]]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        scorer = Scorer(model.ordinary, model.toxic)
        for batch in slices(batches, text, SLICE):
            yield batch, score(model, scorer.features(texts(batch, text)))

    return run


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of every row, the whole text; a null text is an empty one, other columns are left out."""
    docs = docs.select(F.col(key), F.col(text))
    scores = _scores(model, text)

    def run(batches):
        for batch, s in scores(batches):
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(s)], [key, "score"])

    return docs.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose score is under the threshold."""
    scores = _scores(model, text)

    def run(batches):
        for batch, s in scores(batches):
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
