"""Near copies among embeddings by spherical-cap filters.

Filter directions form random product codes: a rotated space is cut into
parts, every part has its own random code words, and a direction is one word
of each.  Several rotations keep the directions from crowding.  A vector
belongs to the filters whose direction it exceeds; list decoding finds them
part by part without looking at the others.  Vectors that meet in a filter are
compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm.components import components
from stipple.session import Scratch

#: least cosine of a link
THRESHOLD = 0.9
#: share of pairs at the threshold that meet in a filter
RECALL = 0.99
#: vectors for each of the filters, of which there are so many at least
SHARE, FEWEST = 16, 1024
#: rotations, and code words of a part at most
TURNS, WORDS = 16, 1024
#: vectors of a filter that one task compares at once with as many others
BLOCK = 1024
#: vectors decoded at once
STRIP = 256


class Code:
    """Product codes of ``words`` ** ``parts`` directions in each of ``turns`` rotations; ``level`` is the height of the caps."""

    def __init__(self, width: int, wanted: int, seed: int = 0, turns: int = TURNS):
        rng = np.random.default_rng([seed, width])
        self.parts = min(width, max(2, int(np.ceil(np.log(wanted / turns) / np.log(WORDS)))))
        self.words = max(2, int(np.ceil((wanted / turns) ** (1 / self.parts))))
        self.cuts = np.linspace(0, width, self.parts + 1).astype(int)
        self.turns, self.books = [], []
        for _ in range(turns):
            self.turns.append(np.linalg.qr(rng.standard_normal((width, width)))[0])
            books = [rng.standard_normal((self.words, b - a)) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
            self.books.append([(k / np.linalg.norm(k, axis=1, keepdims=True) / np.sqrt(self.parts)).T for k in books])
        self.level = 0.0

    def decode(self, x: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all directions with an inner product of at least ``level``, by row and filter."""
        found = [self._decode(x @ turn, books, level) for turn, books in zip(self.turns, self.books)]
        size = self.words ** self.parts
        row = np.concatenate([r for r, _ in found])
        code = np.concatenate([c + i * size for i, (_, c) in enumerate(found)])
        order = np.lexsort((code, row))
        return row[order], code[order]

    def _decode(self, y: np.ndarray, books: list[np.ndarray], level: float) -> tuple[np.ndarray, np.ndarray]:
        hits = [y[:, a:b] @ book for a, b, book in zip(self.cuts[:-1], self.cuts[1:], books)]
        rest = np.zeros((self.parts + 1, len(y)))
        for i in reversed(range(self.parts)):
            rest[i] = rest[i + 1] + hits[i].max(axis=1)
        row, code, held = np.arange(len(y)), np.zeros(len(y), np.int64), np.zeros(len(y))
        for i, h in enumerate(hits):
            # words that can reach the level with the best beginning and the best end, then their combinations
            best = np.full(len(y), -np.inf)
            np.maximum.at(best, row, held)
            r, word = np.nonzero(h >= (level - rest[i + 1] - best)[:, None])
            first = np.searchsorted(r, row)
            many = np.searchsorted(r, row, "right") - first
            at = np.repeat(np.arange(len(row)), many)
            pick = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + first[at]
            total = held[at] + h[row[at], word[pick]]
            keep = total >= level - rest[i + 1][row[at]]
            at, pick = at[keep], pick[keep]
            row, code, held = row[at], code[at] * self.words + word[pick], total[keep]
        return row, code

    def fit(self, threshold: float, recall: float, pairs: int = 2000, seed: int = 1) -> "Code":
        """The highest level at which random pairs at the threshold share a filter as often as ``recall`` asks."""
        rng = np.random.default_rng([seed, self.cuts[-1]])
        x, z = (rng.standard_normal((pairs, self.cuts[-1])) for _ in range(2))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(z, axis=1, keepdims=True)
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * np.divide(z, size, out=np.zeros_like(z), where=size > 0)

        def met(level: float) -> float:
            found = 0
            for at in range(0, pairs, STRIP):
                a, b = (self.decode(v[at:at + STRIP], level) for v in (x, y))
                n = len(self.turns) * self.words ** self.parts
                both = np.intersect1d(a[0] * n + a[1], b[0] * n + b[1])
                found += len(np.unique(both // n))
            return found / pairs

        low, high = 0.9, 1.0
        while low > -1.0 and met(low) < recall:  # long lists come last
            high, low = low, low - 0.05
        for _ in range(6):
            mid = (low + high) / 2
            low, high = (mid, high) if met(mid) >= recall else (low, mid)
        self.level = low
        return self


def _read(key: str, vector: str, single: bool):
    """Key, digest and bytes of the vector; null unless it has only finite components and is not zero."""
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, raws = [], []
            for v in batch.column(vector):
                raw = None
                if v.is_valid and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
                    if len(x) and np.isfinite(x).all() and x.any():
                        raw = x.tobytes()
                raws.append(raw)
                digests.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], names=["key", "same", "raw"])
    return run


def _units(raws: list[bytes], kind) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _decoded(code, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                piece = batch.slice(at, STRIP)
                row, filt = code.value.decode(_units(piece.column("raw").to_pylist(), kind), code.value.level)
                offsets = pa.array(np.searchsorted(row, np.arange(piece.num_rows + 1)), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(filt, pa.int64()))
                yield pa.RecordBatch.from_arrays([*piece.columns, lists], names=[*piece.schema.names, "filters"])
    return run


def _labels(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least place of the connected part of every place."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, p, label[q])
        np.minimum.at(new, q, label[p])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _first_met(lists: np.ndarray, p: np.ndarray, q: np.ndarray, here: int) -> np.ndarray:
    """Whether no filter before ``here`` holds both: a pair counts in the first filter it shares."""
    lists = np.where(lists < here, lists, -1)
    lists = lists[:, (lists >= 0).any(axis=0)]
    out = np.ones(len(p), bool)
    step = max(1, 4_000_000 // max(1, lists.shape[1] ** 2))
    for at in range(0, len(p), step):
        a, b = lists[p[at:at + step]], lists[q[at:at + step]]
        out[at:at + step] = ~((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any(axis=(1, 2))
    return out


def _compared(kind, threshold: float):
    """Links of the runs of equal (filter, i, j) in sorted batches: for each linked row its links that are met here
    first, and the least row it is connected with here."""

    def one(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        i, j, here = (t.column(c)[0].as_py() for c in ("i", "j", "filter"))
        x = _units(t.column("raw").to_pylist(), kind)
        if i == j:
            p, q = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        else:
            blk = t.column("blk").to_numpy()
            a, b = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
            p, q = np.nonzero(x[a] @ x[b].T >= threshold)
            p, q = a[p], b[q]
        if not len(p):
            return None
        label = _labels(len(x), p, q)
        lens = t.column("filters").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        lists = np.full((len(x), lens.max()), -1, np.int64)
        lists[np.repeat(np.arange(len(x)), lens), np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)] = (
            t.column("filters").combine_chunks().flatten().to_numpy(zero_copy_only=False))
        new = _first_met(lists, p, q, here)
        copies = t.column("copies").to_numpy()
        links, texts = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for u, v in ((p[new], q[new]), (q[new], p[new])):
            np.add.at(links, u, copies[v])
            np.add.at(texts, u, 1)
        rows = np.unique(np.concatenate([p, q]))
        return rows, label[rows], links[rows], texts[rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None

        def work(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a > 1 and (got := one(t.slice(a, b - a))) is not None:
                    out.append((got[0] + a, got[1] + a, got[2], got[3]))
            if out:
                rows, roots, links, texts = (np.concatenate(c) for c in zip(*out))
                nodes, ends = t.take(pa.array(rows)), t.take(pa.array(roots))
                yield pa.RecordBatch.from_arrays(
                    [*(x.column(c).combine_chunks() for x in (nodes, ends) for c in ("rep", "same")), pa.array(links), pa.array(texts)],
                    names=["rep", "same", "rep2", "same2", "links", "texts"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t]).combine_chunks()
            keys = np.stack([t.column(c).to_numpy() for c in ("filter", "i", "j")])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if t.num_rows else np.zeros(1, int)
            yield from work(t, starts)
            left = t.slice(starts[-1])
        if left is not None and left.num_rows > 1:
            yield from work(left, np.array([0, left.num_rows]))
    return run


def links(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "vec_id",
          vector: str = "embedding", block: int = BLOCK, seed: int = 0) -> DataFrame:
    """key, n_links, n_text_links, component_id, kept of every row.

    Two rows are linked if the cosine of their vectors is ``threshold`` or
    more; of pairs at the threshold a share of ``recall`` is found, of nearer
    ones more, and equal vectors always.  ``n_links`` counts the linked other
    rows, ``n_text_links`` the linked other vectors that differ;
    ``component_id`` is the least key reachable over links, ``kept`` marks it.

    Vectors that are null, empty, zero or hold a null or a number that is not
    finite, and those of another width than most (of equally frequent widths
    the smaller), have no link and are their own component.  So are rows with
    a null key, which no other row is linked with; their component_id is
    null.  Rows that share a key are rows of their own, and all are kept if
    one is.  Other columns are left out, whatever their names; an empty table
    gives an empty one.
    """
    spark = vectors.sparkSession
    store = Scratch(spark, "caps")
    kind, inner = vectors.schema[key].dataType.simpleString(), vectors.schema[vector].dataType.simpleString()
    single = "float" in inner
    number = np.float32 if single else np.float64
    rows = store.save(vectors.select(F.col(key), F.col(vector).cast(f"array<{'float' if single else 'double'}>")).mapInArrow(
        _read(key, vector, single), f"key {kind}, same binary, raw binary"), "rows")
    usable = rows.where("key is not null and same is not null").withColumn("width", F.length("raw") / number().itemsize)
    most = usable.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    width = int(most["width"]) if most else 1
    # equal vectors are one from here on
    classes = store.save(usable.where(F.col("width") == width).groupBy("same").agg(
        F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw")), "classes")
    code = Code(width, max(FEWEST, classes.count() // SHARE), seed).fit(threshold, recall)
    decoded = store.save(classes.mapInArrow(
        _decoded(spark.sparkContext.broadcast(code), number),
        f"same binary, rep {kind}, copies bigint, raw binary, filters array<bigint>"), "decoded")

    # a filter of many vectors is split: every pair of its blocks is compared on its own
    crowded = decoded.select(F.explode("filters").alias("filter")).groupBy("filter").count().where(F.col("count") > block)
    crowded = store.save(crowded.select("filter", F.ceil(F.col("count") / block).cast("int").alias("nb")), "crowded")
    parts = F.coalesce("nb", F.lit(1))
    met = decoded.select("*", F.explode("filters").alias("filter")).join(crowded, "filter", "left").withColumn(
        "blk", F.pmod(F.xxhash64("same"), parts).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = met.select("filter", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "rep", "same", "copies", "raw", "filters")
    met = met.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j", "rep", "same")
    ties = store.save(met.mapInArrow(
        _compared(number, threshold), f"rep {kind}, same binary, rep2 {kind}, same2 binary, links bigint, texts bigint"), "ties")

    parted = components(ties.select(F.struct("rep", "same").alias("a"), F.struct(F.col("rep2").alias("rep"), F.col("same2").alias("same")).alias("b")))
    found = ties.groupBy("same").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts")).join(
        parted.select("node.same", F.col("root.rep").alias("root")), "same")
    by_class = classes.drop("raw").join(found, "same", "left").select(
        F.col("same").alias("of"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
        F.coalesce("texts", F.lit(0)).alias("t"), F.coalesce("root", "rep").alias("root"))
    own = rows.select("key", F.when(F.col("key").isNotNull(), F.col("same")).alias("same"))
    return own.join(by_class, F.col("same") == F.col("of"), "left").select(
        F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("t", F.lit(0)).cast("bigint").alias("n_text_links"), F.coalesce("root", "key").alias("component_id"),
    ).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


LINKS_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), TRUE)
    AND list_contains(list_transform(embedding, lambda x: x <> 0), TRUE)),
l AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id a, vec_id b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) n_links, component_id, vec_id = component_id kept
FROM embeddings JOIN (SELECT a, min(b) component_id FROM reach GROUP BY a) ON a = vec_id
"""
