"""Ranked lexical search of many items at once, sharing what the items have in common.

A document's score for an item is a sum over the item's terms, so items that
share terms share partial sums.  The shared term sets are mined once per block
of items: terms that stand in the same items form one set, and neighbours in
the items' frequency-ordered lists of sets are joined as long as a pair occurs
in two items.  The result is a graph whose nodes are partial sums.  Documents
pass it in batches: every node's accumulators are filled once and feed all
nodes and items above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.llm.common import slices
from stipple.session import Scratch

#: characters of distinct item texts that one pass over the documents takes, one longer item excepted
BLOCK_CHARS = 2_000_000
#: bytes of text that a task cuts into terms at once
SLICE = 500_000
#: accumulators that a task holds
HELD = 2_000_000
#: tasks whose best rows meet before all meet
MEET = 256
#: what a byte of a term becomes; other ASCII separates terms
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def cut_terms(data: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and bytes of other characters, A-Z in lower case."""
    return (data or b"").translate(FOLD).split()


def weight(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def gain(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one occurrence of a term in an item adds to the score of a document, for weight 1."""
    m = 75 + (25 * n * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Sharing:
    """Graph of partial sums of a block of items.

    Leaf i is term ``leaf_term[i]`` taken ``leaf_times[i]`` times, a part of
    node ``leaf_node[i]``.  Nodes below ``n_sets`` are sets of leaves; ``layers``
    has the others, arrays (left, right) whose sums are the next nodes.  Item
    j is the sum of the nodes ``item_nodes[item_from[j]:item_from[j + 1]]``.
    """

    def __init__(self, counts: list[list[tuple[int, int]]]):
        leaves: dict[tuple[int, int], int] = {}
        owner = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        leaf = np.array([leaves.setdefault(x, len(leaves)) for c in counts for x in c], np.int64)
        self.leaf_term, self.leaf_times = (np.array([x[i] for x in leaves], np.int64) for i in (0, 1))
        self.leaf_node, in_items = self._sets(owner, leaf)
        self.n_sets = len(in_items)
        seen = np.unique(np.stack([owner, self.leaf_node[leaf] if len(leaf) else leaf]), axis=1)
        # sets of many items first: items that share them share the head of their lists
        order = np.lexsort((seen[1], -in_items[seen[1]], seen[0]))
        self._pair_up(seen[0][order], seen[1][order], len(counts))

    @staticmethod
    def _sets(owner: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Set of every leaf (leaves with equal lists of items are a set), and in how many items each set is."""
        known: dict[bytes, int] = {}
        order = np.lexsort((owner, leaf))
        owners, starts = owner[order], np.flatnonzero(np.diff(leaf[order], prepend=-1))
        lists = np.split(owners, starts[1:]) if len(leaf) else []
        node = np.array([known.setdefault(x.tobytes(), len(known)) for x in lists], np.int64)
        return node, np.array([len(k) // 8 for k in known], np.int64)

    def _pair_up(self, owner: np.ndarray, node: np.ndarray, n_items: int) -> None:
        self.layers, at = [], self.n_sets
        while len(node) > 1:
            pair = np.where(owner[1:] == owner[:-1], node[:-1] * at + node[1:], -1)
            _, code, times = np.unique(pair, return_inverse=True, return_counts=True)
            worth = np.where(pair >= 0, times[code], 0).astype(np.int64) * len(times) + code
            # a place is taken if its pair is more frequent than the pairs it overlaps
            top = (pair >= 0) & (times[code] >= 2)
            top[1:] &= worth[1:] > worth[:-1]
            top[:-1] &= worth[:-1] > worth[1:]
            kept = np.bincount(code[top], minlength=len(times)) >= 2
            top &= kept[code]
            if not top.any():
                break
            first = np.flatnonzero(top)
            made, new = np.unique(pair[first], return_inverse=True)
            self.layers.append((made // at, made % at))
            node = node.copy()
            node[first] = at + new
            stay = np.ones(len(node), bool)
            stay[first + 1] = False
            owner, node, at = owner[stay], node[stay], at + len(made)
        self.n_nodes = at
        self.item_nodes, self.item_from = node, np.searchsorted(owner, np.arange(n_items + 1))

    def scores(self, term_gains: np.ndarray, term: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Items x documents from the (term, document) entries that are not zero."""
        held = np.zeros((self.n_nodes, n_docs), np.int64)
        by_term = np.argsort(self.leaf_term, kind="stable")
        sorted_terms = self.leaf_term[by_term]
        low, high = np.searchsorted(sorted_terms, term), np.searchsorted(sorted_terms, term, "right")
        entry = np.repeat(np.arange(len(term)), high - low)
        leaf = by_term[np.arange(len(entry)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[entry]]
        np.add.at(held, (self.leaf_node[leaf], doc[entry]), self.leaf_times[leaf] * term_gains[entry])
        at = self.n_sets
        for left, right in self.layers:
            np.add(held[left], held[right], out=held[at:at + len(left)])
            at += len(left)
        out = np.zeros((len(self.item_from) - 1, n_docs), np.int64)
        for j, (a, b) in enumerate(zip(self.item_from[:-1], self.item_from[1:])):
            if b > a:
                out[j] = held[self.item_nodes[a:b]].sum(axis=0)
        return out

    def additions(self) -> int:
        """Additions of accumulators that a document needs."""
        return int(len(self.leaf_term) - self.n_sets + sum(len(x) for x, _ in self.layers) + (np.diff(self.item_from) - 1).clip(0).sum())


def _postings(key: str, text: str, vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary.value)}
        for piece in slices(batches, text, SLICE):
            found, sizes, lengths = [], [], []
            for data in piece.column(text).cast(pa.large_binary()).to_pylist():
                terms = cut_terms(data)
                known = [i for i in map(number.get, terms) if i is not None]
                found += known
                sizes.append(len(known))
                lengths.append(len(terms))
            doc = np.repeat(np.arange(piece.num_rows), sizes)
            code, tf = np.unique(doc * len(number) + np.array(found, np.int64), return_counts=True)
            row = code // max(len(number), 1)
            offsets = pa.array(np.searchsorted(row, np.arange(piece.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (code % max(len(number), 1), tf)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(key), pa.array(lengths, pa.int64()), *lists], names=["key", "n", "term", "tf"])
    return run


def _best(graph, weights, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, w = graph.value, weights.value
        n_items = len(share.item_from) - 1
        floor = np.ones(n_items, np.int64)
        best = None
        step = max(16, HELD // (share.n_nodes + n_items + 1))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                lens = piece.column("term").value_lengths().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(piece.num_rows), lens)
                term, tf = (piece.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("term", "tf"))
                n = piece.column("n").to_numpy(zero_copy_only=False)[doc]
                score = share.scores(w[term] * gain(tf, n, n_docs, n_terms), term, doc, piece.num_rows)
                bar = floor
                if piece.num_rows > k:
                    bar = np.maximum(floor, np.partition(score, piece.num_rows - k, axis=1)[:, piece.num_rows - k])
                item, at = np.nonzero(score >= bar[:, None])
                found = pa.table({"item": pa.array(item, pa.int32()), "key": piece.column("key").take(pa.array(at)),
                                  "score": pa.array(score[item, at])})
                best = found if best is None else pa.concat_tables([best, found]).combine_chunks()
                order = pa.compute.sort_indices(best, sort_keys=[("item", "ascending"), ("score", "descending"), ("key", "ascending")])
                item = best.column("item").to_numpy()[order.to_numpy()]
                place = np.arange(len(item)) - np.searchsorted(item, item)
                best = best.take(order.filter(pa.array(place < k)))
                item, score = best.column("item").to_numpy(), best.column("score").to_numpy()
                full = np.flatnonzero(np.arange(len(item)) - np.searchsorted(item, item) == k - 1)
                floor[item[full]] = np.maximum(score[full], 1)
        if best is not None:
            yield from best.combine_chunks().to_batches()
    return run


def _top(rows: DataFrame, k: int, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(texts: DataFrame, limit: int) -> int:
    """Number of hash blocks such that none is over ``limit`` characters without its longest text."""
    n = 1
    while True:
        sizes = texts.groupBy(F.pmod(F.xxhash64("item"), F.lit(n)).alias("b")).agg(
            (F.sum(F.length("text")) - F.max(F.length("text"))).alias("s")).agg(F.max("s")).first()[0] or 0
        if sizes <= limit:
            return n
        n *= 2


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", item: str = "item_id", text: str = "text",
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The k best documents of every item: item, rank, key, score, of scores above 0.

    Items of one text share one ranking, whatever their number.  A null,
    empty or termless text of an item finds nothing, one of a document is
    never found and does not count as a document.  Equal scores go by key, a
    null key last; rows of one key are documents of their own.  Every row of
    ``items`` gets its ranks, also where an item id repeats.  Only the named
    columns are read, so others may have any name; empty tables give none.

    The documents are read once per block of items, the terms that a block
    asks for are counted into a written table, and the graph of the block and
    its terms go to the tasks (bounded by ``block_chars`` and one item).
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    store = Scratch(spark, "lexical")
    names = store.save(items.select(F.col(item).alias("id"), F.sha2(F.col(text), 256).alias("item"), F.col(text).alias("text")), "items")
    texts = store.save(names.where("item is not null").groupBy("item").agg(F.first("text").alias("text")), "texts")
    kind = docs.schema[key].dataType.simpleString()
    blocks = _blocks(texts, block_chars)
    found = None
    for b in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item").collect()  # a block
        cut = [cut_terms(r["text"].encode()) for r in rows]
        vocabulary = sorted({t for terms in cut for t in terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        counted = [np.unique([number[t] for t in terms], return_counts=True) for terms in cut]
        graph = Sharing([[(int(t), int(c)) for t, c in zip(*pair)] for pair in counted])
        if not vocabulary:
            continue
        postings = store.save(docs.select(F.col(key), F.col(text)).mapInArrow(
            _postings(key, text, context.broadcast(vocabulary)),
            f"key {kind}, n bigint, term array<int>, tf array<int>").where("n > 0"), f"postings{b}")
        n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in postings.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # a row per term of the block
            df[r["t"]] = r["count"]
        local = postings.mapInArrow(
            _best(context.broadcast(graph), context.broadcast(weight(df, n_docs)), n_docs, n_terms, k),
            f"item int, key {kind}, score bigint").withColumn("slot", F.expr(f"spark_partition_id() div {MEET}"))
        best = _top(_top(local, k, ["item", "slot"]), k, ["item"])
        digests = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], "item int, digest string")
        part = store.save(best.join(digests, "item").select(F.col("digest").alias("item"), "rank", "key", "score"), f"best{b}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"item string, rank int, key {kind}, score bigint")
    return names.select("id", "item").join(found, "item").select(
        F.col("id").alias(item), "rank", F.col("key").alias(key), "score")


def search_sql(k: int = 20) -> str:
    """DuckDB text of the search of ``documents`` for the items of ``benchmark``."""
    def terms(table: str, key: str) -> str:
        return (f"SELECT {key}, term, count(*) c FROM (SELECT {key}, unnest(regexp_extract_all(translate(text, "
                "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                rf"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term FROM {table}) GROUP BY ALL")

    return f"""
WITH q AS ({terms("benchmark", "item_id")}), d AS ({terms("documents", "doc_id")}),
n AS (SELECT doc_id, CAST(sum(c) AS BIGINT) n FROM d GROUP BY ALL),
a AS (SELECT count(*) nd, CAST(sum(n) AS BIGINT) l FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(nd AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) w FROM d, a GROUP BY term, nd),
m AS (SELECT doc_id, 75 + (25 * n * nd) // l m FROM n, a),
s AS (SELECT item_id, doc_id, CAST(sum(q.c * w * ((1000000000 * d.c) // (1000 * d.c + 12 * m))) AS BIGINT) score
  FROM q JOIN d USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) "rank", doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) rank FROM s WHERE score > 0) WHERE rank <= {k}
"""
