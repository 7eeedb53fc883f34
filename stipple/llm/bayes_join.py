"""N-gram Jaccard join with Bayesian pruning of candidates.

A text is its set of five-word shingles; texts with one set are copies and
stand behind one representative.  MinHash bands gather representatives in
buckets.  Within a bucket pairs are compared a few MinHash values at a time,
and a pair is dropped as soon as the posterior probability (uniform prior)
that its similarity reaches the threshold falls below a tolerance.  Survivors
are tied into clusters, and within a cluster every pair that survives the same
pruning is verified on the exact sets.  Large buckets and clusters meet as
pairs of bounded blocks, and blocks return counts and ties, never the pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.llm.common import free_names, slices, text_bytes
from stipple.llm.components import components
from stipple.llm.quality import word_hashes
from stipple.session import Scratch, cut

WORDS = 5
THRESHOLD, TOLERANCE = 0.8, 1e-5
#: a pair at the threshold shares a band with probability 1 - (1 - 0.8^5)^25 = 0.99995
HASHES, BANDS, ROWS = 128, 25, 5
STEP = 16
#: representatives of a bucket block, shingles of a cluster block
BUCKET_BLOCK, CLUSTER_BLOCK = 1024, 200_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_sets(raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, and where each text's begin; a text of one to four words has one shingle."""
    codes, owner = word_hashes(_LOWER[raw], places)
    codes = _mix(codes)
    n_texts = len(places) - 1
    words = np.bincount(owner, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(words)])
    if len(codes) >= WORDS:
        h = np.zeros(len(codes) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k:len(codes) - WORDS + 1 + k]
        within = owner[:len(h)] == owner[WORDS - 1:]
        h, of = _mix(h[within]), owner[:len(h)][within]
    else:
        h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((words > 0) & (words < WORDS))
    if short.size:
        few = [functools.reduce(lambda a, c: _mix(a * np.uint64(31) + c), codes[first[t]:first[t + 1]], np.array([words[t]], np.uint64))[0] for t in short]
        h, of = np.concatenate([h, np.array(few, np.uint64)]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(n_texts + 1))


def _families() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2)
    return rng.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, np.uint64)


def signatures(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values (16 bits of each) of non-empty sets."""
    a, b = _families()
    out = np.empty((len(starts) - 1, HASHES), np.uint16)
    for k in range(HASHES):
        least = np.minimum.reduceat(sets * a[k] + b[k], starts[:-1])
        out[:, k] = (_mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


@functools.cache
def needed_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After 16, 32, ... values: the least matches for which Pr(similarity >= threshold) is not below the tolerance."""
    s = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            density = m * np.log(s) + (n - m) * np.log1p(-s)
            density = np.exp(density - density.max())
            if density[s >= threshold].sum() / density.sum() >= tolerance:
                out.append(m)
                break
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, need: tuple[int, ...], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the signatures a and b that no step drops; in one block (``same``) each pair once."""
    for low in range(0, len(a), 64):
        part = a[low:low + 64]
        matches = np.zeros((len(part), len(b)), np.int16)
        for k in range(STEP):
            matches += part[:, k, None] == b[None, :, k]
        alive = matches >= need[0]
        if same:
            alive &= np.arange(low, low + len(part))[:, None] < np.arange(len(b))
        i, j = np.nonzero(alive)
        got = matches[i, j].astype(np.int32)
        for step in range(1, HASHES // STEP):
            if not i.size:
                break
            cut = slice(step * STEP, (step + 1) * STEP)
            got += (part[i, cut] == b[j, cut]).sum(1)
            stay = got >= need[step]
            i, j, got = i[stay], j[stay], got[stay]
        yield i + low, j


class Forest:
    """Union-find over a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def tie(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def ties(self) -> Iterator[tuple[int, int]]:
        for x in range(len(self.up)):
            if (r := self.root(x)) != x:
                yield x, r


def _sketch(key: str, text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1_000_000):
            sets, starts = shingle_sets(*text_bytes(batch, text))
            n = np.diff(starts)
            full = np.flatnonzero(n)
            rid = np.full(batch.num_rows, None, object)
            sig = np.full(batch.num_rows, None, object)
            if full.size:
                at = np.append(starts[full], starts[-1])
                sums = [np.add.reduceat(_mix(sets ^ np.uint64(salt)), at[:-1]) for salt in (0x5555, 0xAAAAAAAA0000)]
                for t, x, y, s in zip(full, *sums, signatures(sets, at), strict=True):
                    rid[t] = int(x).to_bytes(8, "big") + int(y).to_bytes(8, "big")
                    sig[t] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("k"), pa.array(rid, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())],
                [key, "k", "rid", "n", "sig"])

    return run


def _band_keys() -> Column:
    """A hash of each band's bytes (and the band's number) of the signature."""
    width = 2 * ROWS
    return F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(BANDS)])


def _in_block_pairs(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks of its group that its block is in: columns x <= y, and which of both is the row's."""
    own = F.pmod(F.xxhash64("rid"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")


def _members(column: pa.Array, at: int) -> pa.StructArray:
    return column[at].values


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint16).reshape(-1, HASHES)


def _tie_buckets(need: tuple[int, ...]) -> Callable:
    """Ties between the survivors of a pair of bucket blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for i in range(batch.num_rows):
                rows = _members(batch.column("rows"), i)
                ids = rows.field("rid").to_pylist()
                sig, own = _matrix(rows.field("sig")), rows.field("own").to_numpy(zero_copy_only=False)
                x, y = batch.column("x")[i].as_py(), batch.column("y")[i].as_py()
                left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
                forest = Forest(len(ids))
                for p, q in survivors(sig[left], sig[right], need, x == y):
                    for u, v in zip(left[p].tolist(), right[q].tolist(), strict=True):
                        forest.tie(u, v)
                found += [(ids[u], ids[v]) for u, v in forest.ties()]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], ["a", "b"])

    return run


def _sets(text: str) -> Callable:
    """The exact shingle set of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1_000_000):
            sets, starts = shingle_sets(*text_bytes(batch, text))
            parts = [sets[a:z].tobytes() for a, z in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("rid", "root", "sig", "copies", "blocks")), pa.array(parts, pa.binary())],
                ["rid", "root", "sig", "copies", "blocks", "shingles"])

    return run


def exact_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]],
                threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs (places in left and right) those whose sets reach the threshold."""
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    starts, sizes = ends - [len(s) for s in sets], np.array([len(s) for s in sets])
    mark = np.zeros(flat.max() + 1, np.int64)
    for p, q in pairs:
        for u in np.unique(p):
            one = left[u]
            others = right[q[p == u]]
            mine = flat[starts[one]:ends[one]]
            mark[mine] = 1
            take = np.concatenate([np.arange(starts[o], ends[o]) for o in others])
            shared = np.add.reduceat(mark[flat[take]], np.cumsum(sizes[others]) - sizes[others])
            mark[mine] = 0
            good = shared >= threshold * (sizes[one] + sizes[others] - shared) - 1e-9
            yield np.full(good.sum(), one), others[good]


def _verify(need: tuple[int, ...], threshold: float) -> Callable:
    """Per pair of cluster blocks: links of each representative, and its tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                rows = _members(batch.column("rows"), i)
                ids = rows.field("rid").to_pylist()
                copies = rows.field("copies").to_numpy(zero_copy_only=False)
                own = rows.field("own").to_numpy(zero_copy_only=False)
                sig = _matrix(rows.field("sig"))
                sets = [np.frombuffer(s, np.uint64) for s in rows.field("shingles").to_pylist()]
                x, y = batch.column("x")[i].as_py(), batch.column("y")[i].as_py()
                left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
                forest = Forest(len(ids))
                texts, docs = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                pairs = survivors(sig[left], sig[right], need, x == y)
                for u, v in exact_links(sets, left, right, pairs, threshold):
                    np.add.at(texts, u, 1)
                    np.add.at(texts, v, 1)
                    np.add.at(docs, u, copies[v])
                    np.add.at(docs, v, copies[u])
                    for s, t in zip(u.tolist(), v.tolist(), strict=True):
                        forest.tie(s, t)
                tied = dict(forest.ties())
                out += [(ids[t], ids[tied.get(t, t)], int(texts[t]), int(docs[t])) for t in range(len(ids)) if texts[t]]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                ["rid", "tie", "texts", "docs"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """key, k (hash of the text), class_id, class_k, n_copies, n_text_links, n_links of every row.

    ``class_id`` is the least key of all rows that links and copies connect,
    and with ``class_k`` it names the row that stands for them.
    ``n_copies`` counts the rows with the same shingle set, itself included;
    ``n_text_links`` the other sets within the threshold; ``n_links`` all
    other rows within it, copies included.  Texts without a word (null, empty,
    blank) are their own class without links.  Rows with a null key are
    compared like others and never give the class id.  Repeated rows are
    copies.  Other columns are left out; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "near")
    need = needed_matches(threshold, tolerance)
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key), F.col(text), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k"))
    sketches = scratch.save(slim.mapInArrow(
        _sketch(key, text), f"`{key}` {kind}, k bigint, rid binary, n bigint, sig binary"), "sketches")
    reps = scratch.save(sketches.where("rid is not null").groupBy("rid").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.when(F.col(key).isNotNull(), F.struct(key, "k"))).alias("least"),
        F.min(F.struct(key, "k")).alias("at"),
        F.first("n").alias("n"), F.first("sig").alias("sig")), "reps")

    # buckets with at least two representatives; of buckets with the same members one is enough
    bands = reps.select("rid", F.explode(_band_keys()).alias("key"))
    buckets = (bands.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("rid").cast("decimal(20,0)")).alias("members"))
               .where("m > 1").groupBy("m", "members").agg(F.min("key").alias("key")))
    blocks = F.ceil(F.col("m") / BUCKET_BLOCK)
    held = bands.join(buckets.select("key", "m"), "key").join(reps.select("rid", "sig"), "rid")
    met = _in_block_pairs(held, "key", blocks).groupBy("key", "x", "y").agg(F.collect_list(F.struct("rid", "sig", "own")).alias("rows"))
    ties = met.select("x", "y", "rows").mapInArrow(_tie_buckets(need), "a binary, b binary")
    clusters = scratch.save(components(ties), "clusters")

    # exact sets of the representatives in clusters
    sizes = clusters.join(reps.select("rid", "n"), clusters.node == reps.rid).groupBy("root").agg(F.sum("n").alias("shingles"))
    wanted = (clusters.join(sizes, "root").withColumn("blocks", F.ceil(F.col("shingles") / CLUSTER_BLOCK)).drop("shingles")
              .join(reps.select("rid", "at", "sig", "copies"), F.col("node") == F.col("rid"))
              .select("rid", "root", "sig", "copies", "blocks", F.col(f"at.{key}").alias("at_key"), F.col("at.k").alias("k")))
    found = slim.join(wanted, slim[key].eqNullSafe(wanted.at_key) & (slim.k == wanted.k)).select(
        "rid", "root", "sig", "copies", "blocks", text).dropDuplicates(["rid"])
    sets = found.mapInArrow(_sets(text), "rid binary, root binary, sig binary, copies bigint, blocks bigint, shingles binary")
    paired = _in_block_pairs(sets, "root", F.col("blocks")).groupBy("root", "x", "y").agg(
        F.collect_list(F.struct("rid", "copies", "sig", "own", "shingles")).alias("rows"))
    links = scratch.save(paired.select("x", "y", "rows").mapInArrow(
        _verify(need, threshold), "rid binary, tie binary, texts bigint, docs bigint"), "links")
    classes = components(links.select(F.col("rid").alias("a"), F.col("tie").alias("b")))
    counted = links.groupBy("rid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))

    named = (reps.select("rid", "copies", "least", "at").join(counted, "rid", "left")
             .join(classes.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid")))
    first = named.groupBy("root").agg(F.coalesce(F.min("least"), F.min("at")).alias("first"))
    named = scratch.save(named.join(first, "root").select(
        "rid", F.col(f"first.{key}").alias("class_id"), F.col("first.k").alias("class_k"), "copies", "texts", "docs"), "named")
    rows = sketches.select(key, "k", "rid").join(named, "rid", "left")
    return rows.select(
        key, "k", F.when(F.col("rid").isNull(), F.col(key)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_k", "k").alias("class_k"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"), F.coalesce("texts", F.lit(0)).cast("bigint").alias("n_text_links"),
        (F.coalesce("docs", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns: of each class the row of least key, one where equal rows share it.

    Rows without a word in their text (null, empty, blank) have no class and
    all stay.  Columns may have any name; an empty table gives an empty one.
    """
    name, same, many, own = free_names(docs.columns, "name", "same", "many", "own")
    near = near_duplicates(docs, threshold, tolerance, key, text)
    first = F.col(key).eqNullSafe(F.col("class_id")) & (F.col("k") == F.col("class_k"))
    stays = near.where(first).groupBy(F.col(key).alias(name), F.col("k").alias(same)).agg(F.count(F.lit(1)).alias(many))
    stays = cut(stays, "stays")
    words = F.coalesce(F.col(text), F.lit(""))
    wordless = ~words.rlike(r"[^\x09-\x0D ]")
    marked = docs.where(~wordless).withColumn(own, F.xxhash64(words))
    kept = marked.join(stays, F.col(key).eqNullSafe(F.col(name)) & (F.col(own) == F.col(same)))
    single = kept.where(F.col(many) == 1).select(*docs.columns)
    repeated = kept.where(F.col(many) > 1).dropDuplicates([name, same]).select(*docs.columns)
    return single.unionByName(repeated).unionByName(docs.where(wordless))
