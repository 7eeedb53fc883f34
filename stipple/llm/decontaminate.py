"""Benchmark passages in documents, by edit distance.

A passage is found where a stretch of the document is within ``max_edit`` x
length edits of an item (ASCII case and kinds of white space aside).

* Windows.  An item is cut into pieces of eight bytes; an edit touches one
  piece, so a copy with k edits keeps all but k of them, and their places
  agree within k characters (counted as wide as the item's widest one).
  Item-sized windows start where the document holds so many pieces.
* Candidates.  Windows and items are embedded by the random walk of
  Chakraborty, Goldenberg and Koucky: at each step the character under the
  pointer is output and a random bit of (step, character) says whether the
  pointer moves, so strings at a small edit distance agree in most steps.
  Tables of sampled steps (bit-sampling LSH) over several walks give the
  candidate pairs; their number is set from the agreement measured on edited
  items so that the target recall is reached.
* Verification.  Bit-parallel edit distance of the item against the window
  with its surroundings.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm.common import slices, text_bytes

PIECE = 8
MAX_EDIT = 0.1
RECALL = 0.99
#: steps that one table samples, walks that the tables are spread over
SAMPLED, WALKS = 4, 16
#: characters of benchmark text that tasks hold at once; a larger benchmark is taken in several passes
PASS_CHARS = 8_000_000
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD_TEXT = {i: int(FOLD[i]) for i in range(128)}
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MASK_BITS = 20


def fold(text: str) -> str:
    """Text of the same length with ASCII letters in lower case and one kind of white space."""
    return text.translate(_FOLD_TEXT)


def pieces(data: bytes) -> list[int]:
    """Starts of disjoint pieces, each at the first character not yet begun by the last piece."""
    out, at = [], 0
    while at + PIECE <= len(data):
        out.append(at)
        at += PIECE
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
    return out


def edits_allowed(chars: int, n_pieces: int, max_edit: float) -> int:
    """Edits up to the share, but fewer than there are pieces."""
    return min(int(max_edit * chars), n_pieces - 1)


def walks(chars: np.ndarray, steps: int) -> np.ndarray:
    """Characters that each of the walks over the rows of ``chars`` (0 beyond the end) outputs at each step: step, row, walk."""
    moves = np.random.default_rng(7).integers(0, 2, (steps, WALKS, 256), np.uint8)
    width = chars.shape[1] + 1
    flat = np.append(chars, np.zeros((len(chars), 1), chars.dtype), 1).ravel()  # the last place of a row is never left
    kind = (flat.astype(np.uint64) * _MIX >> np.uint64(56)).astype(np.int32)
    first = np.repeat(np.arange(len(chars)) * width, WALKS)
    at, last = first.copy(), first + width - 1
    number = np.tile(np.arange(WALKS) * 256, len(chars))
    out = np.empty((steps, len(at)), chars.dtype)
    for step in range(steps):
        np.take(flat, at, out=out[step])
        at += moves[step].ravel()[number + kind[at]]
        np.minimum(at, last, out=at)
    return out.reshape(steps, len(chars), WALKS)


def padded(rows: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.uint32)
    for i, t in enumerate(rows):
        codes = np.frombuffer(t[:width].encode("utf-32-le"), np.uint32)
        out[i, :len(codes)] = codes
    return out


def edited(text: str, edits: int, rng: np.random.Generator) -> str:
    """``text`` after random substitutions, insertions and deletions with its own characters."""
    t = list(text)
    for _ in range(edits):
        at, kind = int(rng.integers(len(t))), int(rng.integers(3))
        c = text[int(rng.integers(len(text)))]
        if kind == 0:
            t[at] = c
        elif kind == 1:
            t.insert(at, c)
        elif len(t) > 1:
            del t[at]
    return "".join(t)


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a stretch of the text, and the first end of such a stretch (Myers)."""
    m = len(pattern)
    ones, top = (1 << m) - 1, 1 << m - 1
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    plus, minus, score = ones, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        x = eq | minus
        d = ((x & plus) + plus ^ plus) | x
        h = minus | ~(d | plus) & ones
        v = plus & d
        if h & top:
            score += 1
        elif v & top:
            score -= 1
        h, v = h << 1 & ones, v << 1 & ones
        plus = v | ~(x | h) & ones
        minus = h & x
        if score < best:
            best, end = score, j + 1
    return best, end


def locate(pattern: str, text: str) -> tuple[int, int, int]:
    """(distance, begin, end) of the best stretch."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    distance, end = best_match(pattern, text)
    _, back = best_match(pattern[::-1], text[:end][::-1])
    return distance, end - back, end


@dataclass
class LengthClass:
    """Items of similar length: their tables of sampled steps."""

    steps: int
    width: int
    tables: list[tuple[int, np.ndarray]]  # walk, sampled steps
    buckets: list[dict[bytes, list[int]]]

    def keys(self, rows: list[str]) -> Iterator[tuple[int, list[bytes]]]:
        out = walks(padded(rows, self.width), self.steps)
        for n, (w, sampled) in enumerate(self.tables):
            flat = np.ascontiguousarray(out[sampled, :, w].T).view(np.dtype((np.void, 4 * len(sampled)))).ravel()
            yield n, flat.tolist()

    def candidates(self, rows: list[str]) -> list[set[int]]:
        out: list[set[int]] = [set() for _ in rows]
        for n, keys in self.keys(rows):
            for found, key in zip(out, keys, strict=True):
                found.update(self.buckets[n].get(key, ()))
        return out


@dataclass
class Index:
    """What tasks need of the benchmark."""

    ids: list[int]
    texts: list[str]
    sizes: np.ndarray  # bytes
    allowed: np.ndarray  # edits
    shift: np.ndarray  # bytes that these edits move what follows, at most
    needed: np.ndarray  # pieces
    codes: np.ndarray  # distinct pieces as numbers, sorted
    first: np.ndarray  # into item and offset
    item: np.ndarray
    offset: np.ndarray
    of_class: list[int]
    classes: dict[int, LengthClass] = field(default_factory=dict)

    def mask(self) -> np.ndarray:
        out = np.zeros(1 << _MASK_BITS, bool)
        out[_slot(self.codes)] = True
        return out


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * _MIX >> np.uint64(64 - _MASK_BITS)).astype(np.int32)


def tables_needed(meeting: float, recall: float) -> int:
    """Tables after which a pair has met with probability ``recall``, where it meets in one with probability ``meeting``."""
    p = min(max(meeting, 1e-3), 0.999)
    return max(WALKS, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def build(items: list[tuple[int, str]], max_edit: float = MAX_EDIT, recall: float = RECALL) -> Index:
    """Pieces and tables of the items; empty ones and those under one piece are left out."""
    items = [(i, fold(t)) for i, t in items if t and len(t.encode()) >= PIECE]
    found: list[tuple[int, int, int]] = []
    sizes, allowed, shift, needed, of_class = [], [], [], [], []
    for n, (_, t) in enumerate(items):
        data = t.encode()
        starts = pieces(data)
        found += [(int.from_bytes(data[s:s + PIECE], "little"), n, s) for s in starts]
        k = edits_allowed(len(t), len(starts), max_edit)
        sizes.append(len(data))
        allowed.append(k)
        shift.append(k * max(len(c.encode()) for c in set(t)))
        needed.append(len(starts) - k)
        of_class.append(int(2 * math.log2(len(t))))
    found.sort()
    all_codes = np.array([c for c, _, _ in found], np.uint64)
    codes, first = np.unique(all_codes, return_index=True)
    index = Index([i for i, _ in items], [t for _, t in items], np.array(sizes, np.int64), np.array(allowed, np.int64),
                  np.array(shift, np.int64), np.array(needed, np.int64), codes, np.append(first, len(found)),
                  np.array([n for _, n, _ in found], np.int64), np.array([s for _, _, s in found], np.int64), of_class)
    rng = np.random.default_rng(10)
    for c in sorted(set(of_class)):
        own = [n for n, k in enumerate(of_class) if k == c]
        width = max(len(items[n][1]) for n in own)
        steps = min(len(items[n][1]) for n in own)
        rows = [items[n][1] for n in own]
        probe = [int(i) for i in rng.integers(0, len(rows), 60)]
        changed = [edited(rows[i], allowed[own[i]], rng) for i in probe]
        agree = (walks(padded([rows[i] for i in probe], width), steps) == walks(padded(changed, width), steps)).mean(0)
        n_tables = tables_needed(float(np.percentile((agree ** SAMPLED).mean(1), 5)), recall)
        tables = [(n % WALKS, np.sort(rng.choice(steps, min(SAMPLED, steps), replace=False))) for n in range(n_tables)]
        made = LengthClass(steps, width, tables, [defaultdict(list) for _ in tables])
        for n, keys in made.keys(rows):
            for item, key in zip(own, keys, strict=True):
                made.buckets[n][key].append(item)
        made.buckets = [dict(b) for b in made.buckets]
        index.classes[c] = made
    return index


def windows(index: Index, mask: np.ndarray, raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item whose pieces are there, first byte) of the windows that hold enough pieces of an item."""
    hits = []
    for o in range(min(PIECE, max(0, raw.size - PIECE + 1))):
        n = (raw.size - o) // PIECE
        codes = raw[o:o + n * PIECE].view(np.uint64)
        maybe = np.flatnonzero(mask[_slot(codes)])
        if maybe.size:
            k = np.searchsorted(index.codes, codes[maybe])
            k[k == len(index.codes)] = 0
            sure = index.codes[k] == codes[maybe]
            hits.append(np.stack([maybe[sure] * PIECE + o, k[sure]]))
    if not hits:
        return (np.zeros(0, np.int64),) * 3
    at, code = np.concatenate(hits, 1)
    times = index.first[code + 1] - index.first[code]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    entry = np.repeat(index.first[code], times) + nth
    at, item = np.repeat(at, times), index.item[entry]
    text = np.searchsorted(places, at, "right") - 1
    inside = at + PIECE <= places[text + 1]
    text, item, start = text[inside], item[inside], (at - index.offset[entry])[inside]
    order = np.lexsort((start, item, text))
    text, item, start = text[order], item[order], start[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])
    run = np.flatnonzero(new)  # pieces that agree on one start
    size = np.diff(np.append(run, len(text)))
    far = np.arange(len(text)) + index.needed[item] - 1
    ok = far < len(text)
    far = np.where(ok, far, 0)
    ok &= (text[far] == text) & (item[far] == item) & (start[far] - start <= index.shift[item])
    found = set()
    of_run = np.cumsum(new) - 1
    for i in np.flatnonzero(ok & new):  # the start that most of the pieces in reach agree on
        a, z = of_run[i], of_run[far[i]]
        best = run[a + int(size[a:z + 1].argmax())]
        found.add((int(text[best]), int(item[best]), int(start[best])))
    out = np.array(sorted(found), np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def find(index: Index, mask: np.ndarray, raw: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, first byte, byte after the last) of the best place of each item in each text."""
    raw = FOLD[raw]
    text, item, start = windows(index, mask, raw, places)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    classes = np.array(index.of_class)[item] if item.size else item
    for c in sorted(set(classes.tolist())):
        own = np.flatnonzero(classes == c)
        lows = places[text[own]]
        begin = np.maximum(start[own], lows)
        rows = [raw[b:min(b + index.sizes[n], e)].tobytes().decode(errors="ignore")
                for b, n, e in zip(begin, item[own], places[text[own] + 1], strict=True)]
        for w, b, candidates in zip(own, begin, index.classes[c].candidates(rows), strict=True):
            t, n = int(text[w]), int(item[w])
            if n in candidates:  # others have windows of their own wherever they are near enough
                slack = 2 * int(index.shift[n]) + 4
                low, high = max(int(places[t]), int(b) - slack), min(int(places[t + 1]), int(b) + int(index.sizes[n]) + slack)
                around = raw[low:high].tobytes()
                lead = next((i for i, x in enumerate(around[:4]) if x & 0xC0 != 0x80), 0)
                around_text = around[lead:].decode(errors="ignore")
                distance, s, e = locate(index.texts[n], around_text)
                if distance <= index.allowed[n]:
                    s = low + lead + len(around_text[:s].encode()) - int(places[t])
                    e = low + lead + len(around_text[:e].encode()) - int(places[t])
                    best[t, n] = min(best.get((t, n), (distance, s, e)), (distance, s, e))
    return [(t, n, *v) for (t, n), v in sorted(best.items())]


def _passes(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items, in parts of bounded size."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // PASS_CHARS))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["i"], r["t"]) for r in part.distinct().orderBy("i", "t").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, recall: float = RECALL, key: str = "doc_id",
                 text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, distance, begin_byte, end_byte: the best place of each item in each document that holds it.

    Null and empty texts hold nothing, items under eight bytes and null ids are
    not looked for, repeated items count once and rows of documents each.
    Other columns are left out.  Places are bytes of the text in UTF-8.
    """
    docs = docs.select(F.col(key), F.col(text))
    kind = benchmark.schema[item].dataType.simpleString()
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {kind}, distance int, begin_byte bigint, end_byte bigint"
    id_type = benchmark.select(item).limit(0).toArrow().schema.field(0).type
    out = None
    for part in _passes(benchmark, item, item_text):
        found = docs.mapInArrow(_finder(build(part, max_edit, recall), key, text, item, id_type), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(index: Index, key: str, text: str, item: str, id_type: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = index.mask()
        for batch in slices(batches, text, 8_000_000):
            got = find(index, mask, *text_bytes(batch, text))
            row, n, distance, begin, end = zip(*got, strict=True) if got else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(row, pa.int64())), pa.array([index.ids[i] for i in n], id_type),
                 pa.array(distance, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                [key, item, "distance", "begin_byte", "end_byte"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, recall: float = RECALL, text: str = "text",
          item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that hold no item."""
    for part in _passes(benchmark, item, item_text):
        docs = docs.mapInArrow(_cleaner(build(part, max_edit, recall), text), docs.schema)
    return docs


def _cleaner(index: Index, text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = index.mask()
        for batch in slices(batches, text, 8_000_000):
            keep = np.ones(batch.num_rows, bool)
            keep[[t for t, *_ in find(index, mask, *text_bytes(batch, text))]] = False
            yield batch.filter(pa.array(keep))

    return run
