"""Offset-preserving SentencePiece encoding and decoding.

The text is normalised here: at every place the longest prefix found in the
model's compiled character map (a double-array trie) is replaced, other
characters stay, and each output byte records the source byte it came from.
The normalised text is segmented by the model, and every piece is projected
back through that record to a byte span of the original text.  Pieces that are
parts of one character (byte fallback) share that character's span; the inserted leading
space mark has an empty span.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm.common import slices, texts

SPACE = "▁"
#: bytes of text that a task encodes at once
SLICE = 500_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = 8 if kind == 1 else 4
            value = data[at:at + size]
            at += size
        yield tag >> 3, value


class CharacterMap:
    """Longest-prefix lookup in a compiled character map.

    The blob holds the trie's size, the units of a double array and the
    replacement strings, each ended by a zero byte.
    """

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.strings = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at`` and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            b = data[i]
            node ^= b
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != b:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start:self.strings.index(b"\0", start)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class Normalizer:
    """Text to normalised text with the source byte of each normalised byte."""

    def __init__(self, spec: dict[int, int | bytes], own_symbols: list[str] = ()):
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix = bool(spec.get(3, 1))
        self.strip = bool(spec.get(4, 1))
        self.escape = bool(spec.get(5, 1))
        self.own = re.compile("|".join(map(re.escape, sorted(own_symbols, key=len, reverse=True)))) if own_symbols else None
        self.plain = not self.map.units and not self.strip and not self.own

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text; source offset of each of its bytes, and the end."""
        if not text:
            return "", np.zeros(1, np.int64)
        return self._plain(text) if self.plain else self._mapped(text)

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        """Without a map only spaces change, so the record is a repetition count."""
        space = SPACE if self.escape else " "
        out = (space if self.dummy_prefix else "") + text.replace(" ", space)
        raw = np.frombuffer(text.encode(), np.uint8)
        wide = len(space.encode())
        start = np.arange(raw.size)
        if wide > 1:
            start = np.repeat(start, np.where(raw == 32, wide, 1))
        lead = np.zeros(wide if self.dummy_prefix else 0, np.int64)
        return out, np.concatenate([lead, start, [raw.size]])

    def _mapped(self, text: str) -> tuple[str, np.ndarray]:
        data = text.encode()
        space = (SPACE if self.escape else " ").encode()
        parts: list[tuple[bytes, int]] = []  # replacement, source byte
        at = 0
        while at < len(data):
            own = self.own.match(text, len(data[:at].decode())) if self.own else None
            hit = (len(own[0].encode()), own[0].encode()) if own else self.map.longest(data, at)
            if not hit:
                b = data[at]
                size = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                hit = size, data[at:at + size]
            parts.append((hit[1], at))
            at += hit[0]
        end = len(data)
        if self.strip:
            while parts and not parts[0][0].strip(b" "):
                parts.pop(0)
            while parts and not parts[-1][0].strip(b" "):
                end = parts.pop()[1]
            if not parts:
                return "", np.zeros(1, np.int64)
        out, source = bytearray(), []
        if self.dummy_prefix:
            out += space
            source += [parts[0][1]] * len(space)
        after_space = self.strip
        for piece, place in parts:
            for b in piece:
                if b == 32:
                    if after_space and self.strip:
                        continue
                    out += space
                    source += [place] * len(space)
                    after_space = True
                else:
                    out.append(b)
                    source.append(place)
                    after_space = False
        while self.strip and out.endswith(space):
            del out[-len(space):], source[-len(space):]
        return out.decode(), np.array([*source, end])


class Encoder:
    """A model with its normaliser taken out and run here."""

    def __init__(self, model: bytes):
        import sentencepiece

        pieces, spec = [], {}
        for field, value in message_fields(model):
            if field == 1:
                p = dict(message_fields(value))
                pieces.append((p[1].decode(), p.get(3, 1)))
            elif field == 3:
                spec |= dict(message_fields(value))
        self.normalize = Normalizer(spec, [p for p, kind in pieces if kind == 4])
        # fields that come later win when messages are joined: no map, no prefix, no stripping, no escapes
        bare = b"\x12\x00\x18\x00\x20\x00\x28\x00"
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a" + bytes([len(bare)]) + bare)
        self.model = model
        self.eos, self.unknown = self.segmenter.eos_id(), self.segmenter.unk_id()
        self.size = np.array([1 if kind == 6 else len(p.encode()) for p, kind in pieces], np.int64)
        self.is_byte = np.array([kind == 6 for _, kind in pieces])
        #: bytes of characters of several bytes
        self.is_part = np.array([kind == 6 and int(p[3:5], 16) >= 128 for p, kind in pieces])
        self.raw = [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(SPACE, " ").encode() for p, kind in pieces]
        self.spaced = np.array([kind != 6 and p.startswith(SPACE) for p, kind in pieces])
        self.odd = np.array([kind not in (1, 4, 6) for _, kind in pieces])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids with the end id, and the first and one-past-last source byte of each."""
        normal, source = self.normalize(text)
        end = source[-1]
        if not normal:
            return np.array([self.eos], np.int32), np.array([end]), np.array([end])
        ids = np.array(self.segmenter.encode(normal), np.int32)
        if (ids == self.unknown).any():
            stop = self._unknown_ends(normal)
        else:
            stop = np.cumsum(self.size[ids])
        start = np.concatenate([[0], stop[:-1]])
        begin, last = source[start], source[stop]
        inner = self.is_part[ids]
        if inner.any():  # parts of a character take the whole character
            begin[inner], last[inner] = self._character_bounds(normal, source, start[inner])
        return np.append(ids, self.eos), np.append(begin, end), np.append(last, end)

    @staticmethod
    def _character_bounds(normal: str, source: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(normal.encode(), np.uint8)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        k = np.searchsorted(heads, at, "right") - 1
        return source[heads[k]], source[np.append(heads, raw.size)[k + 1]]

    def _unknown_ends(self, normal: str) -> np.ndarray:
        """Ends of pieces where some have no fixed size."""
        ends, done = [], 0
        for p in self.segmenter.encode(normal, out_type="immutable_proto").pieces:
            done += len(p.surface.encode())
            ends.append(done)
        return np.array(ends)

    @cached_property
    def processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their bytes joined, without the space that the model puts first.

        Ids that are neither pieces nor bytes, bytes that make no characters and
        models that squeeze spaces are left to the library.
        """
        if not len(ids):
            return ""
        if not self.normalize.strip and not self.odd[ids].any():
            try:
                out = b"".join(map(self.raw.__getitem__, ids.tolist())).decode()
                return out[1:] if self.normalize.dummy_prefix and self.spaced[ids[0]] else out
            except UnicodeDecodeError:
                pass
        return self.processor.decode(ids.tolist())


@lru_cache(maxsize=1)
def shared_encoder(model: bytes) -> Encoder:
    """One encoder a worker process, however many tasks it runs."""
    return Encoder(model)


OUTPUT = "ids array<int>, begin array<int>, end array<int>, decoded string"


def encode_documents(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (with the end id), begin and end (source byte spans of the ids), decoded.

    A null text is an empty one and gives the end id alone with an empty
    span.  Rows are mapped one by one: repeated rows and keys are kept as
    they are, other columns are left out, an empty table gives an empty one.
    The model's bytes (a file of fixed size) travel to each task.
    """
    docs = docs.select(F.col(key), F.col(text))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {OUTPUT}"
    return docs.mapInArrow(_encoder(model, key, text), schema)


def _encoder(model: bytes, key: str, text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(model)
        for batch in slices(batches, text, SLICE):
            rows = [encoder.encode(t) for t in texts(batch, text)]
            decoded = [encoder.decode(ids[:-1]) for ids, _, _ in rows]
            offsets = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, np.concatenate([r[k] for r in rows]).astype(np.int32)) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *lists, pa.array(decoded, pa.string())], [key, "ids", "begin", "end", "decoded"])

    return run


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 and the bytes of source that the spans reach to."""
    return encoded.select(
        F.col(key),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.array_max("end").cast("bigint").alias("n_bytes"),
    )
