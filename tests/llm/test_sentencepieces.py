import hashlib

import numpy as np
import pytest
import sentencepiece

from stipple.llm import sentencepieces as S
from stipple.llm.queries import op4_sentencepiece, tokenizer_bytes, tokenizer_path

TEXTS = ["", " ", "Hello  world \n", "  a\tb\xa0c ｆｕｌｌ ﬁ é é", "▁x ▁▁y", "日本語テキスト 😀 x", "a" * 3000 + " " + "ab " * 2000,
         "ends with spaces   ", "\r\n\x0b", "null\x00byte", "Ünïcödé ﷺ ㎒ Å ①②"]


@pytest.fixture(scope="module")
def encoder():
    return S.Encoder(tokenizer_bytes())


def test_ids_equal_the_library(encoder):
    p = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for t in TEXTS:
        ids, begin, end = encoder.encode(t)
        assert ids.tolist() == p.encode(t, add_eos=True), t
        assert encoder.decode(ids[:-1]) == p.decode(p.encode(t))
        data = t.encode()
        assert (begin <= end).all() and (begin[1:] >= begin[:-1]).all()
        covered = bytearray(len(data))
        for b, e in zip(begin, end, strict=True):
            data[b:e].decode()  # spans never cut a character
            covered[b:e] = b"\1" * (e - b)
        assert all(covered)


def test_any_ids_decode_like_the_library(encoder):
    rng = np.random.default_rng(0)
    odd = [0, 1, 2, *np.flatnonzero(encoder.is_byte)[[0, 10, 65, 200, 255]], *np.flatnonzero(encoder.spaced)[:5]]
    for _ in range(300):
        ids = rng.integers(0, len(encoder.raw), rng.integers(0, 12))
        ids[rng.random(len(ids)) < 0.2] = rng.choice(odd)
        assert encoder.decode(ids) == encoder.processor.decode(ids.tolist())


def test_spans_are_the_pieces(encoder):
    text = "Hello  world, schön"
    ids, begin, end = encoder.encode(text)
    for i, b, e in list(zip(ids, begin, end, strict=True))[:-1]:
        piece = encoder.processor.id_to_piece(int(i)).replace("▁", " ")
        assert text.encode()[b:e].decode() in (piece, piece[1:])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_compiled_map_equals_the_library(rule):
    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = {}
    for field, value in S.message_fields(norm.serialized_model_proto()):
        if field == 3:
            spec |= dict(S.message_fields(value))
    ours = S.Normalizer(spec)
    for t in TEXTS:
        if "\x00" in t:
            continue
        got, source = ours(t)
        assert got == norm.normalize(t), (rule, t)
        assert len(source) == len(got.encode()) + 1 and (source[1:] >= source[:-1]).all()


def test_documents_and_edge_rows(spark):
    rows = [(1, "Hello world", "a"), (1, "Hello world", "a"), (None, None, None), (3, "", "b"), (4, "x " * 60_000, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = S.encode_documents(df, tokenizer_bytes()).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[None].ids == [2] and by[3].begin == [0] and by[3].end == [0] and by[1].decoded == "Hello world"
    assert len(by[4].decoded) == 120_000
    assert S.encode_documents(df.limit(0), tokenizer_bytes()).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    p = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = p.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(p.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op4_sentencepiece(spark, sf).collect()}
    assert got == want
