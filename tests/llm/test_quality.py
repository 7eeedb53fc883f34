import random

import numpy as np
import pytest

from stipple.llm import quality as Q


def good(rng):
    return " ".join("".join(rng.choices(["an", "the", "on", "ing", "re", "st"], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 80)))


def bad(rng):
    t = good(rng)
    return [t.upper().replace(" ", "!! "), t.replace(" ", "*** "), " ".join(w for w in t.split() for _ in range(9))][rng.randrange(3)]


def packed(rows):
    data = [t.encode() for t in rows]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return Q.train([(good(rng), 1) if i % 3 else (bad(rng), 0) for i in range(300)])


def test_held_out_accuracy(model):
    rng = random.Random(2)
    s = Q.score(model, *packed([good(rng) if i % 2 else bad(rng) for i in range(200)]))
    assert (s[1::2] >= Q.THRESHOLD).mean() > 0.97 and (s[::2] >= Q.THRESHOLD).mean() < 0.03


def test_features_by_brute_force():
    rows = ["ab  ab cd", "", "x", "ab ab ab", "é\tü"]
    raw, places = packed(rows)
    values = np.random.default_rng(0).random(1 << Q.BITS)
    total, count = Q.sums(values, raw, places)
    for i, t in enumerate(rows):
        a, b = Q.sums(values, *packed([t]))
        assert np.isclose(total[i], a[0]) and count[i] == b[0]
        data = t.encode()
        words = t.split()
        n = len(words) + sum(x == y for x, y in zip(words, words[1:], strict=False)) + sum(max(0, len(data) - g + 1) for g in Q.GRAMS)
        assert count[i] == n
    h, owner = Q.word_hashes(raw, places)
    assert h[0] == h[1] == h[4] and len(set(h.tolist())) == 5 and owner.tolist() == [0, 0, 0, 2, 3, 3, 3, 4, 4]


def test_rows_and_edges(spark, model):
    rows = [(1, "the anon", "a"), (1, "the anon", "a"), (None, None, None), (3, "", "b"), (4, "an " * 100_000, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = Q.score_documents(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[None] == by[3]
    assert Q.score_documents(df.limit(0), model).count() == 0


def test_fit_without_labels_and_with_one_class(spark):
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(30)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    for part in (labels, labels.limit(0)):
        assert Q.score(Q.fit(docs, part), *packed(["word"]))[0] > 0.9
