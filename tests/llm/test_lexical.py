import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stipple.llm import lexical
from stipple.session import cut

DOCS = "doc_id bigint, text string, item string, n long, term string, score string, rank int, key string"
ITEMS = "item_id bigint, text string, item string, id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def brute(docs, items, k=20):
    tfs = [(d[0], Counter(terms(d[1]))) for d in docs]
    tfs = [(d, c) for d, c in tfs if c]
    n_docs, total = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item in items:
        scored = []
        for d, c in tfs:
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in terms(item[1]) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item[0], i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def check(spark, docs, items, **options):
    d = cut(spark.createDataFrame([(*r, "x", 1, "y", "z", 2, "w") for r in docs], DOCS).repartition(3), "fixture")
    i = cut(spark.createDataFrame([(*r, "q", "r") for r in items], ITEMS), "fixture")
    got = [tuple(r) for r in lexical.search(d, i, **options).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute(docs, items, options.get("k", 20)), key=key)
    return got


def corpus(n_docs, n_items, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["été", "Straße", "x9", "日本"]
    draw = lambda n: " ".join(words[min(int(rng.expovariate(0.03)), 203)] for _ in range(n))
    shared = draw(12)
    docs = [(i, draw(rng.randint(1, 60))) for i in range(n_docs)]
    return docs, [(i, shared + " " + draw(rng.randint(1, 20)) if i % 2 else draw(15)) for i in range(n_items)]


def test_against_plain_scores(spark):
    check(spark, *corpus(400, 25))


def test_blocks_small_batches_and_merging(spark, monkeypatch):
    monkeypatch.setattr(lexical, "HELD", 2000)
    monkeypatch.setattr(lexical, "MEET", 2)
    monkeypatch.setattr(lexical, "SLICE", 200)
    check(spark, *corpus(200, 12), block_chars=300, k=5)


def test_nulls_ties_repeats_and_long_texts(spark):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, "- ."), (4, "Alpha\tBETA\nalpha"), (4, "alpha"), (5, "beta " * 40_000), (6, "K alpha")]
    docs += [(100 + i, "alpha same copy") for i in range(50)]
    items = [(1, "alpha alpha beta"), (1, "beta"), (2, "alpha alpha beta"), (3, None), (4, ""), (None, "same gamma"), (6, "?"), (7, "Kelvin k")]
    check(spark, docs, items)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")])])
def test_empty(spark, docs, items):
    assert check(spark, docs, items) == []


def test_shared_sums_save_additions_and_lose_nothing():
    rng = np.random.default_rng(0)
    common = rng.choice(500, 30, replace=False)
    counts = []
    for _ in range(60):
        own = set(common[: rng.integers(5, 30)]) | set(rng.choice(500, 10))
        counts.append([(int(t), int(rng.integers(1, 3)) if t < 5 else 1) for t in sorted(own)])
    graph = lexical.Sharing(counts)
    gains = rng.integers(1, 1000, (500, 7))
    term, doc = np.nonzero(rng.random((500, 7)) < 0.5)
    got = graph.scores(gains[term, doc], term, doc, 7)
    held = np.zeros((500, 7), np.int64)
    held[term, doc] = gains[term, doc]
    want = np.array([sum(q * held[t] for t, q in c) for c in counts])
    assert (got == want).all()
    assert graph.layers and graph.additions() < 0.7 * sum(len(c) - 1 for c in counts)
