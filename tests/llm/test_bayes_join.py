import random

import numpy as np
import pytest

from stipple.llm import bayes_join as B
from stipple.llm.components import components


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(class id, copies, text links, links) of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    copies, texts, links = [1] * len(rows), [set() for _ in rows], [0] * len(rows)
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and sets[i] and sets[j]:
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if s >= 0.8:
                    links[i] += 1
                    copies[i] += s == 1
                    if s < 1:
                        texts[i].add(frozenset(sets[j]))
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(x for x in (least.get(root(i)), d) if x is not None) if d is not None else least.get(root(i))
    return sorted((str(d), str(least[root(i)]), copies[i], len(texts[i]), links[i]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        base = words(rng, rng.randint(3, 120))
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = "x" + str(rng.randrange(99))
            rows.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    group = words(rng, 100)
    for _ in range(50):
        w = list(group)
        w[rng.randrange(100)] = "y" + str(rng.randrange(9999))
        rows.append(" ".join(w))
    rng.shuffle(rows)
    return [*enumerate(rows), (None, rows[0]), (7000, None), (7001, ""), (7002, " \n"), (5, rows[5])]


@pytest.mark.parametrize("bucket,cluster", [(1024, 200_000), (16, 700)])
def test_equals_brute_force(spark, monkeypatch, bucket, cluster):
    monkeypatch.setattr(B, "BUCKET_BLOCK", bucket)
    monkeypatch.setattr(B, "CLUSTER_BLOCK", cluster)
    rows = corpus(1)
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id bigint, text string, class_id string")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_copies, r.n_text_links, r.n_links) for r in B.near_duplicates(df).collect())
    assert got == brute(rows)


def test_one_of_each(spark):
    rows = corpus(2, 25)
    df = spark.createDataFrame([(d, t, "en", "z") for d, t in rows], "doc_id bigint, text string, lang string, k string")
    kept = B.one_of_each(df)
    assert kept.columns == df.columns
    want = {c for d, c, *_ in brute(rows)}
    got = [str(r.doc_id) for r in kept.collect()]
    assert sorted(got) == sorted(want) and B.one_of_each(df.limit(0)).count() == 0


def test_empty_and_without_pairs(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "u v w x y z")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in B.near_duplicates(df).collect()) == [(1, 1, 0), (2, 2, 0)]
    assert B.near_duplicates(df.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    need = B.needed_matches()
    assert list(need) == sorted(need) and need[-1] > 0.5 * B.HASHES
    a = rng.integers(0, 65536, (3000, B.HASHES)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 65536, a.shape)).astype(np.uint16)
    kept = sum(len(list(zip(*next(iter(B.survivors(a[i:i + 1], b[i:i + 1], need, False))), strict=True))) for i in range(3000))
    assert kept >= 2995
    far = np.where(rng.random(a.shape) < 0.4, a, rng.integers(0, 65536, a.shape)).astype(np.uint16)
    assert sum(len(next(iter(B.survivors(a[i:i + 1], far[i:i + 1], need, False)))[0]) for i in range(500)) == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (2000, 2000)] + [(3000, 3000 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1001] == 1000 and all(got[3000 + i] == 3000 for i in range(50)) and 2000 not in got
