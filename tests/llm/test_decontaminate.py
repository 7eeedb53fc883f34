import random

import numpy as np
import pytest

from stipple.llm import decontaminate as D

PARTS = ["an", "ther", "on", "ing", "ré", "st", "ou", "ha", "ble", "nd", "is", "ly", "wh", "ed", "tion", "ö"]


def prose(rng, chars):
    t = ""
    while len(t) < chars:
        t += "".join(rng.choices(PARTS, k=rng.randint(1, 4))) + " "
    return t[:chars].strip()


def edit_distance_to_part(p, t):
    """Plain dynamic programme: least distance to any stretch of t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, d in enumerate(t):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def packed(rows):
    data = [t.encode() for t in rows]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(60):
        p, t = prose(rng, rng.randint(1, 90)) or "x", prose(rng, rng.randint(0, 120))
        assert D.best_match(p, t)[0] == edit_distance_to_part(p, t)
        d, b, e = D.locate(p, t)
        assert edit_distance_to_part(p, t[b:e]) == d


def test_walks_of_close_strings_agree():
    rng = random.Random(2)
    t = prose(rng, 200)
    near, other = D.edited(t, 10, np.random.default_rng(0)), prose(rng, 200)
    a, b, c = (D.walks(D.padded([x], 220), 200) for x in (t, near, other))
    assert (a == b).mean() > 0.5 > (a == c).mean() + 0.2


@pytest.mark.parametrize("share", [0.0, 0.04, 0.09])
def test_recall_against_brute_force(share):
    rng, np_rng = random.Random(3), np.random.default_rng(3)
    items = [(i, prose(rng, rng.randint(80, 400))) for i in range(60)]
    docs, planted = [], set()
    for i, t in items:
        copy = D.edited(t, int(share * len(t)), np_rng)
        docs.append(prose(rng, rng.randint(0, 900)) + " " + "".join(c.upper() if c.isascii() else c for c in copy) + "\n" + prose(rng, rng.randint(0, 500)))
        planted.add((len(docs) - 1, i))
        docs.append(prose(rng, 600))
    index = D.build(items)
    got = D.find(index, index.mask(), *packed(docs))
    pairs = {(d, index.ids[n]) for d, n, *_ in got}
    assert len(pairs & planted) >= 0.95 * len(planted) and pairs <= planted
    for d, n, distance, b, e in got:
        stretch = D.fold(docs[d].encode()[b:e].decode())
        assert edit_distance_to_part(index.texts[n], stretch) == distance <= 0.1 * len(index.texts[n])


def test_far_copies_are_left_alone():
    rng, np_rng = random.Random(4), np.random.default_rng(4)
    items = [(i, prose(rng, 200)) for i in range(20)]
    index = D.build(items)
    docs = [D.edited(t, 80, np_rng) for _, t in items]
    for d, n, distance, *_ in D.find(index, index.mask(), *packed(docs)):
        assert edit_distance_to_part(index.texts[n], D.fold(docs[d])) <= 20 and distance <= 20


def test_rows_and_edges(spark):
    rng = random.Random(5)
    item = prose(rng, 150)
    rows = [(1, "a " + item, "x"), (1, "a " + item, "x"), (None, item, None), (3, None, "y"), (4, "", "z"), (5, prose(rng, 300_000) + item, "w"),
            (6, prose(rng, 500), "v")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, distance string")
    bench = spark.createDataFrame([(7, item, "q"), (7, item, "q"), (8, None, ""), (None, item, ""), (9, "short", "")], "item_id bigint, text string, lang string")
    got = D.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.distance) for r in got) == [(0, 7, 0), (1, 7, 0), (1, 7, 0), (5, 7, 0)]
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6]
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == 7


def test_several_passes(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, 120)) for i in range(12)]
    docs = spark.createDataFrame([(i, prose(rng, 50) + t) for i, t in items], "doc_id bigint, text string")
    monkeypatch.setattr(D, "PASS_CHARS", 400)
    got = D.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(12)]
