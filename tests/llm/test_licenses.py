import random
import re

from stipple.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text):
    w = words_of(text)
    base = [(label, p) for label, phrase in L.PHRASES for p in range(len(w)) if w[p:p + len(phrase.split())] == phrase.split()]
    found = {}
    for s in range(0, len(w), L.STRIDE):
        block = set(w[s:s + L.BLOCK])
        for t in L.TEMPLATES:
            n = len(block & set(t.words))
            if n >= t.needed:
                found[t.label] = max(found.get(t.label, 0), n / len(t.words))
    starts = [p for _, p in base]
    return (len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for b, _ in base})),
            ",".join(sorted({b for b, _ in base} | set(found))), round(1.0 if base else max(found.values(), default=0.0), 9))


def test_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = sorted({w for t in L.TEMPLATES for w in t.words}) + ["alpha", "Beta", "éa", "9x", "omega"] * 4
    rows = [(0, ""), (1, None), (2, "Under-the MIT license. under the mit license cc by nc cc by nc, CC-BY-NC!"), (3, " ...\n\x00 "),
            (4, "Licensed under the Apache License, Version 2.0."), (4, "Licensed under the Apache License, Version 2.0."),
            (None, "All Rights\nreserved"), (5, "İ under the mit licensé é under the mit license"), (7, "this wor\u212a is licensed under a creative commons attribution 4 0 international license"), (6, "word " * 60_000 + "under the mit license")]
    for i in range(120):
        t = rng.choice(L.TEMPLATES).text.split()
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        pad = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        at = rng.randint(0, len(pad))
        rows.append((100 + i, " ".join(pad[:at] + t + pad[at:])))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, labels string")
    got = [(str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in L.scan(df).collect()]
    assert sorted(got, key=str) == sorted([(str(d), *brute(t)) for d, t in rows], key=str)
    assert L.scan(df.limit(0)).count() == 0


def test_no_template_word_in_the_table(spark):
    df = spark.createDataFrame([(1, "nothing here"), (2, "at all")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_words, r.labels, r.score) for r in L.scan(df).collect()) == [(1, 2, "", 0.0), (2, 2, "", 0.0)]
