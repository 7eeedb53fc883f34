import random

import numpy as np
import pytest

from stipple.llm import toxicity as X

INSULTS = ["blarg", "snivelgit", "grotface", "wormtongue", "muckwit"]
PARTS = ["an", "ther", "on", "ing", "re", "st", "ou", "ha", "ble", "nd", "is", "ly", "wh", "ed"]


def prose(rng, n):
    return " ".join("".join(rng.choices(PARTS, k=rng.randint(1, 4))) for _ in range(n))


def text(rng, toxic):
    words = prose(rng, rng.randint(30, 200)).split()
    if toxic:
        for _ in range(rng.randint(2, 6)):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return X.train([(text(rng, i % 3 == 0), int(i % 3 == 0)) for i in range(450)])


def test_held_out_accuracy(model):
    rng = random.Random(2)
    y = np.array([i % 2 for i in range(300)])
    s = X.score(model, X.Scorer(model.ordinary, model.toxic).features([text(rng, bool(v)) for v in y]))
    assert ((s >= X.THRESHOLD)[y == 1]).mean() > 0.95 and ((s >= X.THRESHOLD)[y == 0]).mean() < 0.02


def test_whole_text_counts(model):
    rng = random.Random(3)
    scorer = X.Scorer(model.ordinary, model.toxic)
    late = prose(rng, 300) + " snivelgit grotface wormtongue muckwit snivelgit"
    assert X.score(model, scorer.features([late]))[0] > X.score(model, scorer.features([prose(rng, 305)]))[0]


def test_windows_cover_long_words():
    w = X.windows("a" * 500 + " b")
    assert w[-1] == b" b " and max(map(len, w)) <= X.WINDOW
    assert X.windows("") == [] and X.windows(" \n") == []


def test_rows_edges_and_filter(spark, model):
    rng = random.Random(4)
    rows = [(1, text(rng, True), "x"), (1, text(rng, False), "y"), (None, None, None), (3, "", "z"), (4, "ha " * 50_000, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = X.score_documents(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    kept = X.keep_ordinary(df, model)
    assert kept.columns == df.columns and kept.count() == 4
    assert X.score_documents(df.limit(0), model).count() == 0


def test_fit_uses_only_the_open_folds(spark):
    docs = spark.createDataFrame([(i, "word " * 5) for i in range(30)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(30)], "doc_id bigint, quality int, toxic int")
    m = X.fit(docs, labels)
    assert X.score(m, X.Scorer(m.ordinary, m.toxic).features(["word"])).shape == (1,)
    none = X.fit(docs, labels.limit(0))
    assert X.score(none, X.Scorer(none.ordinary, none.toxic).features(["word"]))[0] < 0.1
