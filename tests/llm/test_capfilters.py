import numpy as np
import pytest

from stipple.llm import capfilters
from stipple.session import cut

DDL = "vec_id bigint, embedding array<float>, label int, same string, rep int, filters string, key int, raw string"


def planted(seed=3, groups=40, d=64):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((1500, d))
    at = 0
    for _ in range(groups):
        n = int(rng.integers(2, 12))
        for i in range(1, n):  # chains whose steps are near the threshold
            v = rng.standard_normal(d)
            u = x[at + i - 1] / np.linalg.norm(x[at + i - 1])
            v -= v @ u * u
            c = rng.uniform(0.88, 0.97)
            x[at + i] = (c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v)) * rng.uniform(0.1, 9)
        at += n
    x[at:at + 30] = x[0]
    x[at + 30:at + 60] = x[0] * 2
    x[at + 60:at + 200] = x[1] + 0.05 * rng.standard_normal((140, d))
    return x.astype(np.float32)


def brute(rows):
    """(n_links, component, kept) of (id, vector) rows whose vectors are all usable or None."""
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v is not None]
    x = np.array([rows[i][1] for i in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.array([rows[i][0] for i in ok])
    while True:
        new = np.minimum(label, np.where(near, label[None, :], label.max()).min(axis=1))
        if (new == label).all():
            break
        label = new
    out = [(k, 0, k, True) for k, _ in rows]
    for j, i in enumerate(ok):
        out[i] = (rows[i][0], int(near[j].sum()), int(label[j]), bool(rows[i][0] == label[j]))
    return out


def table(spark, rows):
    wide = [(k, None if v is None else [None if c is None else float(c) for c in v], 1, "s", 2, "f", 3, "r") for k, v in rows]
    return cut(spark.createDataFrame(wide, DDL).repartition(4), "fixture")


def run(spark, rows, **options):
    got = capfilters.links(table(spark, rows), **options)
    return [tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()]


def test_links_and_recall(spark):
    x = planted()
    order = np.random.default_rng(0).permutation(len(x))
    rows = [(int(order[i]), v) for i, v in enumerate(x)]
    got, want = {r[0]: r for r in run(spark, rows)}, {r[0]: r for r in brute(rows)}
    assert got.keys() == want.keys()
    assert all(got[k][1] <= want[k][1] for k in want)
    assert sum(r[1] for r in got.values()) >= 0.99 * sum(r[1] for r in want.values())
    assert np.mean([got[k] == want[k] for k in want]) >= 0.98


def test_crowded_filters_give_the_same(spark):
    rows = [(i, v) for i, v in enumerate(planted(5, 10)[:700])]
    assert sorted(run(spark, rows)) == sorted(run(spark, rows, block=16))


def test_odd_rows(spark):
    v = np.ones(8)
    rows = [(1, v), (2, None), (3, np.zeros(8)), (4, [1.0] * 7 + [None]), (5, [1.0] * 7 + [float("nan")]), (6, [float("inf")] * 8),
            (7, []), (8, [1.0] * 9), (None, v), (9, v * 3), (9, v * 3), (10, -v), (11, v * 1e30), (12, v * 1e-30)]
    usable = {1, 9, 10, 11, 12}
    got = run(spark, rows)
    want = brute([(k, x if k in usable else None) for k, x in rows])
    key = lambda r: tuple(str(c) for c in r)
    assert sorted(got, key=key) == sorted([(k, n, None if k is None else c, True if k is None else t) for k, n, c, t in want], key=key)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == [(k, 0, k, True) for k, _ in rows]


@pytest.mark.parametrize("parts,words", [(2, 16), (3, 6)])
def test_list_decoding_finds_all_filters(parts, words, monkeypatch):
    monkeypatch.setattr(capfilters, "WORDS", words + 1)
    code = capfilters.Code(24, 4 * words ** parts, turns=4)
    assert (code.parts, code.words) == (parts, words)
    x = np.random.default_rng(1).standard_normal((50, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, filt = code.decode(x, 0.3)
    scores = []
    for turn, books in zip(code.turns, code.books):
        total = np.zeros((50, 1))
        for a, b, book in zip(code.cuts[:-1], code.cuts[1:], books):
            total = (total[:, :, None] + (x @ turn)[:, None, a:b] @ book).reshape(50, -1)
        scores.append(total)
    want = np.nonzero(np.hstack(scores) >= 0.3)
    assert len(row) and set(zip(row, filt)) == set(zip(*want)) and len(row) == len(want[0])


def test_the_level_meets_the_recall():
    code = capfilters.Code(64, 4096).fit(0.9, 0.95)
    x = np.random.default_rng(9).standard_normal((2, 500, 64))
    a = x[0] / np.linalg.norm(x[0], axis=1, keepdims=True)
    z = x[1] - (x[1] * a).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    ra, fa = code.decode(a, code.level)
    rb, fb = code.decode(b, code.level)
    met = {r for r, _ in set(zip(ra, fa)) & set(zip(rb, fb))}
    assert len(met) > 0.92 * 500 and len(ra) < 25 * 500
