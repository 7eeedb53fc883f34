import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.llm import maxscore as M


def brute(ids, x, queries, k):
    out = []
    for i in queries:
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("n,d,k,shard", [(900, 16, 20, 128), (50, 8, 20, 64), (15, 4, 20, 4096), (700, 64, 5, 300)])
def test_equals_brute_force(spark, monkeypatch, n, d, k, shard):
    monkeypatch.setattr(M, "SHARD", shard)
    monkeypatch.setattr(M, "SEED", 40)
    monkeypatch.setattr(M, "BLOCK", 16)
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d)) / np.sqrt(d)
    x[n // 3: n // 2] = x[0]  # many equal vectors: ties
    ints = np.floor(64 * x).astype(np.int64)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, score string")
    got = sorted(tuple(r) for r in M.top_k(df, F.col("vec_id") % 20 == 0, k).collect())
    assert got == brute(np.arange(n), ints, range(0, n, 20), k)


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-(10**7), 10**7, (300, 6))
    for number, place, score in M.search_shard(np.arange(300), x, np.arange(5), x[:5], 7):
        want = sorted((-(int((x[j] * x[number]).sum())), j) for j in range(300) if j != number)[:7]
        assert [(-s, p) for p, s in zip(place.tolist(), score.tolist(), strict=True)] == want


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [nan, 0.0]), (2, [inf, 1.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0]),
            (5, [0.25, 0.25]), (5, [0.25, 0.25]), (20, [0.5, 0.5]), (6, [1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in M.top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert [g for g in got if g[0] == 0] == [(0, 1, 6, 4096), (0, 2, 20, 2048), (0, 3, 20, 2048), (0, 4, 5, 1024), (0, 5, 5, 1024), (0, 6, 7, 0)]
    assert [g[2] for g in got if g[0] == 20] == [0, 6, 5, 5, 7]
    assert M.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
