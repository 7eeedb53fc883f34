"""Scoring, ranking, statistics, background and doublets on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stipple.functions import columns as C
from stipple.functions import stats
from stipple.operators import ambient, composition, doublets, labels, qc, score
from stipple.session import cut


def test_tails():
    lam, x = np.array([0.5, 3.0, 30.0, 400.0]), np.array([2.0, 5.0, 50.0, 380.0])
    want = [1 - sum(math.exp(-l + k * math.log(l) - math.lgamma(k + 1)) for k in range(int(a))) for l, a in zip(lam, x)]
    assert np.allclose(stats.gamma_lower(x, lam), want, atol=1e-12)
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-10)
    assert stats.t_quantile(0.975, 6) == pytest.approx(2.446911851, abs=1e-8)
    assert [int(w) for w in stats._u_counts(2, 3)] == [1, 1, 2, 2, 2, 1, 1]
    p = stats.hypergeometric_tail.func(*[pd.Series([float(v)]) for v in (3, 5, 20, 8)])
    want = sum(math.comb(5, k) * math.comb(15, 8 - k) for k in range(3, 6)) / math.comb(20, 8)
    assert p[0] == pytest.approx(want)


def test_title_case_matches_python(spark):
    names = ["RAD51AP1", "ccnB2", "nkx2-1", "a b", "1abc", "", "H2-K1", "x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(C.title_case(F.col("n"))).collect()] == [n.title() for n in names]


def test_rank_genes_and_unique_top(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(0.8, size=(30, 6)).astype(float)
    cl = np.array(["a", "b", "c"])[np.arange(30) % 3]
    x[cl == "a", 0] += 3
    expr = spark.createDataFrame([(int(i), f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "cell_id int, gene string, value double")
    cells = spark.createDataFrame([(i, str(c)) for i, c in enumerate(cl)], "cell_id int, cluster string")
    got = score.rank_genes(expr, cells, n_genes=None).toPandas().set_index(["cluster", "gene"])
    for j in range(6):
        order = np.array([(x[:, j] < v).sum() + ((x[:, j] == v).sum() + 1) / 2 for v in x[:, j]])
        for c in "abc":
            w, n = order[cl == c].sum(), (cl == c).sum()
            z = (w - n * 31 / 2) / math.sqrt(n * (30 - n) * 31 / 12)
            assert got.z[(c, f"g{j}")] == pytest.approx(z, abs=1e-9)
            assert got.pvalue[(c, f"g{j}")] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    with pytest.raises(Exception, match=">= 0"):
        score.rank_genes(expr.withColumn("value", -F.col("value")), cells).collect()
    table = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 2, "z"), ("c", 1, "x"), ("c", 2, "z")],
        "cluster string, rank int, gene string")
    assert {r.cluster: r.gene for r in score.unique_top(table).collect()} == {"a": "x", "b": "z", "c": "x"}


def test_welch_interval_and_bh(spark):
    rows = [(f"s{i}", c, "WT" if i < 3 else "KO") for i, k in enumerate([(8, 2), (7, 3), (9, 1), (4, 6), (3, 7), (5, 5)])
            for c, m in zip("xy", k) for _ in range(m)]
    cells = spark.createDataFrame(rows, "sample string, cluster string, condition string")
    got = composition.compositional_shift(cells).toPandas().set_index("cluster")
    p = np.array([(8, 2), (7, 3), (9, 1), (4, 6), (3, 7), (5, 5)]) / 10
    lp = np.log(p + 0.05)
    v = (lp - lp.mean(axis=1, keepdims=True))[:, 0]
    a, b = v[:3], v[3:]
    se = math.sqrt(a.var(ddof=1) / 3 + b.var(ddof=1) / 3)
    assert got.effect["x"] == pytest.approx(b.mean() - a.mean()) and got.effect["y"] == pytest.approx(a.mean() - b.mean())
    half = stats.t_quantile(0.975, 4) * se
    assert got.ci_hi["x"] - got.effect["x"] == pytest.approx(half)
    assert got.pvalue["x"] == pytest.approx(stats.t_two_sided(got.t["x"], got.df_welch["x"]))
    q = composition.bh(spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.9])], "i int, pvalue double"))
    assert [round(r.padj, 6) for r in q.orderBy("i").collect()] == [0.04, 0.053333, 0.053333, 0.9]


def test_mann_whitney_exact_and_normal(spark):
    rng = np.random.default_rng(1)
    rows = [("small", "WT", float(v)) for v in (1, 3, 5, 7, 9)] + [("small", "KO", float(v)) for v in (2, 10, 11, 12, 13, 14)]
    rows += [("big", "WT", float(v)) for v in np.round(rng.normal(size=40), 1)]
    rows += [("big", "KO", float(v)) for v in np.round(rng.normal(size=30) + 0.5, 1)] + [("few", "WT", 1.0)] * 9
    got = composition.mann_whitney(spark.createDataFrame(rows, "g string, condition string, x double"), "g", "x").toPandas().set_index("g")
    assert set(got.index) == {"small", "big"}
    wt, ko = [1, 3, 5, 7, 9], [2, 10, 11, 12, 13, 14]
    u = sum(a > b for a in ko for b in wt)
    from itertools import combinations
    pool = wt + ko
    dist = [sum(a > b for a in s for b in set(pool) - set(s)) for s in combinations(pool, 6)]
    want = min(1, 2 * np.mean(np.array(dist) >= max(u, 30 - u)))
    assert got.u["small"] == u and got.pvalue["small"] == pytest.approx(want) and got.median_test["small"] == 11.5
    assert 0 < got.pvalue["big"] < 1


def test_two_conditions_in_a_sample_stop_the_job(spark):
    df = spark.createDataFrame([("s", "WT"), ("s", "KO")], "sample string, condition string")
    with pytest.raises(Exception, match="two conditions"):
        labels.sample_meta(df).collect()


@pytest.fixture(scope="module")
def tissue(spark):
    """Two cell types with own genes, shared genes and 5 % background."""
    rng = np.random.default_rng(7)
    kind = np.arange(300) % 2
    profile = np.full((2, 60), 0.2)
    profile[0, :10], profile[1, 10:20] = 8.0, 8.0
    profile[:, 20:] = rng.gamma(2, 1, size=40)
    profile /= profile.sum(axis=1, keepdims=True)
    profile[0, 10:20] = profile[1, :10] = 0
    soup = profile.mean(axis=0) / profile.mean(axis=0).sum()
    umi = rng.integers(100, 150, 300)
    x = np.array([rng.poisson(u * 0.95 * profile[k]) for u, k in zip(umi, kind)])
    back = rng.poisson(umi[:, None] * 0.05 * soup)
    rows = [("s1", f"c{i:03d}", f"g{j:02d}", float((x + back)[i, j])) for i, j in zip(*np.nonzero(x + back))]
    counts = cut(spark.createDataFrame(rows, "sample string, cell_id string, gene string, n double"))
    groups = cut(spark.createDataFrame([(f"c{i:03d}", str(k)) for i, k in enumerate(kind)], "cell_id string, group string"))
    return counts, groups, kind


def test_contamination_is_recovered_and_removed(tissue):
    counts, groups, kind = tissue
    profile = cut(ambient.ambient_profile(counts))
    rho = ambient.contamination(counts, groups, profile, tfidf_min=0.3, quantile=0.5)
    got = rho.collect()[0]
    assert got.n_pairs > 0 and abs(got.rho - 0.05) <= 0.02
    out = ambient.remove_ambient(counts, groups, profile, rho).join(groups, "cell_id")
    left = {(r.group, r.gene) for r in out.select("group", "gene").distinct().collect()}
    assert all(("0", f"g{j:02d}") in left for j in range(10))
    assert sum(("0", f"g{j:02d}") in left for j in range(10, 20)) <= 2
    assert sum(("1", f"g{j:02d}") in left for j in range(10)) <= 2


def test_artificial_doublets_sum_two_cells(tissue):
    counts, _, _ = tissue
    got = doublets.artificial_doublets(counts)
    a = got.agg(F.sum("n"), F.count_distinct("cell_id")).first()
    b = counts.agg(F.sum("n"), F.count_distinct("cell_id")).first()
    assert a[0] == 2 * b[0] and a[1] == b[1] == 300


def test_planted_doublets_score_higher(spark, tissue):
    counts, _, kind = tissue
    # merge 15 cells of one kind into cells of the other and drop them
    pairs = {f"c{2 * i + 1:03d}": f"c{2 * i:03d}" for i in range(15)}
    m = spark.createDataFrame(list(pairs.items()), "cell_id string, into string")
    merged = counts.join(m, "cell_id", "left").groupBy(
        "sample", F.coalesce("into", "cell_id").alias("cell_id"), "gene").agg(F.sum("n").alias("n"))
    got = doublets.doublets(cut(merged), n_genes=60, n_pcs=5, rate=0.05).toPandas()
    planted = got.cell_id.isin(set(pairs.values()))
    hi, lo = got.score[planted].to_numpy(), got.score[~planted].to_numpy()
    auc = (hi[:, None] > lo[None]).mean() + 0.5 * (hi[:, None] == lo[None]).mean()
    assert auc > 0.9 and got["class"].eq(2).sum() >= 1


def test_empty_cells_keep_null_shares(spark):
    counts = spark.createDataFrame([("s", "a", "mt-1", 2.0), ("s", "a", "x", 6.0)], "sample string, cell_id string, gene string, n double")
    cells = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    genes = qc.flag_genes(spark.createDataFrame([("mt-1",), ("x",)], "gene string"), qc.GENE_FLAGS)
    got = {r.cell_id: r for r in qc.cell_qc(counts, cells, genes, ["mt"]).collect()}
    assert got["a"].pct_counts_mt == 25 and got["a"].pct_counts_in_top_20_genes == 100
    assert got["b"].total_counts == 0 and got["b"].pct_counts_mt is None
