"""Quantiles and ranks: the small and the sliced way against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.functions.order import average_ranks, quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in np.round(rng.normal(size=3000), 2)]
    rows += [("cold", float(v)) for v in rng.normal(size=7)] + [("one", 4.0), (None, 1.0), (None, 2.0)]
    return spark.createDataFrame(rows, "g string, x double"), rows


@pytest.mark.parametrize("limit", [10**6, 5])
def test_quantiles(skewed, limit):
    df, rows = skewed
    probs = {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r["g"]: r for r in quantiles(df, ["g"], ["x"], probs, small_group=limit, slices=8).collect()}
    for g in {r[0] for r in rows}:
        v = np.array([x for k, x in rows if k == g])
        assert got[g]["n"] == len(v)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(v, p), abs=1e-12)


@pytest.mark.parametrize("limit", [10**6, 5])
def test_weighted_quantiles_count_a_block_once(spark, limit):
    df = spark.createDataFrame([(0.0, 90), (1.0, 1), (2.0, 4), (5.0, 5)], "x double, w bigint")
    v = np.repeat([0.0, 1.0, 2.0, 5.0], [90, 1, 4, 5])
    r = quantiles(df, [], ["x"], {"p": 0.95, "q": 0.905}, weight="w", small_group=limit, slices=2).first()
    assert r["p"] == pytest.approx(np.quantile(v, 0.95)) and r["q"] == pytest.approx(np.quantile(v, 0.905))


@pytest.mark.parametrize("limit", [10**6, 5])
def test_average_ranks(skewed, limit):
    df, rows = skewed
    got = average_ranks(df.where("g is not null"), ["g"], "x", small_group=limit, slices=8,
                        extra=[F.count_if(F.col("x") > 0).alias("pos")]).toPandas()
    for g in ("hot", "cold", "one"):
        v = np.array([x for k, x in rows if k == g])
        for _, r in got[got.g == g].iterrows():
            less, same = (v < r.x).sum(), (v == r.x).sum()
            assert r["rank"] == less + (same + 1) / 2 and r.ties == same and r.group_n == len(v)
            assert r.pos == (same if r.x > 0 else 0)


def test_numbering_over_ranges(spark):
    from stipple.functions.order import numbered, running_min_from_end, running_sum_before
    from stipple.operators.vectors import gene_index

    genes = spark.range(250_000).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("gene"))
    index = gene_index(genes).toPandas().sort_values("gene")
    assert (index.i.to_numpy() == np.arange(250_000)).all()
    rng = np.random.default_rng(2)
    group, value = rng.choice(["a", "b", None], 3000, p=[0.9, 0.09, 0.01]), rng.normal(size=3000)
    table = spark.createDataFrame([(g, int(i), float(v)) for i, (g, v) in enumerate(zip(group, value))], "g string, i int, v double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges for so few rows
    got = numbered(table, ["v", "i"], ["g"], "at", size="n", part="part")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = running_min_from_end(got, F.col("v") * F.col("v"), ["g"], "at", "part", "low")
    got = running_sum_before(got, F.col("v"), ["g"], "at", "part", "before").toPandas()
    assert len(got) == 3000 and got.part.nunique() > 1
    for _, rows in got.groupby("g", dropna=False):
        rows = rows.sort_values("at")
        assert (rows["at"].to_numpy() == np.arange(len(rows))).all() and (rows.n == len(rows)).all() and rows.v.is_monotonic_increasing
        assert np.allclose(rows.low, np.minimum.accumulate((rows.v ** 2).to_numpy()[::-1])[::-1])
        assert np.allclose(rows.before, np.concatenate([[0], np.cumsum(rows.v)[:-1]]))


def test_adjustment_over_ranges_with_ties_and_nulls(spark):
    from stipple.operators.composition import bh

    rng = np.random.default_rng(3)
    p = np.round(rng.random(2000) ** 3, 3)
    rows = [("x", i, float(v)) for i, v in enumerate(p)] + [("x", 5000, None), ("y", 1, 0.2), ("z", 1, None)]
    got = bh(spark.createDataFrame(rows, "c string, i int, pvalue double").repartition(7), by=["c"], tie=["i"]).toPandas()
    x = got[(got.c == "x") & got.pvalue.notna()].sort_values(["pvalue", "i"])
    q = np.minimum.accumulate((x.pvalue.to_numpy() * 2000 / np.arange(1, 2001))[::-1])[::-1]
    assert np.allclose(x.padj, np.minimum(q, 1)) and got[got.pvalue.isna()].padj.isna().all()
    assert got[got.c == "y"].padj.tolist() == [0.2] and len(got) == 2003
