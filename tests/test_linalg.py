"""Decompositions, batch correction and residuals against dense numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stipple.operators import linalg, normalize, size_factors
from stipple.operators.combat import combat
from stipple.operators.vectors import cell_vectors, gene_index
from stipple.session import cut


def long(spark, x, value="value"):
    rows = [(f"c{i:03d}", f"g{j:03d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return cut(spark.createDataFrame(rows, f"cell_id string, gene string, {value} double"), "long")


def gather(df, col="vec"):
    return np.array(df.orderBy("cell_id").select(col).toPandas()[col].tolist())


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(0)
    x = rng.poisson(0.6, size=(80, 40)) * rng.gamma(2.0, 1.0, size=(80, 1))
    x[:30, :6] += 3
    x[0] = 0
    return x


def rows_of(spark, x):
    index = cut(gene_index(spark.createDataFrame([(f"g{j:03d}",) for j in range(x.shape[1])], "gene string")), "i")
    cells = spark.createDataFrame([(f"c{i:03d}",) for i in range(len(x))], "cell_id string")
    return cut(cell_vectors(long(spark, x), index, cells=cells), "rows"), index, cells


def test_pca_matches_dense(spark, matrix):
    rows, _, _ = rows_of(spark, matrix)
    d = linalg.pca(rows, 40, 5, tol=1e-10)
    u, s, vt = np.linalg.svd(matrix - matrix.mean(axis=0), full_matrices=False)
    assert np.allclose(d.variance, s[:5] ** 2 / 79)
    assert np.allclose(d.ratio, s[:5] ** 2 / (s**2).sum())
    got = gather(d.scores)
    assert np.allclose(np.abs(got), np.abs(u[:, :5] * s[:5]), atol=1e-6)
    comps = np.array(d.components.orderBy("i").toPandas().vec.tolist())
    assert np.allclose(np.abs(comps), np.abs(vt[:5].T), atol=1e-6)
    assert (comps[np.abs(comps).argmax(axis=0), np.arange(5)] > 0).all()


def test_truncated_svd_matches_dense(spark, matrix):
    rows, _, _ = rows_of(spark, matrix)
    d = linalg.truncated_svd(rows, 40, 4, tol=1e-10)
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    scores = u[:, :4] * s[:4]
    assert np.allclose(np.abs(gather(d.scores)), np.abs(scores), atol=1e-6)
    assert np.allclose(d.ratio, scores.var(axis=0) / matrix.var(axis=0).sum(), atol=1e-8)


def test_scores_do_not_depend_on_partitioning(spark, matrix):
    rows, _, _ = rows_of(spark, matrix)
    a = gather(linalg.pca(rows.repartition(1), 40, 3, tol=1e-10).scores)
    b = gather(linalg.pca(rows.repartition(7), 40, 3, tol=1e-10).scores)
    assert np.allclose(a, b, atol=1e-8)


def test_lda_axis(spark, vec_table):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    y = np.arange(200) % 2
    x[y == 1] += [0.5, 0, 1, 0]
    t = linalg.lda_axis(vec_table(x, condition=np.where(y == 1, "KO", "WT")), 4).orderBy("cell_id").toPandas()
    m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
    sw = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in ((0, m0), (1, m1)))
    p = x @ np.linalg.solve(sw, m1 - m0)
    assert np.allclose(t.lda_z, (p - p.mean()) / p.std())


def dense_combat(x, batch):
    """Plain dense version used only to check the distributed one."""
    names = sorted(set(batch))
    n = np.array([(batch == b).sum() for b in names])
    means = np.array([x[batch == b].mean(0) for b in names])
    grand = (n[:, None] * means).sum(0) / n.sum()
    fit = means[[names.index(b) for b in batch]]
    sd = np.sqrt(((x - fit) ** 2).mean(0))
    z = (x - grand) / sd
    out = np.empty_like(x)
    for b in names:
        zb = z[batch == b]
        gh, dh = zb.mean(0), zb.var(0, ddof=1)
        t2, gb, m, v = gh.var(ddof=1), gh.mean(), dh.mean(), dh.var(ddof=1)
        a_, b_ = (2 * v + m * m) / v, (m * v + m**3) / v
        g, d = gh.copy(), dh.copy()
        while True:
            g2 = (t2 * len(zb) * gh + d * gb) / (t2 * len(zb) + d)
            d2 = (0.5 * ((zb - g2) ** 2).sum(0) + b_) / (len(zb) / 2 + a_ - 1)
            change = max((abs(g2 - g) / abs(g)).max(), (abs(d2 - d) / abs(d)).max())
            g, d = g2, d2
            if change < 1e-4:
                break
        out[batch == b] = (zb - g) / np.sqrt(d) * sd + grand
    return out


def test_combat_matches_dense_and_removes_batch(spark):
    rng = np.random.default_rng(2)
    x = rng.gamma(2, 1, size=(120, 30)) * (rng.random((120, 30)) < 0.7)
    batch = np.array(["a", "b", "c"])[np.arange(120) % 3]
    x[batch == "b"] *= 2.0
    rows, index, _ = rows_of(spark, x)
    cells = spark.createDataFrame([(f"c{i:03d}", str(batch[i])) for i in range(120)], "cell_id string, sample string")
    got = gather(combat(long(spark, x), cells, index))
    assert np.allclose(got, dense_combat(x, batch), atol=1e-8)
    spread = lambda m: np.var([m[batch == b].mean(0) for b in "abc"], axis=0).mean()
    assert spread(got) < 0.1 * spread(x)


def test_combat_in_small_blocks_and_without_batch(spark, monkeypatch):
    from stipple.operators import combat as module

    monkeypatch.setattr(module, "BLOCK_DOUBLES", 70)
    monkeypatch.setattr(module, "ENTRIES", 100)
    monkeypatch.setattr(module, "MAPPED", 7)
    rng = np.random.default_rng(3)
    x = rng.gamma(2, 1, size=(60, 30)) * (rng.random((60, 30)) < 0.3)
    x[5] = 0
    rows, index, _ = rows_of(spark, x)
    batch = np.array(["a", "b", "c"])[np.arange(60) % 3]
    names = [None if i >= 55 else "alone" if i == 54 else str(batch[i]) for i in range(60)]
    cells = spark.createDataFrame([(f"c{i:03d}", n) for i, n in enumerate(names)], "cell_id string, sample string")
    got = gather(combat(long(spark, x), cells, index))
    assert np.allclose(got[:54], dense_combat(x[:54], batch[:54]), atol=1e-8)
    assert np.array_equal(got[54:], x[54:])


def test_combat_query_corrects_every_gene(spark, tmp_path):
    from stipple.plans.catalog import QUERIES

    genes, cells = 10_050, 6
    tables = {
        "nation": spark.createDataFrame([(0, "A", 0), (1, "B", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": spark.createDataFrame([(c, c % 2, "m") for c in range(cells)], "c_custkey int, c_nationkey int, c_mktsegment string"),
        "orders": spark.range(cells).selectExpr("id o_orderkey", "cast(id as int) o_custkey"),
        "lineitem": spark.range(cells * genes).selectExpr(
            f"id % {cells} l_orderkey", f"cast(floor(id / {cells}) as int) l_partkey", "1.0 + pmod(hash(id), 5) l_quantity")}
    for name, t in tables.items():
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    got = QUERIES["combat"](spark, str(tmp_path)).selectExpr("cell_id", "size(vec) width").collect()
    assert len(got) == cells and {r.width for r in got} == {genes}


def test_pearson_residuals(spark, matrix):
    x = np.round(matrix)
    rows, index, _ = rows_of(spark, x)
    totals = x.sum(0)
    table = spark.createDataFrame([(j, float(t)) for j, t in enumerate(totals)], "i int, t double")
    got = gather(normalize.pearson_residuals(rows, table, 80))
    mu = np.outer(x.sum(1), totals) / x.sum()
    z = np.divide(x - mu, np.sqrt(mu + mu * mu / 100), out=np.zeros_like(x), where=mu > 0)
    assert np.allclose(got, np.clip(z, -np.sqrt(80), np.sqrt(80)))


def test_bad_size_factor_stops_the_job(spark):
    c = spark.createDataFrame([("c", "g", 1.0)], "cell_id string, gene string, n double")
    with pytest.raises(Exception, match="not positive"):
        normalize.apply_size_factors(c, spark.createDataFrame([("c", 0.0)], "cell_id string, size_factor double")).collect()


def test_pooled_size_factors_recover_known_ones(spark):
    rng = np.random.default_rng(5)
    true = rng.lognormal(0, 0.4, size=400)
    group = np.arange(400) % 2
    base = rng.gamma(1.0, 2.0, size=(2, 200))
    base[1, 100:] = base[0, 100:]
    base[1, :20] *= 8  # composition differs between groups
    x = rng.poisson(true[:, None] * base[group])
    groups = spark.createDataFrame([(f"c{i:03d}", str(group[i])) for i in range(400)], "cell_id string, group string")
    got = size_factors.pooled_size_factors(long(spark, x, "n"), groups)
    sf = got.orderBy("cell_id").toPandas().size_factor.to_numpy()
    assert abs(sf.mean() - 1) < 1e-9
    assert np.corrcoef(np.log(sf), np.log(true))[0, 1] > 0.97
    r = sf / true
    assert abs(np.median(r[group == 0]) / np.median(r[group == 1]) - 1) < 0.1


@pytest.mark.parametrize("pooled,solved", [(512, 16_384), (150, 16_384), (150, 8192)])
def test_pooled_size_factors_equal_the_dense_solution(spark, monkeypatch, pooled, solved):
    n = 17_000 if solved == 8192 else 1500
    monkeypatch.setattr(size_factors, "POOLED", pooled)
    monkeypatch.setattr(size_factors, "SOLVED", solved)
    rng = np.random.default_rng(6)
    x = rng.poisson(rng.lognormal(0, 0.4, size=(n, 1)) * rng.gamma(1.0, 2.0, size=(1, 6 if n > 2000 else 40)))
    x[:, 0] += 1
    ids = np.array([f"c{i:05d}" for i in range(n)])
    r, c = np.nonzero(x)
    table = spark.createDataFrame(pa.table({"cell_id": ids[r], "gene": [f"g{j}" for j in c], "n": x[r, c].astype(float)}).to_pandas())
    groups = spark.createDataFrame(pa.table({"cell_id": ids, "group": ["a"] * n}).to_pandas())
    got = size_factors.pooled_size_factors(cut(table), groups).orderBy("cell_id").toPandas().size_factor.to_numpy()
    total = x.sum(axis=1).astype(float)
    share = x / total[:, None]
    average = share.mean(axis=0) * total.mean()
    share, average = share[:, average >= 0.1], average[average >= 0.1]
    order = np.argsort(total, kind="stable")
    ring = np.concatenate([order[0::2], order[1::2][::-1]])
    a, b = np.zeros(n), np.zeros(n)
    for w in range(21, 102, 5):
        hot = np.zeros(n)
        hot[:w] = 1
        run = np.vstack([share[ring], share[ring][: w - 1]])
        sums = np.vstack([np.zeros((1, run.shape[1])), np.cumsum(run, axis=0)])
        pool = np.median((sums[w:] - sums[:-w]) / average, axis=1)
        f = np.fft.rfft(hot)
        a += np.fft.irfft(f * f.conj(), n)
        b += np.fft.irfft(np.fft.rfft(pool) * f, n)  # the cells of a pool get its median
    a[0] += 1e-6
    b += 1e-6 / average.sum()
    rate = np.fft.irfft(np.fft.rfft(b) / np.fft.rfft(a), n)
    want = np.empty(n)
    want[ring] = np.where(rate > 0, rate, np.median(rate[rate > 0]))
    want *= total
    assert np.allclose(got, want / want.mean(), rtol=1e-6)
