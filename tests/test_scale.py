"""Steps whose work must not grow faster than their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.operators import composition, linalg, neighbors, normalize
from stipple.plans import tables as tb
from stipple.plans.catalog import QUERIES
from stipple.sources import matrix_csv


def test_wide_lines_keep_only_what_is_not_zero(spark, tmp_path):
    (tmp_path / "1_0_M_WT_qc_norm.csv").write_text("Gene,a,0,c\ng1,0,0, 3\ng2,0,0,0\ng3,1.5,0,0\n\ng4,00,2,0\n")
    (tmp_path / "2_0_F_KO_qc_norm.csv").write_text("Gene,a,b\ng1,1,\n,0,0\ng2,0\ng3\ng4,0,x\ng5,0,-1\n")
    lines, header = matrix_csv._lines(spark, str(tmp_path))
    first = lines.where(F.col("file").contains("/1_0")).orderBy("gene").select("gene", "count", "at", "texts", "width").collect()
    assert [tuple(r) for r in first] == [
        ("g1", 3, [2], [" 3"], 3), ("g2", 3, [], [], 3), ("g3", 3, [0], ["1.5"], 3), ("g4", 3, [0, 1], ["00", "2"], 3)]
    assert {(r.pos, r.cell_id) for r in header.where(F.col("file").contains("/1_0")).collect()} == {(0, "a"), (1, "0"), (2, "c")}
    counts, cells, bad = matrix_csv.read_samples(spark, str(tmp_path))
    assert {(r.cell_id, r.gene, r.n) for r in counts.collect()} == {("c", "g1", 3.0), ("a", "g3", 1.5), ("0", "g4", 2.0)}
    assert cells.count() == 3
    assert {(r.reason, r.n_lines) for r in bad.collect()} == {
        ("not a number", 2), ("empty gene", 1), ("ragged row", 2), ("negative count", 1)}


def test_lines_longer_than_a_step(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matrix_csv, "TEXT_BYTES", 16)
    import pyarrow as pa
    text = ["é,0,12,0", "no", ",", "x,0,0,0,0,0,0,0,0,0,7", "y,"]
    n = len(text)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["f"] * n), pa.array([0] * n), pa.array(range(n)), pa.array(text)], names=["file", "block", "row", "value"])
    rows = [r for b in matrix_csv._fields(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    assert [(r["gene"], r["count"], r["at"], r["texts"]) for r in rows] == [
        ("é", 3, [1], ["12"]), ("no", 0, [], []), ("", 1, [0], [""]), ("x", 10, [9], ["7"]), ("y", 1, [0], [""])]


def test_equal_vectors_are_looked_for_once(spark, vec_table, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 3)), 1)
    x[rng.permutation(400)[:250]] = 0.0
    x[rng.permutation(400)[:40]] = [0.1, 0.0, 0.0]
    met = []
    monkeypatch.setattr(neighbors, "_nearest", lambda store, points, *a, f=neighbors._nearest: (met.append(points.count()), f(store, points, *a))[1])
    got = neighbors.knn(vec_table(x), 6, block=50).orderBy("src", "rank").toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(400), d.shape), d), axis=1)[:, :5]
    assert np.array_equal(got.dst.to_numpy().reshape(400, 5), want)
    assert np.allclose(got.dist.to_numpy().reshape(400, 5), np.take_along_axis(d, want, 1))
    assert got["rank"].tolist() == [1, 2, 3, 4, 5] * 400 and met[0] < 200


def test_neighbour_blocks_grow_with_the_table(spark, vec_table, monkeypatch):
    seen, tree = [], neighbors._tree
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    monkeypatch.setattr(neighbors, "HITS", 8)
    monkeypatch.setattr(neighbors, "_tree", lambda store, points, block, seed: seen.append(block) or tree(store, points, block, seed))
    x = np.random.default_rng(5).normal(size=(480, 6))
    x[:40] = x[0]
    got = neighbors.knn(vec_table(x), 6).orderBy("src", "rank").toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert seen == [480 // neighbors.SENT]
    assert (got.dst.to_numpy().reshape(480, 5) == np.argsort(d, axis=1, kind="stable")[:, :5]).all()


def test_super_blocks_are_bounded(spark):
    points = spark.createDataFrame([([0.0, 1.0],)], "vec array<double>")
    blocks = spark.range(1).select(neighbors.grid_side(points, F.lit(500_000), None)).first()[0]
    assert 500_000 / blocks <= neighbors.MOST_BLOCK


@pytest.mark.parametrize("name", ["shifted_log_tokens", "binomial_deviance_tokens"])
def test_texts_are_split_once(spark, tmp_path, name):
    docs = [(i, "a b b" if i % 2 else "a c", "en", f"s{i % 2}") for i in range(6)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    assert out.count() == (6 if name == "shifted_log_tokens" else 3)
    assert not any("documents.parquet" in f for f in out.inputFiles())


def test_basket_counts_group_by_numbers(spark, tmp_path):
    def save(rows, schema, name):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    save([(1, 7, "BUILDING"), (2, 8, "BUILDING")], "c_custkey bigint, c_nationkey int, c_mktsegment string", "customer")
    save([(7, "N7", 0), (8, "N8", 1)], "n_nationkey int, n_name string, n_regionkey int", "nation")
    save([(10, 1), (11, 2), (12, 1), (13, None)], "o_orderkey bigint, o_custkey bigint", "orders")
    save([(10, 5, 2.0), (12, 5, 3.0), (11, 6, 1.0), (13, 6, 9.0), (11, None, 4.0)], "l_orderkey bigint, l_partkey bigint, l_quantity double", "lineitem")
    counts = tb.basket_counts(spark, str(tmp_path))
    assert counts.dtypes == [("sample", "string"), ("cell_id", "string"), ("gene", "string"), ("n", "double")]
    assert {tuple(r) for r in counts.collect()} == {("N7", "1", "5", 5.0), ("N8", "2", "6", 1.0), ("N8", "2", None, 4.0)}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_welch_without_variance(spark):
    rows = [("s1", "x", 1.0), ("s2", "x", 1.0), ("s3", "x", 2.0), ("s4", "x", 2.0), ("s1", "y", 1.0), ("s2", "y", 1.0), ("s3", "y", 1.0), ("s4", "y", 1.0)]
    meta = spark.createDataFrame([("s1", "WT"), ("s2", "WT"), ("s3", "KO"), ("s4", "KO")], "sample string, condition string")
    got = composition.welch(spark.createDataFrame(rows, "sample string, cluster string, clr double"), meta)
    p = {r.cluster: r.pvalue for r in got.collect()}
    assert p["x"] == 0.0 and (p["y"] is None or np.isnan(p["y"]))


def test_pearson_residuals_repeat_no_value_of_one_gene_total(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(0.05, size=(40, 3000)).astype(float)
    x[5] = 0
    rows = [(f"c{c}", [int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for c, r in enumerate(x)]
    vecs = spark.createDataFrame([*rows, rows[7]], "cell_id string, idx array<int>, val array<double>")
    totals = spark.createDataFrame([(i, float(t)) for i, t in enumerate(x.sum(axis=0))], "i int, t double")
    short = normalize.pearson_residuals(vecs, totals, 41, dense=False).collect()
    whole = {r.cell_id: np.array(r.vec) for r in normalize.pearson_residuals(vecs, totals, 41).collect()}
    assert sorted(r.cell_id for r in short) == sorted([*(r[0] for r in rows), "c7"])
    steps = np.unique(x.sum(axis=0))
    for r in short:
        assert len(r.zero) == len(r.left) == len(steps) < 20 and sum(r.left) + len(r.idx) == 3000
        got = np.array(r.zero)[np.searchsorted(steps, x.sum(axis=0))]
        got[r.idx] = r.val
        assert np.allclose(got, whole[r.cell_id], atol=1e-12)


def test_pearson_residuals_query_sums_all_residuals(spark, monkeypatch):
    counts = [("s", f"c{c}", f"g{(c * 7 + j) % 50}", float(j % 3 + 1)) for c in range(20) for j in range(9)]
    monkeypatch.setattr(tb, "basket_counts", lambda *a: spark.createDataFrame(counts, "sample string, cell_id string, gene string, n double"))
    got = {r.cell_id: r for r in QUERIES["pearson_residuals"](spark, "").collect()}
    x = np.zeros((20, 50))
    for _, c, g, n in counts:
        x[int(c[1:]), int(g[1:])] += n
    mu = x.sum(axis=1, keepdims=True) * x.sum(axis=0) / x.sum()
    with np.errstate(invalid="ignore"):
        z = np.clip(np.nan_to_num((x - mu) / np.sqrt(mu + mu * mu / 100)), -20**0.5, 20**0.5)
    assert len(got) == 20
    for c in range(20):
        assert abs(got[f"c{c}"].residual_sum - z[c].sum()) < 1e-3 and abs(got[f"c{c}"].residual_ss - (z[c] ** 2).sum()) < 1e-3


@pytest.mark.parametrize("centre", [True, False])
def test_narrow_decompositions_need_one_pass(spark, monkeypatch, centre):
    rng = np.random.default_rng(5)
    x = rng.poisson(0.3, size=(300, 30)) * (1 + rng.random(30))
    x[7] = 0
    rows = spark.createDataFrame(
        [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for i, r in enumerate(x)],
        "cell_id bigint, idx array<int>, val array<double>").repartition(5).cache()
    decompose = linalg.pca if centre else linalg.truncated_svd
    with monkeypatch.context() as m:
        m.setattr(linalg, "GRAM_WIDTH", 0)
        steps = decompose(rows, 30, 6, tol=1e-10)

    def none(*args, **kwargs):
        raise AssertionError("solved by steps")

    monkeypatch.setattr(linalg, "eigenpairs", none)
    monkeypatch.setattr(linalg, "BLOCK_DOUBLES", 700)  # pieces of 23 rows
    once = decompose(rows, 30, 6)
    assert np.allclose(once.variance, steps.variance) and np.allclose(once.ratio, steps.ratio)
    for a, b in ((once.scores, steps.scores), (once.components.withColumnRenamed("i", "cell_id"), steps.components.withColumnRenamed("i", "cell_id"))):
        a, b = ({r.cell_id: r.vec for r in t.collect()} for t in (a, b))
        assert a.keys() == b.keys() and all(np.allclose(a[c], b[c], atol=1e-6) for c in a)
