"""Queries on decompositions, neighbours, clusters, trajectories, shifts and
count correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipple.operators import ambient, cluster, doublets, layout, linalg, neighbors, shift, size_factors, summary, trajectory
from stipple.operators import composition as comp
from stipple.operators import features, labels, normalize
from stipple.operators.combat import combat as combat_
from stipple.operators.vectors import cell_vectors, gene_index
from stipple.plans import tables as tb
from stipple.plans.registry import CELLS, COUNTS, VECTORS, query, rounded, with_
from stipple.session import cut

KNN = """d AS (SELECT a.cell_id src, b.cell_id dst, list_distance(a.vec, b.vec) dist FROM vectors a JOIN vectors b ON a.cell_id <> b.cell_id),
knn AS (SELECT src, dst, dist, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY dist, dst) rank FROM d) WHERE rank < 15)"""
PAGA = """sz AS (SELECT {by} cluster g, COUNT(*) ns FROM vectors GROUP BY ALL),
nn AS (SELECT {by} SUM(ns) n FROM sz GROUP BY ALL),
ed AS (SELECT {bya} a.cluster ga, b.cluster gb, COUNT(*) e FROM knn JOIN vectors a ON a.cell_id = src JOIN vectors b ON b.cell_id = dst {on} GROUP BY ALL),
es AS (SELECT {by} ga g, SUM(e) es FROM ed GROUP BY ALL),
st AS (SELECT sz.*, COALESCE(es, 0) es FROM sz LEFT JOIN es USING ({by} g)),
pr AS (SELECT {by} LEAST(ga, gb) a, GREATEST(ga, gb) b, SUM(e) edges FROM ed WHERE ga <> gb GROUP BY ALL),
pg AS (SELECT {byp} a, b, CAST(edges AS BIGINT) edges, (x.es * y.ns + y.es * x.ns) / CAST(n - 1 AS DOUBLE) expected FROM pr
  JOIN st x ON x.g = a {onx} JOIN st y ON y.g = b {ony} JOIN nn {onn}),
paga AS (SELECT *, LEAST(1, edges / expected) weight FROM pg)"""
PLAIN = PAGA.format(by="", bya="", byp="", on="", onx="", ony="", onn="ON TRUE")
SPLIT = PAGA.format(by="condition,", bya="a.condition condition,", byp="pr.condition,", on="AND a.condition = b.condition",
                    onx="AND x.condition = pr.condition", ony="AND y.condition = pr.condition", onn="ON nn.condition = pr.condition")
W = "ROUND(expected, 6) expected, ROUND(weight, 6) weight"


def edges(spark, sf):
    return cut(neighbors.knn(tb.vectors(spark, sf), 15), "knn")


def graph(spark, sf):
    return cut(neighbors.connectivities(edges(spark, sf)), "graph")


def norm(spark, sf):
    return cut(normalize.shifted_log(cut(tb.basket_counts(spark, sf), "counts")), "norm")


# ---- decompositions -------------------------------------------------------------------------------


def deviant_vectors(spark, sf, k: int = 400):
    counts = cut(tb.basket_counts(spark, sf), "counts")
    top = features.binomial_deviance(counts).orderBy(F.desc("binomial_deviance"), "gene").limit(k)
    index = cut(gene_index(top), "index")
    rows = cut(cell_vectors(normalize.shifted_log(counts), index, cells=tb.basket_cells(spark, sf)), "rows")
    return rows, index.count()


@query("pca_deviant_genes")
def pca_deviant_genes(spark, sf):
    rows, width = deviant_vectors(spark, sf)
    return linalg.pca(rows, width, 50, tol=1e-4).scores


@query("pca_score_moments", with_(VECTORS) + """, x AS (SELECT cell_id, unnest(vec) x, generate_subscripts(vec, 1) i FROM vectors),
m AS (SELECT i, AVG(x) m FROM x GROUP BY i)
SELECT cell_id, ROUND(SUM((x - m) * (x - m)), 6) norm2 FROM x JOIN m USING (i) GROUP BY cell_id""")
def pca_score_moments(spark, sf):
    """A full-rank PCA keeps every cell's squared distance to the mean."""
    d = linalg.pca(cut(tb.vectors(spark, sf).select("cell_id", "vec"), "rows"), 64, 64)
    return rounded(d.scores.select("cell_id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("norm2")))


@query("truncated_svd")
def truncated_svd(spark, sf):
    rows, width = deviant_vectors(spark, sf)
    return linalg.truncated_svd(rows, width, 50, tol=1e-4).scores


@query("lda_axis")
def lda_axis(spark, sf):
    return rounded(linalg.lda_axis(tb.vectors(spark, sf), 64).select("cell_id", "cluster", "condition", "lda_z"))


@query("lda_rank_test")
def lda_rank_test(spark, sf):
    z = linalg.lda_axis(tb.vectors(spark, sf), 64)
    return rounded(comp.bh(comp.mann_whitney(z, "cluster", "lda_z"), tie=["cluster"]))


@query("combat")
def combat(spark, sf):
    layer = norm(spark, sf)
    cells = cut(tb.basket_cells(spark, sf), "cells")
    index = cut(gene_index(layer), "index")
    return combat_(layer, cells, index)


# ---- neighbours and clusters ----------------------------------------------------------------------


@query("knn", with_(VECTORS, KNN) + "SELECT src, dst, ROUND(dist, 6) dist, rank FROM knn")
def knn(spark, sf):
    return rounded(neighbors.knn(tb.vectors(spark, sf), 15))


@query("knn_leading_dims", with_(VECTORS.replace("list_transform(embedding,", "list_transform(embedding[1:40],"), KNN)
       + "SELECT src, dst, ROUND(dist, 6) dist, rank FROM knn")
def knn_leading_dims(spark, sf):
    return rounded(neighbors.knn(tb.vectors(spark, sf), 15, n_dims=40))


@query("connectivities")
def connectivities(spark, sf):
    return rounded(neighbors.connectivities(edges(spark, sf)))


@query("silhouette", with_(VECTORS) + """, dd AS (SELECT a.cell_id, a.cluster own, b.cluster other, SUM(list_distance(a.vec, b.vec)) s
FROM vectors a, vectors b GROUP BY ALL), sz AS (SELECT cluster other, COUNT(*) n FROM vectors GROUP BY ALL),
p AS (SELECT cell_id, MAX(CASE WHEN own = other THEN s / (n - 1) END) a, MIN(CASE WHEN own <> other THEN s / n END) b FROM dd JOIN sz USING (other) GROUP BY cell_id)
SELECT 'cluster' labelling, ROUND(AVG((b - a) / GREATEST(a, b)), 6) silhouette, (SELECT COUNT(*) FROM sz) n_clusters FROM p""")
def silhouette(spark, sf):
    return rounded(neighbors.silhouettes(tb.vectors(spark, sf), ["cluster"]))


@query("leiden")
def leiden(spark, sf):
    return cluster.leiden(graph(spark, sf), [1.0])


@query("resolution_scan")
def resolution_scan(spark, sf):
    return rounded(cluster.resolution_scan(graph(spark, sf), tb.vectors(spark, sf), [0.5, 1.0, 2.0])[1])


@query("layout")
def layout_(spark, sf):
    g = graph(spark, sf)
    start, _ = trajectory.diffmap(g, 3, tol=1e-3, block=20)
    return layout.layout(g, start.select("cell_id", F.slice("vec", 2, 2).alias("vec")), epochs=8)


# ---- trajectories ----------------------------------------------------------------------------------


@query("diffusion_map")
def diffusion_map(spark, sf):
    return trajectory.diffmap(graph(spark, sf), 15)[0]


@query("pick_root", with_(VECTORS) + """SELECT cell_id FROM vectors WHERE cluster IN ('1', '4') ORDER BY vec[2], cell_id LIMIT 1""")
def pick_root(spark, sf):
    v = tb.vectors(spark, sf)
    return trajectory.pick_root(v.select("cell_id", "vec"), v, ["1", "4"])


EIGEN = [1.0, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]


@query("pseudotime", with_(VECTORS) + f""", r AS (SELECT vec rv FROM vectors WHERE cluster IN ('1', '4') ORDER BY vec[2], cell_id LIMIT 1),
l AS (SELECT {EIGEN} lam), q AS (SELECT cell_id, sqrt(list_sum(list_transform(generate_series(2, 10), lambda i:
  power((vec[i] - rv[i]) * (lam[i] / (1 - lam[i])), 2)))) d FROM vectors, r, l)
SELECT cell_id, ROUND(d / (SELECT MAX(d) FROM q), 6) pseudotime FROM q""")
def pseudotime(spark, sf):
    v = tb.vectors(spark, sf)
    e = v.select("cell_id", "vec")
    return rounded(trajectory.pseudotime(e, EIGEN, trajectory.pick_root(e, v, ["1", "4"])))


def diffusion_times(spark, sf):
    v = tb.vectors(spark, sf)
    e, values = trajectory.diffmap(graph(spark, sf), 10, tol=1e-4)
    e = cut(e, "diffmap")
    return trajectory.pseudotime(e, values, trajectory.pick_root(e, v, ["1", "4"])).join(v.drop("vec"), "cell_id")


@query("pseudotime_by_condition")
def pseudotime_by_condition(spark, sf):
    t = labels.split_conditions(diffusion_times(spark, sf))
    return rounded(summary.group_quartiles(t, ["panel", "cluster"], "pseudotime"))


@query("paga", with_(VECTORS, KNN, PLAIN) + f"SELECT a, b, edges, {W} FROM paga")
def paga(spark, sf):
    return rounded(trajectory.paga(edges(spark, sf), tb.vectors(spark, sf)))


@query("paga_by_condition", with_(VECTORS, KNN, SPLIT) + f"SELECT condition, a, b, edges, {W} FROM paga")
def paga_by_condition(spark, sf):
    return rounded(trajectory.paga(edges(spark, sf), tb.vectors(spark, sf), by="condition"))


FATES = {"0": "left", "1": "left", "2": "left", "3": "right", "4": "right", "5": "right", "6": "far"}
FATE_SQL = VECTORS.replace("CAST(label AS VARCHAR) cluster", """CASE WHEN label IN (0, 1, 2) THEN 'left'
  WHEN label IN (3, 4, 5) THEN 'right' WHEN label = 6 THEN 'far' ELSE 'unknown' END cluster""")


@query("paga_fate_groups", with_(FATE_SQL, KNN, SPLIT) + f"SELECT condition, a, b, edges, {W} FROM paga")
def paga_fate_groups(spark, sf):
    m = spark.createDataFrame([(k, k, int(k), v) for k, v in FATES.items()], "cluster string, name string, ord int, fate string")
    named = labels.apply_fate(labels.apply_labels(tb.vectors(spark, sf).drop("vec"), m), m)
    return rounded(trajectory.paga(edges(spark, sf), named, "fate_group", by="condition"))


@query("threshold_edges", with_(VECTORS, KNN, SPLIT) + f"""SELECT condition, a, b, edges, {W} FROM paga WHERE weight > 0.9""")
def threshold_edges(spark, sf):
    p = trajectory.paga(edges(spark, sf), tb.vectors(spark, sf), by="condition")
    return rounded(trajectory.threshold_edges(p, 0.9))


@query("paga_nodes", with_(VECTORS) + """, m("name", ord, fate) AS (VALUES ('0', 0, 'left'), ('1', 1, 'left'), ('2', 2, 'left'), ('3', 3, 'right'),
('4', 4, 'right'), ('5', 5, 'right'), ('6', 6, 'far'), ('none', 7, 'unknown'))
SELECT "name", CAST(ord AS BIGINT) ord, fate, COUNT(cell_id) n_cells FROM m LEFT JOIN vectors ON cluster = "name" GROUP BY ALL""")
def paga_nodes(spark, sf):
    rows = [(k, k, int(k), v) for k, v in FATES.items()] + [("none", "none", 7, None)]
    m = spark.createDataFrame(rows, "cluster string, name string, ord int, fate string")
    return rounded(trajectory.paga_nodes(tb.vectors(spark, sf), m, "cluster"))


# ---- shifts ----------------------------------------------------------------------------------------


@query("energy_distance", with_(VECTORS) + """, p AS (SELECT a.cluster, a.condition ca, b.condition cb, AVG(list_distance(a.vec, b.vec)) m
FROM vectors a JOIN vectors b ON a.cluster = b.cluster GROUP BY ALL),
n AS (SELECT cluster, COUNT(*) FILTER (condition = 'WT') n_ref, COUNT(*) FILTER (condition = 'KO') n_test FROM vectors GROUP BY cluster)
SELECT cluster, n_ref, n_test, ROUND(2 * MAX(m) FILTER (ca = 'WT' AND cb = 'KO') - MAX(m) FILTER (ca = 'WT' AND cb = 'WT') - MAX(m) FILTER (ca = 'KO' AND cb = 'KO'), 6) edistance
FROM p JOIN n USING (cluster) GROUP BY ALL""")
def energy_distance(spark, sf):
    return rounded(shift.energy_distance(tb.vectors(spark, sf)))


@query("expression_shift")
def expression_shift(spark, sf):
    return rounded(shift.expression_shift(tb.vectors(spark, sf)))


@query("shift_z", with_(VECTORS) + """, x AS (SELECT condition, unnest(vec) x, generate_subscripts(vec, 1) i FROM vectors),
c AS (SELECT list(m ORDER BY i) c FROM (SELECT i, AVG(x) m FROM x WHERE condition = 'WT' GROUP BY i)),
d AS (SELECT cell_id, cluster, condition, list_distance(vec, c) d FROM vectors, c)
SELECT cell_id, cluster, condition, ROUND((d - (SELECT AVG(d) FROM d)) / (SELECT STDDEV_POP(d) FROM d), 5) edist_z FROM d""")
def shift_z(spark, sf):
    return rounded(shift.shift_z(tb.vectors(spark, sf)).select("cell_id", "cluster", "condition", "edist_z"), 5)


@query("shift_plot_order", with_(VECTORS) + """, x AS (SELECT condition, unnest(vec) x, generate_subscripts(vec, 1) i FROM vectors),
c AS (SELECT list(m ORDER BY i) c FROM (SELECT i, AVG(x) m FROM x WHERE condition = 'WT' GROUP BY i)),
d AS (SELECT cluster, list_distance(vec, c) d FROM vectors, c), z AS (SELECT cluster, (d - (SELECT AVG(d) FROM d)) / (SELECT STDDEV_POP(d) FROM d) z FROM d)
SELECT cluster, COUNT(*) n, ROUND(quantile_cont(z, 0.25), 5) q1, ROUND(median(z), 5) "median", ROUND(quantile_cont(z, 0.75), 5) q3 FROM z GROUP BY cluster""")
def shift_plot_order(spark, sf):
    return rounded(summary.group_quartiles(shift.shift_z(tb.vectors(spark, sf)), ["cluster"], "edist_z"), 5)


# ---- count correction -------------------------------------------------------------------------------


def grouped_counts(spark, sf):
    counts = cut(tb.basket_counts(spark, sf), "counts")
    groups = tb.basket_cells(spark, sf).select("cell_id", F.col("cluster").alias("group"))
    return counts, groups, cut(ambient.ambient_profile(counts), "profile")


@query("contamination")
def contamination(spark, sf):
    return rounded(ambient.contamination(*grouped_counts(spark, sf)))


AMBIENT = """per AS (SELECT counts.sample, cluster grp, gene, CAST(SUM(n) AS DOUBLE) obs FROM counts JOIN cells USING (cell_id) GROUP BY ALL),
um AS (SELECT sample, grp, SUM(obs) umi FROM per GROUP BY ALL),
pf AS (SELECT sample, gene, SUM(obs) / SUM(SUM(obs)) OVER (PARTITION BY sample) est FROM per GROUP BY sample, gene),
tt AS (SELECT *, umi * est * 0.05 lam FROM per JOIN um USING (sample, grp) JOIN pf USING (sample, gene)),
tp AS (SELECT *, 1 - COALESCE(list_sum(list_transform(range(0, CAST(obs AS BIGINT)), lambda k: exp(k * ln(lam) - lam - lgamma(k + 1)))), 0) p FROM tt),
ob AS (SELECT *, COALESCE(SUM(obs) OVER (PARTITION BY sample, grp ORDER BY ROUND(p, 9) DESC, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM tp),
pm AS (SELECT sample, grp, k, SUM(exp(k * ln(umi * 0.05) - umi * 0.05 - lgamma(k + 1))) OVER (PARTITION BY sample, grp ORDER BY k) cdf
  FROM (SELECT *, unnest(range(0, CAST(umi AS BIGINT))) k FROM um)),
pa AS (SELECT ob.*, CASE WHEN b = 0 THEN p ELSE p * GREATEST(1 - cdf, 0) END pp FROM ob LEFT JOIN pm ON pm.sample = ob.sample AND pm.grp = ob.grp AND pm.k = b - 1),
qq AS (SELECT *, CASE WHEN pp > 0 THEN pp * (1 - ln(pp)) ELSE 0 END q FROM pa)"""


@query("ambient_gene_tests", with_(CELLS, COUNTS, AMBIENT) + 'SELECT sample, grp "group", gene, obs, ROUND(p, 6) p, ROUND(q, 6) q, q < 0.01 keep FROM qq')
def ambient_gene_tests(spark, sf):
    """The tests behind the removal at one contamination for all samples."""
    counts, groups, profile = grouped_counts(spark, sf)
    rho = profile.select("sample").distinct().withColumn("rho", F.lit(0.05))
    t = ambient.ambient_genes(counts, groups, profile, rho)
    return rounded(t.withColumn("obs", F.col("obs").cast("double")))


@query("remove_ambient_fixed", with_(CELLS, COUNTS, AMBIENT) + """SELECT counts.sample, cell_id, counts.gene, n FROM counts JOIN cells USING (cell_id)
JOIN qq ON qq.sample = counts.sample AND qq.grp = cells.cluster AND qq.gene = counts.gene WHERE q < 0.01""")
def remove_ambient_fixed(spark, sf):
    counts, groups, profile = grouped_counts(spark, sf)
    return ambient.remove_ambient(counts, groups, profile, profile.select("sample").distinct().withColumn("rho", F.lit(0.05)))


@query("remove_ambient")
def remove_ambient(spark, sf):
    counts, groups, profile = grouped_counts(spark, sf)
    rho = ambient.contamination(counts, groups, profile)
    return ambient.remove_ambient(counts, groups, profile, rho)


@query("ambient_groups")
def ambient_groups(spark, sf):
    """Coarse groups for the background estimate: log layer, principal
    components, neighbours, communities."""
    rows, width = deviant_vectors(spark, sf)
    scores = linalg.pca(rows, width, 15, tol=1e-3).scores
    return cluster.knn_clusters(cut(scores, "scores"), 15)


@query("artificial_doublets")
def artificial_doublets(spark, sf):
    return doublets.artificial_doublets(tb.basket_counts(spark, sf))


@query("doublet_scores")
def doublet_scores(spark, sf):
    return rounded(doublets.doublets(tb.basket_counts(spark, sf)))


@query("pooled_size_factors")
def pooled_size_factors(spark, sf):
    counts, groups, _ = grouped_counts(spark, sf)
    return rounded(size_factors.pooled_size_factors(counts, groups, min_mean=0.1))
