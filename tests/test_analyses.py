"""The composed analyses end to end on a small planted experiment."""

import numpy as np
from pyspark.sql import functions as F

from stipple.plans import analyses
from stipple.session import cut
from stipple.sources import stages


def test_samples_to_contrast(spark, tmp_path):
    rng = np.random.default_rng(11)
    n = 240
    sample, kind = np.arange(n) % 4, np.arange(n) // 4 % 3
    base = rng.gamma(0.8, 1.0, size=(3, 90))
    for j in range(3):
        base[j, 20 * j:20 * j + 20] *= 6
    x = rng.poisson(base[kind] * rng.lognormal(0, 0.2, size=(n, 1)) * np.where(sample == 1, 1.5, 1.0)[:, None])
    rows = [(f"s{sample[i]}", f"c{i:03d}", f"Gene{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    counts = cut(spark.createDataFrame(rows, "sample string, cell_id string, gene string, n double"))
    cells = cut(spark.createDataFrame(
        [(f"c{i:03d}", f"s{sample[i]}", "WT" if sample[i] < 2 else "KO") for i in range(n)],
        "cell_id string, sample string, condition string"))
    root = str(tmp_path)
    analyses.clean_samples(counts, cells, root, min_cells=3, n_pcs=5)
    assert {r.layer for r in stages.layers(spark, root, "clean").collect()} == {"counts", "log1p_norm", "pooled_norm"}
    scan = analyses.integrate(spark, root, n_genes=60, n_comps=8, n_pcs=6, resolutions=(0.5, 1.0), epochs=1).toPandas()
    assert scan.best.sum() == 1 and scan.silhouette.max() > 0.1

    best = float(scan.resolution[scan.best].iloc[0])
    found = stages.read_stage(spark, root, "integrated", "clusters").where(F.col("resolution") == best)
    labelled = stages.read_stage(spark, root, "clean", "cells").join(found.select("cell_id", "cluster"), "cell_id")
    truth = {f"c{i:03d}": kind[i] for i in range(n)}
    got = labelled.select("cell_id", "cluster").toPandas()
    got["truth"] = got.cell_id.map(truth)
    assert got.groupby("cluster").truth.agg(lambda v: v.value_counts(normalize=True).iloc[0]).mean() > 0.9
    names = sorted(got.cluster.unique())
    label_map = spark.createDataFrame([(c, f"k{c}", i, None) for i, c in enumerate(names)],
                                      "cluster string, name string, ord int, fate string")
    out = analyses.contrast(labelled, stages.read_stage(spark, root, "integrated", "pca_after"), label_map,
                            min_cells=10, dims=8, n_perms=49)
    for name in ("composition", "shift", "axis"):
        t = out[name].toPandas()
        assert len(t) >= 2 and t.padj.between(0, 1).all()
