"""The three composed analyses: one sample set, integration, contrast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.operators import ambient, cluster, composition, doublets, features, labels, linalg, neighbors, normalize, qc
from stipple.operators import shift, size_factors, trajectory
from stipple.operators.combat import combat
from stipple.operators.layout import layout
from stipple.operators.vectors import cell_vectors, gene_index
from stipple.session import cut
from stipple.sources import stages


def clean_samples(
    counts: DataFrame, cells: DataFrame, root: str, genes: DataFrame | None = None, nmads: float = 5,
    max_pct: float = 5.0, min_cells: int = 10, rho_range: tuple[float, float] = (0.01, 0.1), n_pcs: int = 15,
) -> str:
    """Quality control, background removal, doublets and three normalisations
    for all samples at once; written as stage ``clean``."""
    if genes is None:
        genes = counts.select("gene").distinct()
    flagged = cut(qc.flag_genes(genes, qc.GENE_FLAGS), "flags")
    metrics = qc.cell_qc(counts, cells, flagged, list(qc.GENE_FLAGS))
    kept_counts, kept_cells = qc.apply_qc(counts, cut(qc.qc_flags(metrics, nmads, "pct_counts_mt", max_pct), "qc"))
    kept_counts, kept_cells = cut(kept_counts, "kept"), cut(kept_cells, "cells")
    groups = coarse_groups(kept_counts, kept_cells, n_pcs)
    profile = cut(ambient.ambient_profile(kept_counts), "profile")
    rho = cut(ambient.contamination(kept_counts, groups, profile, *rho_range), "rho")
    corrected = cut(qc.filter_genes(ambient.remove_ambient(kept_counts, groups, profile, rho), min_cells), "corrected")
    calls = cut(doublets.doublets(corrected, n_pcs=n_pcs), "calls")
    single = cut(corrected.join(calls.where("class = 1").select("cell_id"), "cell_id", "left_semi"), "single")
    log = normalize.shifted_log(single).withColumn("layer", F.lit("log1p_norm"))
    sizes = size_factors.pooled_size_factors(single, groups)
    pooled = normalize.apply_size_factors(single, sizes).withColumn("layer", F.lit("pooled_norm"))
    raw = single.select("cell_id", "gene", F.col("n").alias("value")).withColumn("layer", F.lit("counts"))
    return stages.write_stage(root, "clean", {
        "expr": raw.unionByName(log).unionByName(pooled),
        "cells": kept_cells.join(calls.drop("sample"), "cell_id"),
        "contamination": rho,
    })


def coarse_groups(counts: DataFrame, cells: DataFrame, n_pcs: int = 15, n_genes: int = 2000) -> DataFrame:
    """Quick groups ``cell_id, group``: log layer, components, communities."""
    rows, width = _rows(normalize.shifted_log(counts), counts, cells, n_genes)
    scores = linalg.pca(rows, width, min(n_pcs, width), tol=1e-3).scores
    found = cluster.knn_clusters(cut(scores, "scores"), 15)
    return cut(found.select("cell_id", F.col("cluster").alias("group")), "groups")


def _rows(expr: DataFrame, counts: DataFrame, cells: DataFrame, n_genes: int) -> tuple[DataFrame, int]:
    top = features.binomial_deviance(counts).orderBy(F.desc("binomial_deviance"), "gene").limit(n_genes)
    index = cut(gene_index(top), "index")
    return cut(cell_vectors(expr, index, cells=cells), "rows"), index.count()


def integrate(
    spark, root: str, layer: str = "pooled_norm", n_genes: int = 10_000, n_comps: int = 50,
    k: int = 15, n_pcs: int = 40, resolutions: Sequence[float] = (0.25, 0.5, 0.7, 1.0, 2.0), epochs: int = 30,
    batch: str = "sample",
) -> DataFrame:
    """Batch correction of one layer of stage ``clean`` with embeddings before
    and after and a resolution scan; writes stage ``integrated`` and returns
    ``resolution, silhouette, n_clusters, best``."""
    expr = stages.read_layer(spark, root, "clean", layer)
    cells = stages.read_stage(spark, root, "clean", "cells")
    index = cut(gene_index(features.top_genes_by_mean(expr, cells, n_genes)), "index")
    width = index.count()
    before = cut(cell_vectors(expr, index, cells=cells), "before")
    after = cut(combat(expr, cells, index, batch), "after")
    made, scores = {}, None
    for name, rows, centre in (("before", before, False), ("after", after, True)):
        fit = linalg.pca if centre else linalg.truncated_svd
        scores = cut(fit(rows, width, min(n_comps, width)).scores, f"pca_{name}")
        graph = cut(neighbors.connectivities(cut(neighbors.knn(scores, k, n_pcs), "knn")), "graph")
        made[f"pca_{name}"], made[f"graph_{name}"] = scores, graph
        if epochs:
            made[f"layout_{name}"] = layout(graph, scores, epochs)
    found, table = cluster.resolution_scan(made["graph_after"], scores, resolutions)
    table = cut(table, "scan")
    stages.write_stage(root, "integrated", {**made, "corrected": after, "clusters": found, "scan": table})
    return table


def contrast(
    cells: DataFrame, embedding: DataFrame, label_map: DataFrame, ref: str = "WT", test: str = "KO",
    exclude: str | None = None, min_cells: int = 200, deny: Sequence[str] = (), dims: int = 50,
    n_perms: int = 999, cap: int | None = None,
) -> dict[str, DataFrame]:
    """Compositional, distributional and axis tests between two conditions on
    annotated cells: tables ``composition``, ``shift`` and ``axis``."""
    kept = cells if exclude is None else labels.exclude(cells, "cluster", exclude)
    kept = cut(labels.apply_labels(labels.filter_samples(kept, min_cells, deny), label_map), "contrast")
    kept = kept.where("cluster_name is not null")
    points = cut(kept.select("cell_id", "cluster_name", "condition").join(embedding, "cell_id"), "points")
    on_axis = linalg.lda_axis(points, dims, ref, test)
    return {
        "composition": composition.compositional_shift(kept, "cluster_name", ref, test),
        "shift": shift.expression_shift(points, "cluster_name", ref, test, n_perms, cap),
        "axis": composition.bh(composition.mann_whitney(on_axis, "cluster_name", "lda_z", ref, test), tie=["cluster_name"]),
    }


def trajectory_tables(
    edges: DataFrame, cells: DataFrame, roots: Sequence[str], n_comps: int = 15, n_dcs: int = 10,
    group: str = "cluster_name",
) -> dict[str, DataFrame]:
    """Diffusion map, pseudotime from the root clusters and the group graph,
    whole and per condition, from directed neighbour edges."""
    graph = cut(neighbors.connectivities(edges), "graph")
    embedding, values = trajectory.diffmap(graph, n_comps)
    embedding = cut(embedding, "diffmap")
    root = trajectory.pick_root(embedding, cells, roots, group)
    return {
        "diffmap": embedding,
        "pseudotime": trajectory.pseudotime(embedding, values, root, n_dcs),
        "paga": trajectory.paga(edges, cells, group),
        "paga_by_condition": trajectory.paga(edges, cells, group, by="condition"),
    }
