"""Doublet scores from artificial doublets."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions.order import average_ranks
from stipple.operators.features import top_genes_by_mean
from stipple.operators.linalg import pca
from stipple.operators.neighbors import knn
from stipple.operators.normalize import shifted_log
from stipple.operators.vectors import cell_vectors, gene_index
from stipple.session import cut

#: cells that may be paired with each other; keeps the pairing window small
PAIRING_BUCKET = 256
#: expected share of doublets per thousand cells of a sample
RATE_PER_THOUSAND = 0.01


def artificial_doublets(counts: DataFrame, seed: int = 123) -> DataFrame:
    """One summed pair of cells of the same sample per cell: ``sample,
    cell_id, gene, n``.

    Cells fall into hash buckets of bounded size and each is paired with its
    successor there, so pairing never sorts a whole sample.
    """
    cells = cut(counts.groupBy("sample", "cell_id").agg(F.count(F.lit(1)).alias("g")).select("sample", "cell_id"), "cells")
    sizes = cells.groupBy("sample").agg(F.ceil(F.count(F.lit(1)) / PAIRING_BUCKET).alias("_nb"))
    put = cells.join(sizes, "sample").withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "cell_id"), F.col("_nb")))
    inside = Window.partitionBy("sample", "b")
    order = inside.orderBy(F.xxhash64(F.lit(seed + 1), "cell_id"), "cell_id")
    nxt = F.coalesce(F.lead("cell_id").over(order), F.first("cell_id").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pairs = put.select("cell_id", nxt.alias("other")).where("cell_id <> other")
    name = F.concat(F.lit("doublet-"), F.col("cell_id"))
    members = pairs.select(F.explode(F.array("cell_id", "other")).alias("member"), name.alias("pair"))
    return counts.join(members, counts["cell_id"] == members["member"]).groupBy(
        "sample", F.col("pair").alias("cell_id"), "gene").agg(F.sum("n").alias("n"))


def doublets(
    counts: DataFrame, seed: int = 123, k: int = 20, n_pcs: int = 20, n_genes: int = 1000,
    rate: float | None = None,
) -> DataFrame:
    """``sample, cell_id, neighbour_share, score, class`` (1 singlet, 2 doublet).

    Real and artificial cells share one neighbour graph; boosted trees then
    separate them by neighbour and size features, and a sample's highest
    scores up to the expected rate are called doublets.
    """
    real = cut(counts.select("sample", "cell_id", "gene", "n"), "real")
    both = cut(real.unionByName(artificial_doublets(real, seed)), "both")
    stats = cut(both.groupBy("sample", "cell_id").agg(
        F.log1p(F.sum("n")).alias("size"), F.log1p(F.count(F.lit(1)).cast("double")).alias("detected")
    ).withColumn("label", F.col("cell_id").startswith("doublet-").cast("double")), "stats")
    layer = cut(shifted_log(both), "layer")
    index = cut(gene_index(top_genes_by_mean(layer, stats, n_genes)), "index")
    rows = cut(cell_vectors(layer, index, cells=stats), "rows")
    width = index.count()
    scores = pca(rows, width, min(n_pcs, width), seed, tol=1e-4).scores
    edges = cut(knn(scores, min(k + 1, stats.count())), "knn")
    fake = stats.select(F.col("cell_id").alias("dst"), F.col("label").alias("fake"))
    near = edges.join(fake, "dst").groupBy(F.col("src").alias("cell_id")).agg(
        F.avg("fake").alias("neighbour_share"),
        F.sum(F.col("fake") / (1e-6 + F.col("dist"))).alias("_f"), F.sum(1.0 / (1e-6 + F.col("dist"))).alias("_a"),
        F.avg("dist").alias("mean_dist"),
    ).withColumn("weighted_share", F.col("_f") / F.col("_a")).drop("_f", "_a")
    inputs = ["neighbour_share", "weighted_share", "mean_dist", "size", "detected"]
    frame = cut(stats.join(near, "cell_id").select("sample", "cell_id", "label", *inputs), "frame")
    ready = VectorAssembler(inputCols=inputs, outputCol="features").transform(frame)
    model = GBTClassifier(maxIter=10, maxDepth=3, seed=seed).fit(ready)
    scored = model.transform(ready).where("label = 0").select(
        "sample", "cell_id", "neighbour_share", vector_to_array("probability")[1].alias("score"))
    scored = cut(scored, "scored")
    n = scored.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(0.5), F.lit(RATE_PER_THOUSAND) * F.col("n") / 1000) if rate is None else F.lit(float(rate))
    order = average_rank_from_top(scored)
    return order.join(n, "sample").withColumn(
        "class", F.when(F.col("from_top") <= F.ceil(share * F.col("n")), 2).otherwise(1)
    ).drop("from_top", "n")


def average_rank_from_top(scored: DataFrame) -> DataFrame:
    """Position of every score in its sample, largest first, ties sharing."""
    ranks = average_ranks(scored.select("sample", "score"), ["sample"], "score")
    top = ranks.select("sample", "score", (F.col("group_n") - F.col("rank") + 1).alias("from_top"))
    return scored.join(top, ["sample", "score"])
