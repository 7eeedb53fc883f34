"""Exact top-k inner products by MaxScore over integer vectors.

Dimensions are the terms.  Within a shard of candidates every term keeps its
least and largest component, which bounds what it can add to a query's score.
Terms whose bounds together cannot lift a candidate over the k-th best score
so far are non-essential: the essential ones are summed for the whole shard,
the others are probed in falling order of their bounds, each time only for the
candidates that can still reach the threshold.  The best of each shard are
merged by a window.  Queries meet shards in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD, BLOCK = 4096, 256
#: candidates of a shard that are scored fully to set the first threshold
SEED = 256
#: non-essential terms that are probed at a time
PROBE = 8
#: blocks are probed as a whole until this part of the candidates is left
FEW = 8


def integer_components(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component; null where the vector or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("bigint")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row per vector; shorter ones are filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    for i, part in enumerate(np.split(flat, np.cumsum(sizes)[:-1])):
        out[i, :len(part)] = part
    return out


def _exact_type(queries: np.ndarray, rows: np.ndarray) -> type:
    """The fastest type in which every partial sum is a whole number held exactly."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * 2 * max(1, rows.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def search_shard(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                 ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the query, positions, scores) of the k best rows, ties to smaller ids; rows with the query's id are left out."""
    kind = _exact_type(queries, rows)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    terms = np.ascontiguousarray(rows[order].T.astype(kind))
    queries = queries.astype(kind)
    low, high = (terms.min(1), terms.max(1)) if len(ids) else (terms.sum(1), terms.sum(1))
    ends = np.stack([queries * low, queries * high])
    least, most = ends.min(0), ends.max(0)
    falling = np.argsort(least - most, axis=1, kind="stable")

    def rest(x: np.ndarray) -> np.ndarray:
        """What the terms from each place of the falling order on add together."""
        sums = np.cumsum(np.take_along_axis(x, falling, 1)[:, ::-1], 1)[:, ::-1]
        return np.append(sums, np.zeros((len(sums), 1), sums.dtype), 1)

    least, most = rest(least), rest(most)
    first = queries @ terms[:, :SEED]
    start = np.full(len(queries), -np.inf)
    for number, own in enumerate(query_ids):
        seeded = first[number][ids[:SEED] != own]
        if len(seeded) >= k:
            start[number] = np.partition(seeded, len(seeded) - k)[len(seeded) - k]
    # non-essential: terms that cannot lift a candidate from the least possible score over the threshold
    essential = np.where(start == -np.inf, queries.shape[1], (most - least > (start - least[:, 0])[:, None]).sum(1))
    width, place, threshold = queries.shape[1], np.zeros(len(queries), int), start
    partial = np.zeros((len(queries), len(ids)), kind)
    each, column = np.arange(len(queries)), np.arange(width)
    upto = np.minimum(essential, width)
    foreign = ids != np.asarray(query_ids)[:, None]
    while True:  # essential terms, then probes for all queries of the block while many candidates are left
        inside = (column >= place[:, None]) & (column < upto[:, None])
        chosen = np.zeros_like(queries)
        np.put_along_axis(chosen, falling, np.where(inside, np.take_along_axis(queries, falling, 1), 0), 1)
        partial += chosen @ terms
        place = upto
        alive = (partial >= (threshold - most[each, place])[:, None]) & foreign
        if not len(ids) or place.min(initial=width) == width or np.median(alive.sum(1)) <= len(ids) / FEW:
            break
        upto = np.minimum(place + PROBE, width)
    for number in range(len(queries)):
        q, at, limit = queries[number], int(place[number]), threshold[number]
        rows_left = np.flatnonzero(alive[number])
        got = partial[number, rows_left]
        while at < width:
            probe = falling[number, at:at + PROBE]
            at = min(at + PROBE, width)
            got = got + q[probe] @ terms[probe[:, None], rows_left]
            if len(got) > k:  # the k-th best of what candidates have for certain
                limit = max(limit, np.partition(got, len(got) - k)[len(got) - k] + least[number, at])
            stay = got + most[number, at] >= limit
            rows_left, got = rows_left[stay], got[stay]
        if len(got) > 4 * k:
            stay = got >= np.partition(got, len(got) - k)[len(got) - k]
            rows_left, got = rows_left[stay], got[stay]
        best = np.lexsort((rows_left, -got))[:k]
        yield number, order[rows_left[best]], got[best].astype(np.int64)


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column("held")[i].values
                asked = batch.column("asked")[i].values
                vectors = [held.field("v"), asked.field("v")]
                width = max(pa.compute.max(pa.compute.list_value_length(v)).as_py() or 0 for v in vectors)
                rows, queries = (_matrix(v, width) for v in vectors)
                ids = held.field("id").to_numpy(zero_copy_only=False)
                query_ids = asked.field("id").to_numpy(zero_copy_only=False)
                keys = asked.field("key").to_numpy(zero_copy_only=False)
                found = list(search_shard(ids, rows, query_ids, queries, k))
                n = [len(p) for _, p, _ in found]
                which = np.repeat([number for number, _, _ in found], n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(query_ids[which]), pa.array(keys[which]),
                    pa.array(ids[np.concatenate([p for _, p, _ in found])]),
                    pa.array(np.concatenate([s for _, _, s in found]))], schema=schema)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
          scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows of each query row.

    Rows with a null id or an unusable vector take no part; a shorter vector
    counts as filled with zeros.  Rows that share the query's id are its own.
    Repeated rows are candidates each; a query row that is repeated is asked
    once.  An empty table gives an empty result.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), integer_components(F.col(vector), scale).alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null")
    queries = rows.where("q").select("id", "v", F.xxhash64("v").alias("key")).distinct()
    n_rows, n_queries = rows.count(), queries.count()
    shards, blocks = max(1, -(-n_rows // SHARD)), max(1, -(-n_queries // BLOCK))
    packed = (rows.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)))
              .groupBy("shard").agg(F.collect_list(F.struct("id", "v")).alias("held"))
              .select("shard", "held", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")))
    asked = (queries.withColumn("block", F.pmod(F.xxhash64("id", "key"), F.lit(blocks)).cast("int"))
             .groupBy("block").agg(F.collect_list(F.struct("id", "v", "key")).alias("asked")))
    pairs = packed.join(asked, "block").repartition(max(shards * blocks, 1), "shard", "block")
    found = pairs.select("held", "asked").mapInArrow(
        _search(k), "query_id bigint, query_key bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
