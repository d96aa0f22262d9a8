"""Exact top-k search by tiled matrix products.

Queries are dealt to tiles and all vectors to shards, both of bounded size, by hash. Each cell (tile, shard) is one task's
matrix product, in blocks of queries, with a partial selection of the best ``k`` for each query; the lists of a query are then
merged in a tree, ``FAN_IN`` shards at a time.

Defined results: vectors that are null or hold a null, NaN or infinity take no part; of rows with equal vec_id and vector one
takes part; a query's own rows (its vec_id) are no candidates; ties go to the smaller vec_id; null vec_ids take no part; a shorter
vector counts as filled with zeros; a score outside 64 bits is given as the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stored

TILE, SHARD, BLOCK = 8192, 16384, 256
FAN_IN = 32
SCALE = 256


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of the components of the vectors that take part."""
    x = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))

    def whole(c):
        y = F.lit(float(scale)) * c
        return F.when(F.abs(y) < 2.0 ** 53, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    v = F.transform("e", whole)
    return x.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & fine).select("vec_id", v.alias("v")).distinct()


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where all sums are exact there, else in whole numbers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if most < 2.0 ** 53:
        return (q @ c.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (q, c)]
    return np.clip(whole[0] @ whole[1].T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _cell(k: int):
    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("v").combine_chunks().value_lengths()
        width = max([0, *lengths.to_pylist()])
        ids, side = table.column("vec_id").to_numpy(), table.column("query").to_numpy(zero_copy_only=False)
        every = _matrix(table.column("v"), width)
        queries, names = every[side], ids[side]
        order = np.argsort(ids[~side], kind="stable")
        candidates, known = every[~side][order], ids[~side][order]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(queries) if len(known) else 0, BLOCK):
            got = scores(queries[at:at + BLOCK], candidates)
            name = names[at:at + BLOCK]
            for i, row in enumerate(got):
                fit = np.flatnonzero(known != name[i])
                row = row[fit]
                if len(row) > k:
                    bound = np.partition(row, len(row) - k)[len(row) - k]
                    some = np.flatnonzero(row >= bound)
                    some = some[np.lexsort((known[fit[some]], ~row[some]))][:k]
                else:
                    some = np.arange(len(row))
                out.append((np.full(len(some), name[i]), known[fit[some]], row[some]))
        parts = [np.concatenate(p) if out else np.empty(0, np.int64) for p in zip(*out)] or [np.empty(0, np.int64)] * 3
        shard = table.column("shard")[0].as_py()
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "shard": pa.array([shard] * len(parts[0]), pa.int32()),
                         "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.int64())})
    return run


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors``: vec_id, v (array of whole doubles); ``is_query``: a condition on it."""
    vectors = stored(vectors, "vectors")
    n, queries = vectors.count(), vectors.filter(is_query)
    shards, tiles = 1 + (n - 1) // SHARD if n else 1, 1 + max(queries.count() - 1, 0) // TILE
    tile, shard = F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int"), F.pmod(F.xxhash64("v", "vec_id"), F.lit(shards)).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    left = queries.select(tile.alias("tile"), every(shards).alias("shard"), F.lit(True).alias("query"), "vec_id", "v")
    right = vectors.select(every(tiles).alias("tile"), shard.alias("shard"), F.lit(False).alias("query"), "vec_id", "v")
    lists = left.union(right).groupBy("tile", "shard").applyInArrow(
        _cell(k), "query_id long, shard int, vec_id long, score long")
    while True:
        by = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        last = shards <= FAN_IN
        lists = lists.withColumn("shard", F.lit(0) if last else F.floor(F.col("shard") / FAN_IN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        if last:
            return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        shards = 1 + (shards - 1) // FAN_IN


# The same in DuckDB for vec_ids divisible by 50.
SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
