"""Operator 7, exact top-k search by tiled matrix products.

Vectors are scaled and rounded down to integers. Candidates are dealt into shards and queries into
blocks; a task multiplies one block by one shard, tile by tile, keeps each query's best by partial
selection, and the short lists are merged up a tree. Every query meets every shard, so the result
is exact; a shard and a block have a bounded number of rows whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

SHARD_ROWS = 1 << 14
BLOCK_ROWS = 1 << 12
_TILE = 1 << 11
_FAN_IN = 16
_LONG = 2**63 - 1


def finite(vector: Column) -> Column:
    """The vector as doubles; null if it is null or a component is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.when(vector.isNotNull() & good, vector.cast("array<double>"))


def _multiply(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles, longs or Python's integers (held to long's range)."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    big = np.array([[int(x) for x in row] for row in q], object).reshape(q.shape) @ np.array([[int(x) for x in row] for row in c], object).reshape(c.shape).T
    return np.clip(big, -_LONG - 1, _LONG).astype(np.int64)


def _best(q_row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query: higher scores first, then smaller ids."""
    order = np.lexsort((ids, ~scores, q_row))
    q_row, ids, scores = q_row[order], ids[order], scores[order]
    first = np.flatnonzero(np.append(True, q_row[1:] != q_row[:-1])) if len(q_row) else np.empty(0, np.int64)
    rank = np.arange(len(q_row)) - np.repeat(first, np.diff(np.append(first, len(q_row))))
    keep = rank < k
    return q_row[keep], ids[keep], scores[keep]


def _vectors(column: pa.ChunkedArray, scale: int) -> list[np.ndarray]:
    lists = column.combine_chunks()
    values = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
    return np.split(values, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def _cell(k: int, scale: int):
    def run(table: pa.Table) -> pa.Table:
        is_query = np.array(table.column("query").to_pylist(), bool)
        ids = np.array(table.column("id").to_pylist(), np.int64)
        vectors = _vectors(table.column("v"), scale)
        widths = np.array([len(v) for v in vectors])
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        queries = np.flatnonzero(is_query)
        for width in np.unique(widths[queries]).tolist():  # vectors of different lengths have no product
            q_at = queries[widths[queries] == width]
            c_at = np.flatnonzero(~is_query & (widths == width))
            if not len(c_at):
                continue
            q = np.array([vectors[x] for x in q_at], np.float64).reshape(len(q_at), width)
            for at in range(0, len(c_at), _TILE):
                tile = c_at[at : at + _TILE]
                c = np.array([vectors[x] for x in tile], np.float64).reshape(len(tile), width)
                for qa in range(0, len(q_at), _TILE):
                    part = q_at[qa : qa + _TILE]
                    scores = _multiply(q[qa : qa + _TILE], c)
                    own = ids[part][:, None] == ids[tile][None, :]
                    n = min(k + 1, len(tile)) if own.any() else min(k, len(tile))
                    masked = np.where(own, np.iinfo(np.int64).min, scores)
                    cut = np.partition(masked, len(tile) - n, axis=1)[:, len(tile) - n]
                    row, col = np.nonzero((masked >= cut[:, None]) & ~own)  # ties of the last place included
                    held.append(_best(part[row], ids[tile][col], scores[row, col], k))
        if not held:
            return _EMPTY
        row, found, scores = _best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
        return pa.table([pa.array(np.full(len(row), table.column("shard")[0].as_py()), pa.int32()), pa.array(ids[row]), pa.array(found), pa.array(scores)], _NAMES)

    return run


_NAMES = ["shard", "query_id", "id", "score"]
_EMPTY = pa.table([pa.array([], pa.int32()), *[pa.array([], pa.int64())] * 3], _NAMES)


def top_k(df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score): each query's k highest integer inner products, ties to smaller ids.

    ``queries`` is a condition on the rows: those are searched for, against every other row. A
    vector that is null, or holds a null or non-finite component, takes no part, nor does a row
    without an id; vectors of different lengths are not compared. Rows that share an id are
    candidates of their own, but not for that id's query; a repeated query row searches once. A score
    beyond a long is held at long's range. An empty table gives an empty result.
    """
    v = finite(F.col(f"`{vector_col}`"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("query")).filter("id IS NOT NULL AND v IS NOT NULL")
    n, n_queries = rows.agg(F.count("*"), F.count_if("query")).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // BLOCK_ROWS))
    asked = rows.filter("query").groupBy("id").agg(F.min("v").alias("v"))
    place = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.select(every(shards).alias("shard"), place(blocks).alias("block"), F.lit(True).alias("query"), "id", "v")
    right = rows.select(place(shards).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("query"), "id", "v")
    lists = left.union(right).groupBy("shard", "block").applyInArrow(_cell(k, scale), "shard int, query_id long, id long, score long")
    while True:  # one level of the merge tree
        shards = -(-shards // _FAN_IN)
        lists = _merged(lists.withColumn("shard", F.floor(F.col("shard") / _FAN_IN).cast("int")), k)
        if shards == 1:
            break
    return lists.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _merged(lists: DataFrame, k: int) -> DataFrame:
    entry = F.struct(F.col("score").alias("score"), F.bitwise_not(F.col("id")).alias("later"))
    best = F.slice(F.sort_array(F.collect_list(entry), asc=False), 1, k)
    out = lists.groupBy("query_id", "shard").agg(best.alias("best"))
    out = out.select("query_id", "shard", F.posexplode("best").alias("at", "x"))
    return out.select("query_id", "shard", (F.col("at") + 1).cast("int").alias("rank"), F.bitwise_not(F.col("x.later")).alias("id"), F.col("x.score").alias("score"))
