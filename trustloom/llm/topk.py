"""Exact top-k inner products by columnar branch and bound.

Vectors become whole numbers. A tile is a block of candidates and a block of queries. In the tile, candidates lie in vertical
layout: one array per dimension, dimensions with the most mass first. A query's scores grow block by block of dimensions;
after each block a candidate stays only if its score so far plus the largest that the remaining dimensions can add, the
product of both remaining lengths, reaches the query's limit. Survivors are compacted, and only they get the next block.

The limit of a query is the k-th best of candidates already scored: first a bounded seed that all queries meet, then the
tile's own chunks. Limits only ever leave out candidates that k others beat, so the result is exact. Work grows with queries
times candidates, which the question itself does; rows copied grow with rows times tiles a row is part of, and a tile gives back
at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trustloom.llm.common import dropped, stored, width

SEEDS = 4096  # candidates that give every query its first limit
ROWS, QUERIES = 1 << 16, 1 << 13  # most candidates and queries of a tile
CHUNK, GROUP, DIMENSIONS = 1 << 13, 256, 8  # candidates and queries scored at once, dimensions in a block
DENSE = 0.3  # share of survivors below which they are compacted
EXACT = 1 << 53  # whole numbers up to here are exact in doubles


def whole(vector: Column, scale: float) -> Column:
    """``floor(scale * x)`` of every component as ``array<long>``; null if the vector or a component is null or not finite."""
    xs = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(xs, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(xs, lambda x: F.floor(x * scale)))


def _matrix(lists: pa.Array, order: np.ndarray) -> np.ndarray:
    """Rows by dimensions in the given order; missing dimensions are 0."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), len(order)), np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lists)), lengths), at] = values
    return out[:, order]


def _lengths(x: np.ndarray) -> np.ndarray:
    """Length of the rest of each row (dimension first) from each block on, rounded up a little, so that bounds stay bounds."""
    squares = np.square(x.astype(np.float64))
    tails = [np.sqrt(squares[d:].sum(axis=0)) for d in range(0, len(x), DIMENSIONS)]
    return np.stack([*(tails or [np.zeros(x.shape[1])]), np.zeros(x.shape[1])]) * (1 + 1e-12)


def _exactly(q: np.ndarray, x: np.ndarray) -> type:
    """Doubles where every score is exact in them, else 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, len(x))
    return np.float64 if most < EXACT else np.int64


class Best:
    """The k best of each query so far: scores descending, ties to the smaller id."""

    def __init__(self, limits: np.ndarray, k: int):
        n = len(limits)
        self.limits, self.k, self.found = limits, k, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray):
        if not len(scores):
            return
        scores, ids = np.concatenate([self.found[i][0], scores]), np.concatenate([self.found[i][1], ids])
        if len(scores) > 4 * self.k:  # all of the k-th score and better, before the sort
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= edge], ids[scores >= edge]
        order = np.lexsort((ids, ~scores))[:self.k]  # ~ turns the order round without overflow
        self.found[i] = scores[order], ids[order]
        if len(order) == self.k:
            self.limits[i] = max(self.limits[i], float(scores[order[-1]]))


def search(q: np.ndarray, q_row: np.ndarray, limits: np.ndarray, x: np.ndarray, x_row: np.ndarray, x_id: np.ndarray, k: int) -> Best:
    """The k best candidates ``x`` (rows by dimensions) of each query, a query's own row left out.

    ``limits``: scores below which a candidate of the query can't matter.
    """
    best, vertical = Best(limits.copy(), k), np.ascontiguousarray(x.T)
    kind = _exactly(q, vertical)
    vertical, queries = vertical.astype(kind), q.astype(kind)
    rest, q_rest = _lengths(vertical), _lengths(q.T)
    # integers beyond doubles are rounded when they meet a bound
    slack = 0.0 if kind is np.float64 or not len(x) else 1e-12 * q_rest[0] * rest[0].max()
    slack = np.broadcast_to(slack, len(q))
    for start in range(0, x.shape[0], CHUNK):
        part = slice(start, start + CHUNK)
        block, tails, rows, ids = vertical[:, part], rest[:, part], x_row[part], x_id[part]
        for first in range(0, len(q), GROUP):
            group = slice(first, first + GROUP)
            # blocks for all queries of the group at once while most candidates survive, then each query with its survivors
            scores, limit = np.zeros((len(queries[group]), block.shape[1]), kind), (best.limits - slack)[group][:, None]
            for done, d in enumerate(range(0, max(1, len(block)), DIMENSIONS), 1):
                scores += queries[group, d:d + DIMENSIONS] @ block[d:d + DIMENSIONS]
                alive = scores + q_rest[done, group][:, None] * tails[done] >= limit
                if alive.mean() < DENSE:
                    break
            alive &= q_row[group][:, None] != rows
            for i in np.flatnonzero(alive.any(axis=1)):
                j, at = first + int(i), np.flatnonzero(alive[i])
                mine = scores[i, at]
                for b in range(done, len(tails) - 1):
                    d = b * DIMENSIONS
                    mine = mine + queries[j, d:d + DIMENSIONS] @ block[d:d + DIMENSIONS, at]
                    stay = mine + q_rest[b + 1, j] * tails[b + 1, at] >= best.limits[j] - slack[j]
                    if not stay.all():
                        at, mine = at[stay], mine[stay]
                best.add(j, mine.astype(np.int64), ids[at])
    return best


def _empty():
    return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, ["q_row", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", *,
          scale: float = 64.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query row the ``k`` other rows with the largest inner products (all, if fewer).

    Components are ``floor(scale * x)``; the inner product is that of whole numbers (64 bits: larger scores wrap, components
    beyond 64 bits take the nearest). Ties go to the smaller id. Rows whose id or vector is null, or whose vector holds a null or
    a non-finite component, take no part. Shorter vectors count as filled up with zeros, an empty one is a zero vector. Rows
    that repeat an id are rows of their own: each is a query, and the others are its candidates. No queries or an empty table
    give no rows; other columns may have any names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("asks"), whole(F.col(vector_col), scale).alias("v"))
    rows = stored(rows.where("id IS NOT NULL AND v IS NOT NULL").withColumns({
        "row": F.monotonically_increasing_id(), "asks": F.coalesce("asks", F.lit(False))}), "vectors")
    mass = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("m"))
    mass = {r.d: r.m for r in mass.collect()}  # one number a dimension
    order = np.array(sorted(mass, key=lambda d: (-mass[d], d)), np.int64)
    n, asked = rows.count(), rows.where("asks").count()
    # tiles: enough of them for the cluster, none larger than its bounds
    tiles = 3 * width(spark)
    blocks = max(1, -(-n // ROWS), min(tiles, -(-n // 1024)))
    sides = max(1, -(-asked // QUERIES))
    spread = lambda m, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(m)).cast("int")

    seeds = rows.orderBy(F.xxhash64("row", F.lit(42)), "row").limit(SEEDS).toArrow()  # bounded by SEEDS rows
    seed = (_matrix(seeds["v"], order), seeds["row"].to_numpy(), seeds["id"].to_numpy())

    def limited(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            q, row = _matrix(batch.column(2), order), batch.column(0).to_numpy()
            best = search(q, row, np.full(len(q), -np.inf), seed[0], seed[1], seed[2], k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.limits)], ["row", "id", "v", "limit"])

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_batches([_empty()])
        row, ids = left["row"].to_numpy(), left["id"].to_numpy()
        best = search(_matrix(left["v"], order), row, left["limit"].to_numpy(), _matrix(right["v"], order), right["row"].to_numpy(),
                      right["id"].to_numpy(), k)
        many = [len(s) for s, _ in best.found]
        return pa.table({"q_row": np.repeat(row, many), "query_id": np.repeat(ids, many),
                         "vec_id": np.concatenate([i for _, i in best.found]).astype(np.int64),
                         "score": np.concatenate([s for s, _ in best.found]).astype(np.int64)})

    asking = rows.where("asks").select("row", "id", "v").repartition(max(2, width(spark)), "row").mapInArrow(
        limited, "row long, id long, v array<long>, limit double")
    asking = stored(asking, "limits")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asking.withColumns({"side": spread(sides, 1)}).withColumn("block", every(blocks))
    right = rows.select("row", "id", "v", spread(blocks, 2).alias("block")).withColumn("side", every(sides))
    found = left.groupBy("block", "side").cogroup(right.groupBy("block", "side")).applyInArrow(
        lambda a, b: tile(a, b), "q_row long, query_id long, vec_id long, score long")
    found = stored(found, "found")
    rank = F.row_number().over(W.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id"))
    out = stored(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top")
    dropped(rows, asking, found)
    return out
