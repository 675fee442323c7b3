"""Global ranks, quantile groups, batches and vector search without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import l2_norm
from ..session import written


def _placed(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with row numbers and, as ``_total``, the number of rows."""
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, (own + F.col("_before")).cast("long")).drop("_range", "_before")


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Row numbers over the whole table.

    Rows are dealt by ranges of ``order``, numbered inside each range, and shifted
    by the sizes of the ranges before; only those sizes (one for each partition)
    meet in one task.  ``order`` must be total for a repeatable result.
    """
    return _placed(df, order, name).drop("_total")


def global_ntile(df: DataFrame, n: int, order: Sequence[Column], name: str) -> DataFrame:
    """``ntile(n)`` over the whole table: the first ``rows % n`` groups get one row more."""
    small, rest = F.floor(F.col("_total") / n), F.col("_total") % n
    at = F.col("_position") - 1
    tile = F.when(at < rest * (small + 1), F.floor(at / (small + 1))).otherwise(rest + F.floor((at - rest * (small + 1)) / F.greatest(small, F.lit(1)))) + 1
    return _placed(df, order, "_position").withColumn(name, tile.cast("long")).drop("_position", "_total")


#: Queries and vectors of a block.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 16_384
#: Products that are added up at a time, so that they stay in a processor's cache.
TILE = 512


def _nearest(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scores by row and id the ``k`` highest of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    near = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[near], ids[near], scores[near]


def _block_topk(v: pa.Table, q: pa.Table, k: int) -> pa.Table:
    """The ``k`` most similar vectors of a block for each query of a block, ties to the smaller id.

    Products are added in the order of the components, so equal vectors have equal scores wherever they are.  Of the scores only
    a tile and the best so far are held.
    """

    def side(t: pa.Table) -> np.ndarray:
        x = t.column("x").combine_chunks()
        if len(x) and (np.diff(x.offsets.to_numpy()) != len(x[0])).any():
            raise ValueError("vectors are of different sizes")
        return x.flatten().to_numpy().reshape(len(x), -1) if len(x) else np.zeros((0, 0))

    vectors, queries = side(v), side(q)
    ids, norms = v.column("vec_id").to_numpy(), v.column("norm").to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), TILE):
        some, own, names = (x[at : at + TILE] for x in (queries, q.column("norm").to_numpy(), q.column("query_id").to_numpy()))
        least = np.full(len(some), -np.inf)  # a row's k-th best so far
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for low in range(0, len(vectors), TILE):
            block, there = vectors[low : low + TILE], ids[low : low + TILE]
            total = np.zeros((len(some), len(block)))
            for d in range(block.shape[1]):
                total += np.multiply.outer(some[:, d], block[:, d])
            total /= np.multiply.outer(own, norms[low : low + TILE])
            total[(there == names[:, None]) | ~np.isfinite(total)] = -np.inf
            if len(block) > k:
                least = np.maximum(least, np.partition(total, len(block) - k, axis=1)[:, len(block) - k])
            row, col = np.nonzero((total >= least[:, None]) & np.isfinite(total))
            best = _nearest(*map(np.concatenate, zip(best, (row, there[col], total[row, col]))), k)
        out.append((names[best[0]], best[1], best[2]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str, vector_col: str) -> DataFrame:
    """The ``k`` most similar other vectors of each query, by cosine, ties to the smaller id; vectors are of one size.

    Queries and vectors are dealt in bounded blocks by a hash of their ids, and each block of one meets each of the other in a
    group of its own, where all products of the two are taken as arrays.  A group keeps k vectors for each query, and groups'
    answers are merged by rank; nothing is broadcast.  Vectors that are null or zero take no part.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        x = F.col(vector_col).cast("array<double>")
        rows = df.select(F.col(id_col).cast("long").alias(name), x.alias("x"), l2_norm(F.col(vector_col)).alias("norm"))
        return rows.where(F.col("x").isNotNull() & ~F.exists("x", lambda e: e.isNull()) & (F.col("norm") > 0))

    q, v = side(queries, "query_id"), side(vectors, "vec_id")
    across, down = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-vectors.count() // VECTOR_BLOCK))
    block = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = q.withColumn("_across", block("query_id", across)).withColumn("_down", every(down))
    v = v.withColumn("_down", block("vec_id", down)).withColumn("_across", every(across))
    names = ("_across", "_down")
    scored = v.groupBy(*names).cogroup(q.groupBy(*names)).applyInArrow(lambda a, b: _block_topk(a, b, k), "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", best.cast("long")).where(F.col("rank") <= k)


def batched(df: DataFrame, size: int, group: str, order: str, name: str = "batch") -> DataFrame:
    """``df`` with the number, from 0, of each row's batch of ``size`` inside its group; a group of any size is numbered by ranges."""
    placed = global_row_number(df, [F.asc(group), F.asc(order)], "_place")
    first = placed.groupBy(group).agg(F.min("_place").alias("_first"))
    joined = placed.join(first, placed[group].eqNullSafe(first[group])).drop(first[group])
    return joined.withColumn(name, F.floor((F.col("_place") - F.col("_first")) / size)).drop("_place", "_first")
