"""Exact top-k search by inner product: a Voronoi kNN join.

Queries are grouped by the nearest of a few pivots.  A group is summed up by its
radius around the pivot, its largest norm, and the least score that its queries
are sure to reach: each query's k-th best in a bounded sample of the data.  For a
vector x and a group of pivot p, radius R and largest norm Q, no query's score
exceeds ``p.x + R |x|`` nor ``(Q**2 + |x|**2 - max(0, |p - x| - R)**2) / 2``; x goes to the
groups for which both reach that least score, and to no other.  Groups are solved
locally, in blocks of queries and of data, and the blocks' best are merged.

More groups have tighter bounds but each takes a copy of what it needs, so
``grouping`` measures on samples of queries and data what share of the data is kept
by how many groups, and takes the number that moves least.  Where bounds prune
nothing (many dimensions, no clusters), that is one group, and a vector is copied
once for every ``block_queries`` queries.  The choice changes what is moved, never
the result.

Components are scaled and floored to integers first; scores are exact integers.

Edge cases: vectors null, empty, of another dimension, or with a null or
non-finite component take no part, nor do null ids; zero vectors do; equal scores
go to the smaller id; queries repeated with one id count once, candidates repeated
count each; a query is never its own neighbour; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import kth_best, matrix, one_row_each, ranked, sample_of, valid_rows

MAX_GROUPS = 1024
#: Queries and data rows on which a grouping is measured.
MEASURED = 2048


@dataclass(frozen=True)
class Params:
    k: int = 5
    scale: float = 256.0
    #: Groups of queries; by default as many as move least.
    groups: int | None = None
    block_queries: int = 4096
    block_rows: int = 8192
    seed: int = 9


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def _without_self(ids: np.ndarray, x: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Inner products with a sample, minus infinity where it is the same row."""
    scores = x @ sample.T
    scores[ids[:, None] == sample_ids[None, :]] = -np.inf
    return scores


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors; one that needs more than 64 bits is refused."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda a: np.array([[int(v) for v in row] for row in a.tolist()], dtype=object)
    exact = whole(q) @ whole(x).T
    if exact.size and (exact.max() >= 2**63 or exact.min() <= -(2**63)):
        raise ValueError("a score needs more than 64 bits")
    return exact.astype(np.int64)


def _limits(x: np.ndarray, centre: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What no score of a row of ``x`` with a query of each group exceeds (rows x groups)."""
    length = np.sqrt((x * x).sum(axis=1))[:, None]
    limit = np.minimum(x @ centre.T + radius * length, (norm**2 + length**2 - np.maximum(0, _distance(x, centre) - radius) ** 2) / 2)
    return limit + 1e-6 * (1 + np.abs(limit))


def grouping(queries: np.ndarray, sample: np.ndarray, sure: np.ndarray, asked: int, p: Params) -> tuple[np.ndarray, float]:
    """Pivots for ``asked`` queries, and the share of the data that a group is seen to keep; ``sure`` is of ``queries``."""
    order, best = np.random.default_rng(p.seed).permutation(len(queries)), None
    norms = np.sqrt((queries * queries).sum(axis=1))
    most = min(MAX_GROUPS, len(queries))
    for n in [min(p.groups, most)] if p.groups else [1 << b for b in range(most.bit_length())]:
        pivots = queries[order[:n]]
        away = _distance(queries, pivots)
        own = away.argmin(axis=1)
        radius, norm, least = np.zeros(n), np.zeros(n), np.full(n, np.inf)
        np.maximum.at(radius, own, away[np.arange(len(own)), own])
        np.maximum.at(norm, own, norms)
        np.minimum.at(least, own, sure)
        kept = float((_limits(sample, pivots, radius, norm) >= least).mean())
        moved = n * kept * max(1, -(-asked // (n * p.block_queries)))
        if best is None or moved < best[0]:
            best = moved, pivots, kept
    return best[1], best[2]


def search(table: DataFrame, is_query: Column, params: Params | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows for which ``is_query`` (over ``vec_id``) holds."""
    p = params or Params()
    spark = table.sparkSession
    rows, total, _ = valid_rows(table, id_col, vector_col, zero=True)
    whole = lambda x: F.when(F.abs(x * F.lit(p.scale)) < F.lit(2.0**63), F.floor(x * F.lit(p.scale)).cast("double")).otherwise(F.raise_error(F.lit("a component needs more than 64 bits")).cast("double"))
    rows = rows.select("vec_id", F.transform("vector", whole).alias("vector"))
    queries = materialize(one_row_each(rows.where(is_query)), "queries") if total else rows
    asked = queries.count() if total else 0
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample_ids, sample = sample_of(rows, total)
    some_ids, some = sample_of(queries, asked, MEASURED)
    some_ids, some = some_ids[:MEASURED], some[:MEASURED]
    pivots, _ = grouping(some, sample[:: -(-len(sample) // MEASURED)], kth_best(_without_self(some_ids, some, sample_ids, sample), p.k), asked, p)
    shared = spark.sparkContext.broadcast((pivots, sample_ids, sample))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, sample_ids, sample = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, x = part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(1))
                scores = _without_self(ids, x, sample_ids, sample)
                away = _distance(x, pivots)
                own = away.argmin(axis=1)
                arrays = [pa.array(own.astype(np.int32)), pa.array(away[np.arange(len(ids)), own]), pa.array(np.sqrt((x * x).sum(axis=1))), pa.array(kth_best(scores, p.k))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["vec_id", "vector", "cell", "away", "norm", "sure"])

    cells = materialize(queries.mapInArrow(grouped, "vec_id long, vector array<double>, cell int, away double, norm double, sure double"), "query-cells")
    summary = cells.groupBy("cell").agg(F.max("away").alias("radius"), F.max("norm").alias("norm"), F.min("sure").alias("sure"), F.count("*").alias("n")).orderBy("cell").toPandas()
    bounds = spark.sparkContext.broadcast((summary["cell"].to_numpy(), summary["radius"].to_numpy(), summary["norm"].to_numpy(), summary["sure"].to_numpy()))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value[0]
        cell, radius, norm, sure = bounds.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                i, g = np.nonzero(_limits(matrix(part.column(1)), pivots[cell], radius, norm) >= sure)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(cell[g].astype(np.int32))], names=["vec_id", "vector", "cell"])

    parts = {int(c): -(-int(n) // p.block_queries) for c, n in zip(summary["cell"], summary["n"])}
    n_parts = F.element_at(F.array(*[F.lit(parts.get(c, 1)) for c in range(len(pivots))]), F.col("cell") + 1)
    blocks = -(-total // p.block_rows)
    left = rows.mapInArrow(needed, "vec_id long, vector array<double>, cell int")
    left = left.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    right = cells.select("vec_id", "vector", "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), n_parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def local(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        left = left.sort_values("vec_id")
        names, asking = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        q, x, out = np.stack(right["vector"].to_numpy()), np.stack(left["vector"].to_numpy()), []
        for at in range(0, len(q), 128):
            scores, some = _products(q[at : at + 128], x), asking[at : at + 128]
            low = np.iinfo(np.int64).min
            scores[some[:, None] == names[None, :]] = low
            end = np.partition(scores, max(0, len(names) - p.k), axis=1)[:, max(0, len(names) - p.k)] if len(names) > p.k else np.full(len(some), low)
            i, j = np.nonzero((scores >= end[:, None]) & (scores > low))  # ties at the end stay until they are ordered
            i, j = (c[np.lexsort((names[j], -scores[i, j], i))] for c in (i, j))
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[place < p.k], j[place < p.k]
            out.append(pd.DataFrame({"query_id": some[i], "vec_id": names[j], "score": scores[i, j]}))
        return pd.concat(out)

    keys = ["cell", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(local, "query_id long, vec_id long, score long")
    return ranked(found, p.k)
