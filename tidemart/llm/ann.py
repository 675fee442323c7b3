"""Approximate nearest neighbours by adaptive dimension scan.

Largest inner product is turned into smallest distance by one more component:
``sqrt(M**2 - |x|**2)`` for data, 0 for queries, with M the largest norm.  Those
vectors are rotated at random, so that any block of columns tells about the whole
distance in proportion.  Lists come from k-means on a bounded sample; every vector
is in one.  A query probes the lists nearest to it, and in each, column block by
column block, drops candidates whose partial distance already shows, at
``epsilon`` standard errors, that they are beyond its bound.  The bound is at first
the k-th best of those sample vectors that are in probed lists, later that of the
candidates seen.  Survivors are scored exactly, in double precision, on the
original vectors.  A query left with fewer than k goes through all lists once
more, without abandoning any.

How many lists a query probes is measured when the index is fitted: the fewest that
hold ``probe_recall`` of the true neighbours which sample vectors have in the sample.
On clustered data those are few; without clusters near neighbours are spread over
most lists, and no choice of lists would save much.

Lists that lie next to each other are dealt together, in groups of about
``block_rows`` vectors, so a query is copied once for each group that it probes and
not for each list.  Larger groups are cut in blocks of ``block_rows`` by row and their
queries in blocks of ``block_queries``, so no task gets a whole hot list.

Edge cases: vectors null, zero, empty, of another dimension, or with a null or
non-finite component take no part, nor do null ids; equal scores go to the
smaller id; queries repeated with one id count once, candidates repeated count
each; a query is never its own neighbour; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import kth_best, matrix, one_row_each, ranked, sample_of, valid_rows

MAX_LISTS = 4096


@dataclass(frozen=True)
class Params:
    k: int = 20
    #: Share of true neighbours in the sample that the probed lists have to hold, and the least number of lists.
    probe_recall: float = 0.97
    least_probes: int = 24
    column_block: int = 16
    epsilon: float = 2.6
    bound_sample: int = 8192
    #: Sample vectors that are looked up to choose the number of probes.
    measured: int = 512
    block_rows: int = 8192
    block_queries: int = 2048
    seed: int = 7


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    largest: float
    sample_ids: np.ndarray
    sample: np.ndarray
    sample_lists: np.ndarray
    probes: int = 0

    def lifted(self, x: np.ndarray, data: bool) -> np.ndarray:
        """``x`` with its further component, rotated."""
        last = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(axis=1), 0)) if data else np.zeros(len(x))
        return np.column_stack([x, last]) @ self.rotation


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def _centroids(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(n, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([_squared(x[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)])
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def fit(rows: DataFrame, total: int, dimension: int, p: Params) -> Index:
    largest = float(rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))).first()[0])
    ids, sample = sample_of(rows, total)
    rng = np.random.default_rng(p.seed)
    rotation = np.linalg.qr(rng.standard_normal((dimension + 1, dimension + 1)))[0]
    some = rng.permutation(len(ids))[: p.bound_sample]
    index = Index(rotation, np.zeros((0, dimension + 1)), largest, ids[some], sample[some], np.zeros(0, dtype=np.int64))
    centroids = _centroids(index.lifted(sample, data=True), int(min(MAX_LISTS, max(1, total**0.5))), rng)
    index = replace(index, centroids=centroids, sample_lists=_squared(index.lifted(index.sample, data=True), centroids).argmin(axis=1))
    return replace(index, probes=_probes_needed(index, p))


def _probes_needed(index: Index, p: Params) -> int:
    """The least number of nearest lists that hold ``probe_recall`` of the true neighbours of some sample vectors."""
    x = index.sample[: p.measured]
    scores = x @ index.sample.T
    scores[index.sample_ids[: len(x), None] == index.sample_ids[None, :]] = -np.inf
    near = np.argpartition(-scores, min(p.k, len(index.sample)) - 1, axis=1)[:, : p.k]
    order = _squared(index.lifted(x, data=False), index.centroids).argsort(axis=1).argsort(axis=1)
    place = np.take_along_axis(order, index.sample_lists[near], axis=1)[np.isfinite(np.take_along_axis(scores, near, axis=1))]
    needed = int(np.quantile(place, p.probe_recall, method="higher")) + 1 if len(place) else 1
    return min(len(index.centroids), max(p.least_probes, needed))


def _groups(centroids: np.ndarray, counts: np.ndarray, block_rows: int) -> np.ndarray:
    """The group of each list: neighbours along the centroids' main direction, until they hold ``block_rows`` vectors."""
    middle = centroids - centroids.mean(axis=0)
    order = np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")
    before = np.cumsum(counts[order]) - counts[order]
    out = np.zeros(len(centroids), dtype=np.int64)
    out[order] = np.unique(before // block_rows, return_inverse=True)[1]
    return out


def scan(x: np.ndarray, q: np.ndarray, bound: np.ndarray, seen: np.ndarray, exact, p: Params, rows: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) that survive; ``x``, ``q`` are rotated, ``exact(query, row)`` gives squared distances and scores.

    ``bound`` (squared) and ``seen`` (the k least squared distances of each query) are brought up to date.
    """
    dims, out = x.shape[1], []
    for at in range(0, len(x), rows):
        part = x[at : at + rows]
        partial, alive = np.zeros((len(q), len(part))), None
        for lo in range(0, dims, p.column_block):
            hi = min(dims, lo + p.column_block)
            if alive is None or len(alive[0]) > 0.2 * partial.size:
                partial += _squared(q[:, lo:hi], part[:, lo:hi])
                if alive is not None:
                    keep = np.zeros(partial.shape, dtype=bool)
                    keep[alive] = True
                    partial[~keep] = np.inf
                now = partial
            else:
                i, j = alive
                partial[i, j] += ((q[i, lo:hi] - part[j, lo:hi]) ** 2).sum(axis=1)
                now = partial
            test = bound * (1 + (p.epsilon / np.sqrt(hi) if hi < dims else 1e-9)) ** 2 * hi / dims + 1e-9
            if alive is None or len(alive[0]) > 0.2 * partial.size:
                alive = np.nonzero(now <= test[:, None])
            else:
                keep = now[alive] <= test[alive[0]]
                alive = (alive[0][keep], alive[1][keep])
        i, j = alive
        distance, score = exact(i, j + at)
        out.append((i, j + at, score))
        if len(i):  # tighten each query's bound by what it has seen
            order = np.lexsort((distance, i))
            first = np.searchsorted(i[order], np.arange(len(q)))
            place = np.arange(len(i)) - first[i[order]]
            use = place < p.k
            best = np.full((len(q), p.k), np.inf)
            best[i[order][use], place[use]] = distance[order][use]
            seen[:] = np.sort(np.concatenate([seen, best], axis=1), axis=1)[:, : p.k]
            np.minimum(bound, seen[:, -1], out=bound)
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def search(table: DataFrame, is_query: Column, params: Params | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows for which ``is_query`` (over ``vec_id``) holds."""
    p = params or Params()
    rows, total, dimension = valid_rows(table, id_col, vector_col, zero=False)
    spark = table.sparkSession
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(rows, total, dimension, p)
    shared = spark.sparkContext.broadcast(index)
    lists = len(index.centroids)
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                near = _squared(index.lifted(matrix(batch.column(1)), data=True), index.centroids).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["vec_id", "vector", "list"])

    data = materialize(rows.mapInArrow(listed, "vec_id long, vector array<double>, list int"), "lists")
    queries = materialize(one_row_each(rows.where(is_query)), "queries")
    counts = {r["list"]: r["n"] for r in data.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MAX_LISTS
    groups = _groups(index.centroids, np.array([counts.get(k, 0) for k in range(lists)]), p.block_rows)
    found = materialize(_searched(data, queries, shared, groups, index.probes, p), "found")
    enough = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")).where(F.col("n") >= min(p.k, total - 1)).select("vec_id")
    short = queries.join(enough, "vec_id", "left_anti")
    if not short.isEmpty():
        more = _searched(data, short, shared, groups, lists, replace(p, epsilon=np.inf))
        found = found.join(enough.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(more)
    return ranked(found, p.k)


def _searched(data: DataFrame, queries: DataFrame, shared, groups: np.ndarray, probes: int, p: Params) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``: up to k of every block that a query probes."""
    lists = len(groups)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, x = part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(1))
                scores = x @ index.sample.T
                scores[ids[:, None] == index.sample_ids[None, :]] = -np.inf
                near = np.argpartition(_squared(index.lifted(x, data=False), index.centroids), probes - 1, axis=1)[:, :probes]
                looked = np.zeros((len(ids), lists), dtype=bool)
                np.put_along_axis(looked, near, True, axis=1)
                scores[~looked[:, index.sample_lists]] = -np.inf
                best = kth_best(scores, p.k)
                bound = np.where(np.isfinite(best), (x * x).sum(axis=1) + index.largest**2 - 2 * best + 1e-9 * index.largest**2, np.inf)
                query, at_list = np.nonzero(looked)
                order = np.lexsort((groups[at_list], query))
                query, at_list = query[order], at_list[order].astype(np.int32)
                starts = np.flatnonzero(np.diff(query, prepend=-1) | np.diff(groups[at_list], prepend=-1))
                take = query[starts]
                of_group = pa.ListArray.from_arrays(pa.array(np.append(starts, len(query)).astype(np.int32)), pa.array(at_list))
                columns = [part.column(0).take(pa.array(take)), part.column(1).take(pa.array(take)), pa.array(bound[take]), pa.array(groups[at_list[starts]].astype(np.int32)), of_group]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "bound", "group", "lists"])

    asked = materialize(queries.mapInArrow(probed, "vec_id long, vector array<double>, bound double, group int, lists array<int>"), "probes")
    group = F.element_at(F.array(*[F.lit(int(g)) for g in groups]), F.col("list") + 1)
    grouped = data.withColumn("group", group)

    def block_counts(df: DataFrame, size: int) -> Column:
        """Blocks of each group: no more numbers than lists."""
        counts = {r["group"]: -(-r["n"] // size) for r in df.groupBy("group").agg(F.count("*").alias("n")).collect()}
        return F.element_at(F.array(*[F.lit(int(counts.get(i, 1))) for i in range(int(groups.max()) + 1)]), F.col("group") + 1)

    n_data, n_asked = block_counts(grouped, p.block_rows), block_counts(asked, p.block_queries)
    dealt = grouped.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), n_data).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), n_asked - 1)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), n_asked).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), n_data - 1)))

    def local(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        index = shared.value
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        left = left.sort_values(["list", "vec_id"])
        x, q = np.stack(left["vector"].to_numpy()), np.stack(right["vector"].to_numpy())
        names, asking, own = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), left["list"].to_numpy()
        spare = index.largest**2 + (q * q).sum(axis=1)
        lifted_x, lifted_q = index.lifted(x, data=True), index.lifted(q, data=False)
        bound, seen = right["bound"].to_numpy().copy(), np.full((len(q), p.k), np.inf)
        looked = np.zeros((len(q), lists), dtype=bool)
        for i, some in enumerate(right["lists"]):
            looked[i, some] = True
        cuts, out = [*np.flatnonzero(np.diff(own, prepend=-1)), len(own)], []
        for lo, hi in zip(cuts, cuts[1:]):
            here = np.flatnonzero(looked[:, own[lo]])
            if not len(here):
                continue

            def exact(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                i, j = here[i], j + lo
                score = np.concatenate([(q[i[s : s + 65536]] * x[j[s : s + 65536]]).sum(axis=1) for s in range(0, len(i), 65536)] or [np.zeros(0)])
                return np.where(names[j] == asking[i], np.inf, spare[i] - 2 * score), score

            best, kept = bound[here], seen[here]
            i, j, score = scan(lifted_x[lo:hi], lifted_q[here], best, kept, exact, p)
            bound[here], seen[here] = best, kept
            i, j = here[i], j + lo
            good = (names[j] != asking[i]) & (spare[i] - 2 * score <= bound[i] + 1e-9 * index.largest**2)
            out.append(pd.DataFrame({"query_id": asking[i[good]], "vec_id": names[j[good]], "score": score[good]}))
        if not out:
            return local(left[:0], right)
        return pd.concat(out).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(p.k)

    keys = ["group", "block", "part"]
    return dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(local, "query_id long, vec_id long, score double")
