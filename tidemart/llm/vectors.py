"""What the two vector searches share: valid rows, bounded samples, Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000


def finite(vector: Column) -> Column:
    """Neither null nor empty, and no component null, infinite or not a number."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def valid_rows(table: DataFrame, id_col: str, vector_col: str, *, zero: bool) -> tuple[DataFrame, int, int]:
    """``vec_id``, ``vector`` of the rows that take part, how many, and their dimension.

    Rows of another dimension than the commonest (of several, the largest) take no part.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("vector")))
    if not zero:
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return rows, 0, 0
    return rows.where(F.size("vector") == sizes[0]["d"]), sizes[0]["n"], sizes[0]["d"]


def sample_of(rows: DataFrame, total: int, limit: int = SAMPLE_ROWS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of about ``limit`` rows (all, if there are fewer), picked by a hash of id and vector; one at least."""
    picked = F.pmod(F.xxhash64("vec_id", "vector", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, limit / max(total, 1)) * (1 << 30))
    found = rows.where(picked).limit(2 * limit).toArrow()
    if not found.num_rows:  # few different rows, and none of their hashes small enough
        found = rows.limit(1).toArrow()
    order = np.argsort(found["vec_id"].to_numpy(), kind="stable")
    return found["vec_id"].to_numpy()[order], matrix(found["vector"])[order]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def one_row_each(queries: DataFrame) -> DataFrame:
    """Queries that repeat an id count once, with the largest of their vectors."""
    return queries.groupBy("vec_id").agg(F.max("vector").alias("vector"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of ``query_id``, ``vec_id``, ``score`` for each query, ties to the smaller id."""
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return -np.partition(-scores, k - 1, axis=1)[:, k - 1]
