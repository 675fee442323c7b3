"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: ASCII upper to lower case on UTF-8 bytes; other bytes stay as they are.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: A word of the corpus contracts: a run of characters other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside go when it ends, but for those to ``keep``; what is returned may only need these."""
    folder = shared_path(spark, "scratch")
    outer = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(outer)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, *, keep: bool = False, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and losing an executor costs only what it was computing."""
    spark, folder = df.sparkSession, _SCRATCH.get()
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder and not keep else shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more than one in so many rows, and more than ``HOT_ROWS``, is hot; so there are no more hot keys than that.
HOT_SHARE = 10_000
HOT_ROWS = 256


def looked_up(rows: DataFrame, facts: DataFrame, keys: Sequence[str], counted: str | None = None) -> DataFrame:
    """``rows`` left-joined with ``facts``, which has one row for each of its keys, without dealing a hot key to one task.

    At most ``HOT_SHARE`` keys are hot: their facts are broadcast and their rows stay where they are.  All other
    keys are joined as Spark sees fit.  ``rows`` is read more than once, so it should be a table; they are counted
    by key, unless facts say in ``counted`` how many rows their key has.
    """
    keys = list(keys)
    most = max(rows.count() // HOT_SHARE, HOT_ROWS)
    counts = facts.select(*keys, F.col(counted).alias("_n")) if counted else rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = counts.where(F.col("_n") > most).select(*keys).where(" and ".join(f"`{k}` is not null" for k in keys)).collect()
    if not hot:
        return rows.join(facts, keys, "left")
    named = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*keys).schema))
    heated = rows.join(named, keys, "left_semi").join(F.broadcast(facts.join(named, keys, "left_semi")), keys, "left")
    return rows.join(named, keys, "left_anti").join(facts, keys, "left").unionByName(heated)


def word_count(text: Column) -> Column:
    """Number of words in ``text`` as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


#: Bytes of an Arrow batch that a Python worker is given at a time.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small enough for workers with little memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def parts(column: pa.Array, rows: int = 256) -> Iterator[list]:
    """The values of ``column``, a few at a time."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task; it keeps no more than one."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Give back what the worker keeps, for work that needs the memory."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
