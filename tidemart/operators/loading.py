"""Idempotent loads: partition replacement, keyed upsert, incremental merge, markers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scans import same


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system that Spark reads has ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def replace_slice(rows: DataFrame, path: str, column: str, value: str) -> int:
    """Write a slice in place of what it held, even if ``rows`` is empty; the count is read back."""
    spark = rows.sparkSession
    target = f"{path}/{column}={value}"
    rows.drop(column).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(target)
    return spark.read.schema(rows.drop(column).schema).parquet(target).count()


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the last in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def deduplicated(batch: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row for each key, nulls being keys like others: the one with the largest ``order``, then the largest of all its columns."""
    row = F.struct(*batch.columns)
    last = F.max_by(row, F.struct(*order, *batch.columns)) if order else F.max(row)
    return batch.groupBy(*keys).agg(last.alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in batch.columns])


def conflicts(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys for which ``batch`` has different rows, with the numbers of rows and of different ones."""
    different = F.count_distinct(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in batch.columns]))
    return batch.groupBy(*keys).agg(F.count("*").alias("n"), different.alias("n_different")).where("n_different > 1")


def restated(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` with the keys of ``new``, which has each of them once, restated by it."""
    return target.join(new, same(target, new, keys), "left_anti").select(*target.columns).unionByName(new)


def merged(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``target`` with the keys of ``batch`` restated by it; a rerun changes nothing, whatever keys are null or repeated in the batch."""
    return restated(target, deduplicated(batch, keys, order), keys)


def window_of(rows: DataFrame, at: str, start: str, end: str | None = None) -> DataFrame:
    """Rows at or after ``start`` and before ``end``."""
    out = rows.where(F.col(at) >= F.lit(start).cast("timestamp_ntz"))
    return out.where(F.col(at) < F.lit(end).cast("timestamp_ntz")) if end else out


def replace_reference(rows: DataFrame, path: str) -> DataFrame:
    """Put ``rows`` in place of a whole reference table; the table as it is read back."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def create_once(rows: DataFrame, path: str) -> bool:
    """Write ``rows`` unless there is a table at ``path``; whether they were written."""
    if exists(rows.sparkSession, path):
        return False
    rows.write.parquet(path)
    return True


def with_wider_key(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct rows of ``table`` in a new key: what a migration to more key columns keeps."""
    return table.select(*keys).distinct()


def slice_counts(tables: dict[str, str], spark: SparkSession, column: str) -> DataFrame:
    """``name``, ``slice``, ``n``: the rows of each slice of each table, counted where they are stored."""
    counted = [spark.read.parquet(path).groupBy(F.col(column).cast("string").alias("slice")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "slice", "n") for name, path in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def unreconciled(owed: DataFrame, loaded: DataFrame) -> DataFrame:
    """Of ``name``, ``slice``, ``n`` as owed: what isn't loaded, or not with the rows it should have."""
    return owed.join(loaded.withColumnRenamed("n", "loaded"), ["name", "slice"], "left").where(~F.col("n").eqNullSafe(F.col("loaded")))


def mark_slices(counts: DataFrame, path: str) -> None:
    """Record, last of all, which slices are loaded, from ``slice_date``, ``name`` and ``n`` of their tables.

    A slice without tables has one row whose ``name`` is null; marking a slice again restates it.
    """
    facts = F.map_from_entries(F.filter(F.array_sort(F.collect_list(F.struct("name", "n"))), lambda x: x["name"].isNotNull()))
    marked = counts.groupBy(F.col("slice_date").cast("date").alias("slice_date")).agg(F.current_timestamp().alias("loaded_at"), F.count("name").cast("int").alias("table_count"), F.to_json(facts).alias("row_counts"))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice_date").parquet(path)


def mark_complete(spark: SparkSession, path: str, slice_date: str, counts: dict[str, int]) -> None:
    """Mark one slice; an empty one counts too."""
    rows = [(slice_date, name, n) for name, n in counts.items()] or [(slice_date, None, None)]
    mark_slices(spark.createDataFrame(rows, "slice_date string, name string, n long"), path)


def missing_slices(spark: SparkSession, path: str, planned: Sequence[str]) -> list[str]:
    """Planned slices without a marker."""
    if not exists(spark, path):
        return list(planned)
    marked = spark.read.parquet(path).select(F.col("slice_date").cast("string").alias("d"))
    done = {r.d for r in marked.where(F.col("d").isin(list(planned))).distinct().collect()}  # at most the planned ones
    return [d for d in planned if d not in done]


def without_marker(spark: SparkSession, path: str, planned: DataFrame, column: str) -> DataFrame:
    """Rows of ``planned`` whose slice (its date in ``column``) has no marker, for any number of slices."""
    if not exists(spark, path):
        return planned
    done = spark.read.parquet(path).select(F.col("slice_date").cast("date").alias("_done")).distinct()
    return planned.join(done, F.to_date(column) == F.col("_done"), "left_anti")


def consistent_slice(tables: dict[str, DataFrame], root: str, at: str, start: str, end: str, children: dict[str, tuple[str, str]], parents: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Rows of ``root`` in a window, with the children and parents (own key, root's key) that they refer to."""
    chosen = window_of(tables[root], at, start, end)
    out = {root: chosen}
    for name, (own, theirs) in {**children, **parents}.items():
        keys = chosen.select(F.col(theirs).alias(own)).distinct()
        out[name] = tables[name].join(keys, own, "left_semi")
    return out
