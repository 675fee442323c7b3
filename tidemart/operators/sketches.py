"""Distinct counts that are kept a slice at a time and merged for any set of slices.

Exact: the values of a column are numbered once, densely; a slice keeps bitmaps of the numbers that it holds, and bitmaps of several
slices are joined by OR.  Approximate: a slice keeps a HyperLogLog sketch of each column.  Both are written beside the slices, so a
count over a year reads a year of bitmaps or sketches, and no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ranking import global_row_number

#: Bits of a sketch's number of registers: with 12, the error is below 5 % in 99 of 100 counts.
LOG_REGISTERS = 12


def _stacked(rows: DataFrame, slice_col: str, columns: Sequence[str]) -> DataFrame:
    """``slice``, ``column``, ``value``: one row for each column, so that one pass does for all."""
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.col(slice_col).alias("slice"), F.explode(values).alias("_v")).select("slice", "_v.*").where("value is not null")


def dictionary(rows: DataFrame, slice_col: str, columns: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """``column``, ``value``, ``number``: values numbered from 0; those of ``known`` keep their numbers, new ones follow."""
    values = _stacked(rows, slice_col, columns).select("column", "value").distinct()
    if known is None:
        return global_row_number(values, [F.asc("column"), F.asc("value")], "number").withColumn("number", F.col("number") - 1)
    new, first = values.join(known, ["column", "value"], "left_anti"), known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    added = global_row_number(new, [F.asc("column"), F.asc("value")], "number").withColumn("number", F.col("number") - 1 + first)
    return known.unionByName(added.select(*known.columns))


def bitmaps(rows: DataFrame, slice_col: str, columns: Sequence[str], numbers: DataFrame) -> DataFrame:
    """``slice``, ``column``, ``bucket``, ``bitmap``: the numbers that each slice holds, 32,768 to a bitmap."""
    seen = _stacked(rows, slice_col, columns).distinct().join(numbers, ["column", "value"])
    bucket, bit = F.floor(F.col("number") / 32768).alias("bucket"), F.pmod("number", F.lit(32768))
    return seen.groupBy("slice", "column", bucket).agg(F.bitmap_construct_agg(bit).alias("bitmap"))


def exact_counts(maps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``column``, ``n``: distinct values over all slices of ``maps`` (of each group ``by``)."""
    joined = maps.groupBy(*by, "column", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return joined.groupBy(*by, "column").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def sketches(rows: DataFrame, slice_col: str, columns: Sequence[str]) -> DataFrame:
    """``slice``, ``column``, ``sketch``."""
    return _stacked(rows, slice_col, columns).groupBy("slice", "column").agg(F.hll_sketch_agg("value", LOG_REGISTERS).alias("sketch"))


def estimated_counts(kept: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``column``, ``n``: about how many distinct values there are over all slices of ``kept``."""
    return kept.groupBy(*by, "column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """Bitmaps or sketches as a table beside the slices."""
    return written(df, name)
