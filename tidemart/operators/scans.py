"""Running values along the rows of a key, for keys of any size.

Most keys have few rows, and a window over each is the plan to take.  The rows of a hot key are cut into ranges of
their order instead: each range is scanned by itself, and what a range starts from (a sum, a last value) is found from
one row for each range and hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: A key is hot with more rows than this, but no more than the ``HOT_KEYS`` hottest are, so what is known of them can be broadcast.
HOT_ROWS = 20_000
HOT_KEYS = 10_000
RANGE = "_range"


def hot_keys(rows: DataFrame, keys: Sequence[str], least: int = HOT_ROWS) -> DataFrame | None:
    """The keys with more than ``least`` rows, the hottest of them if they are very many; None if there are none."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > least)
    hot = counts.orderBy(F.desc("_n"), *keys).limit(HOT_KEYS).select(*keys)
    found = hot.collect()
    return rows.sparkSession.createDataFrame(found, hot.schema) if found else None


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Whether both have the same keys; a null is a key like others."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def parted(rows: DataFrame, hot: DataFrame | None, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of other keys, and those of hot ones."""
    if hot is None:
        return rows, None
    named = F.broadcast(hot)
    return rows.join(named, same(rows, hot, keys), "left_anti"), rows.join(named, same(rows, hot, keys), "left_semi")


def ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, Callable]:
    """``rows`` as a table in ranges of key and order, and the window inside a range that ends at offset ``to``."""
    by = [F.asc_nulls_first(c) for c in [*keys, *order]]
    table = written(rows.repartitionByRange(*by).withColumn(RANGE, F.spark_partition_id()), "ranged")
    return table, Window.partitionBy(RANGE, *keys).orderBy(*[F.asc_nulls_first(c) for c in order])


def earlier(borders: DataFrame, keys: Sequence[str], values: Mapping[str, Callable[[Window], Column]]) -> DataFrame:
    """For each range of a key, ``values`` of its ranges before this one."""
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return borders.select(RANGE, *keys, *[make(before).alias(name) for name, make in values.items()])


def stitched(table: DataFrame, borders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with what its ranges start from: a row for each range of a hot key, which is as many as there are ranges and hot keys."""
    on = (table[RANGE] == borders[RANGE]) & same(table, borders, keys)
    return table.join(F.broadcast(borders), on).drop(*[borders[c] for c in [RANGE, *keys]])


def running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with running sums, their own row included and nulls left out: name of the new column by column.  ``order`` is ascending, nulls first, and total."""
    cold, hot = parted(rows, hot_keys(rows, keys, hot_rows), keys)
    to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = to_here(Window.partitionBy(*keys).orderBy(*[F.asc_nulls_first(c) for c in order]))
    out = cold.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(name) for name, c in sums.items()])
    if hot is None:
        return out
    table, inside = ranged(hot, keys, order)
    totals = table.groupBy(RANGE, *keys).agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    starts = earlier(totals, keys, {f"_s_{name}": (lambda b, name=name: F.coalesce(F.sum(f"_t_{name}").over(b), F.lit(0))) for name in sums})
    local = table.select("*", *[F.sum(c).over(to_here(inside)).alias(name) for name, c in sums.items()])
    whole = stitched(local, starts, keys)
    return out.unionByName(whole.select(*rows.columns, *[(F.coalesce(name, F.lit(0)) + F.col(f"_s_{name}")).alias(name) for name in sums]))
