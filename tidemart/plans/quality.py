"""Data checks: each returns the rows that break it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contains_non_ascii, surrogate_key


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def accepted(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(values)))


def related(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values without a parent; nulls have none to miss."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().join(parent.select(F.col(key).alias(column)), column, "left_anti")


def holds(df: DataFrame, condition: Column, where: Column | None = None) -> DataFrame:
    """Rows (of those ``where``) for which ``condition`` isn't true."""
    rows = df.where(where) if where is not None else df
    return rows.where(~F.coalesce(condition, F.lit(False)))


def same_grain(df: DataFrame, source: DataFrame) -> DataFrame:
    """One row if the two differ in their number of rows."""
    n, m = df.agg(F.count("*").alias("n")), source.agg(F.count("*").alias("m"))
    return n.crossJoin(m).where("n <> m")


def no_overlap(dim: DataFrame, key: str) -> DataFrame:
    following = F.lead("valid_from").over(Window.partitionBy(key).orderBy("version_number"))
    return dim.withColumn("next_from", following).where("next_from < valid_to")


def one_current(dim: DataFrame, key: str) -> DataFrame:
    return dim.groupBy(key).agg(F.count_if("is_current").alias("n")).where("n <> 1")


def reconciled(dim: DataFrame, observations: DataFrame) -> DataFrame:
    """One row if versions don't add up to what was observed."""
    n, m = dim.agg(F.sum("observations_in_version").alias("n")), observations.agg(F.count("*").alias("m"))
    return n.crossJoin(m).where("n <> m")


def ascii_only(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(F.greatest(*[F.coalesce(contains_non_ascii(F.col(c)), F.lit(False)) for c in columns])) if len(columns) > 1 else df.where(contains_non_ascii(F.col(columns[0])))


def same_boundaries(observations: DataFrame, key: str, order: Sequence[str], raw: Sequence[str], normal: Sequence[str]) -> DataFrame:
    """One row if normalising attributes moves or adds a version boundary."""
    w = Window.partitionBy(key).orderBy(*order)
    a, b = surrogate_key(*map(F.col, raw)), surrogate_key(*map(F.col, normal))
    hashed = observations.withColumn("_a", a).withColumn("_b", b)
    moved = hashed.select((~F.lag("_a").over(w).eqNullSafe(F.col("_a"))).alias("x"), (~F.lag("_b").over(w).eqNullSafe(F.col("_b"))).alias("y"))
    return moved.agg(F.count_if("x").alias("raw"), F.count_if("y").alias("normal")).where("raw <> normal")


def single_provenance(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Rows unless every row has exactly the expected labels, and there are rows at all."""
    found = df.groupBy(*expected).agg(F.count("*").alias("n"))
    good = F.lit(True)
    for c, v in expected.items():
        good = good & F.col(c).eqNullSafe(F.lit(v))
    none = df.agg(F.count("*").alias("n")).where("n = 0").select(*[F.lit(None).cast("string").alias(c) for c in expected], "n")
    return found.where(~good).unionByName(none)
