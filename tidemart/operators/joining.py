"""Joins of tables whose columns have the same names, and optional filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suffixed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join on equally named keys; other columns that both sides have get the side's suffix."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    named = lambda df, suffix: df.withColumnsRenamed({c: c + suffix for c in both})
    return named(left, suffixes[0]).join(named(right, suffixes[1]), list(on), how)


def excluding(df: DataFrame, column: str, value: object | None) -> DataFrame:
    """``df`` without the rows whose ``column`` is ``value``; all of it, and no filter in the plan, if there is no value.

    As with ``<>``, rows without anything in ``column`` go too once there is a value.
    """
    return df if value is None else df.where(F.col(column) != F.lit(value))
