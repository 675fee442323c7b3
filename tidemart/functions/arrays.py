"""Functions of arrays and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_array(json: Column) -> Column:
    """The strings of a JSON array; null if it isn't one."""
    return F.from_json(json, "array<string>")


def sorted_distinct(xs: Column) -> Column:
    return F.array_sort(F.array_distinct(xs))


def is_subset(xs: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(xs, F.array(*map(F.lit, allowed)))) == 0


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two sets; two empty sets are the same."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / whole)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))
