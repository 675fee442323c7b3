"""Ratios and intervals over aggregated columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normal quantile of a two-sided 95 % interval.
Z95 = 1.959964


def ratio_or(part: Column, whole: Column, default: float | None, scale: float = 1.0, digits: int | None = None) -> Column:
    """``scale * part / whole`` in double precision; ``default`` where ``whole`` is 0."""
    value = F.lit(float(scale)) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    value = F.round(value, digits) if digits is not None else value
    return F.when(whole == 0, F.lit(default).cast("double")).otherwise(value)


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson's interval of a share, inside 0 and 1; null without observations."""
    p, m = successes.cast("double") / F.nullif(n.cast("double"), F.lit(0.0)), F.nullif(n.cast("double"), F.lit(0.0))
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def f_measure(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both == 0, F.lit(0.0)).otherwise(2 * precision * recall / F.nullif(both, F.lit(0.0)))
