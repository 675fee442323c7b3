"""Recency and monetary segments, and complete grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import day_diff
from ..session import written
from .ranking import global_ntile

#: Segment, range of recency scores, range of monetary scores; the first that fits counts.
SEGMENTS = [
    ("champions", (4, 5), (4, 5)),
    ("high_value_lapsed", (1, 2), (4, 5)),
    ("recent_low_value", (4, 5), (1, 2)),
    ("hibernating", (1, 2), (1, 2)),
    ("loyal", (3, 5), (3, 5)),
]
OTHER_SEGMENT = "needs_attention"


def segment(r: Column, m: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, recency, money in SEGMENTS:
        out = out.when(r.between(*recency) & m.between(*money), F.lit(name))
    return out.otherwise(F.lit(OTHER_SEGMENT))


def per_customer(orders: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Orders, money and recency, in days before the latest order of all, of each customer."""
    anchor = F.broadcast(orders.agg(F.max(at).alias("as_of")))
    grouped = orders.groupBy(key).agg(F.count("*").alias("order_count"), F.sum(value).cast("double").alias("monetary_value"), F.max(at).alias("last_order_at"))
    return grouped.crossJoin(anchor).select(key, "order_count", (F.col("order_count") > 1).alias("is_repeat"), "monetary_value", "last_order_at", day_diff(F.col("last_order_at"), F.col("as_of")).alias("_r"), "as_of").withColumn("recency_days", -F.col("_r")).drop("_r", "as_of")


def rfm(orders: DataFrame, key: str, at: str, value: str, groups: int = 5) -> DataFrame:
    """``per_customer`` with scores by quantile group, ties by key, and the segment."""
    people = written(per_customer(orders, key, at, value), "customers")
    scored = global_ntile(people, groups, [F.desc("recency_days"), F.asc(key)], "r_score")
    scored = global_ntile(scored, groups, [F.asc("monetary_value"), F.asc(key)], "m_score")
    return scored.withColumn("rfm_segment", segment(F.col("r_score"), F.col("m_score")))


def complete_grid(left: DataFrame, right: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """All pairs of two small sets of labels; refuses a grid beyond ``limit`` cells."""
    n, m = left.count(), right.count()
    if n * m > limit:
        raise ValueError(f"a grid of {n} x {m} cells")
    return left.crossJoin(F.broadcast(right))
