"""Slowly changing dimensions from ordered observations, and as-of joins to them.

Keys with very many rows are never sorted in one task: see ``scans``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import surrogate_key
from .scans import HOT_ROWS, earlier, hot_keys, parted, ranged, stitched

FLOOR, CEILING = "1900-01-01 00:00:00", "9999-12-31 23:59:59"


def _differs(before: str, here: str):
    return F.when(F.col(before).isNull() | (F.col(before) != F.col(here)), 1).otherwise(0)


def _numbered_by_window(hashed: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    started = hashed.withColumn("previous_hash", F.lag("attribute_hash").over(w)).withColumn("is_version_start", _differs("previous_hash", "attribute_hash"))
    return started.withColumn("version_number", F.sum("is_version_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))


def _numbered_by_range(hashed: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The same for hot keys: versions are counted inside ranges, and a range goes on with the count and the hash of those before."""
    table, inside = ranged(hashed, [key], order)
    local = table.withColumn("_row", F.row_number().over(inside)).withColumn("_previous", F.lag("attribute_hash").over(inside))
    local = local.withColumn("_start", F.when(F.col("_row") > 1, _differs("_previous", "attribute_hash")).otherwise(0))
    ends = local.groupBy("_range", key).agg(F.min_by("attribute_hash", "_row").alias("_first"), F.max_by("attribute_hash", "_row").alias("_last"), F.sum("_start").alias("_starts"))
    known = Window.partitionBy(key).orderBy("_range")
    joined = ends.withColumn("_before", F.lag("_last").over(known)).withColumn("_begins", _differs("_before", "_first")).withColumn("_own", F.col("_starts") + F.col("_begins"))
    offsets = joined.withColumn("_offset", F.coalesce(F.sum("_own").over(known.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_begins"))
    whole = stitched(local, offsets.select("_range", key, "_before", "_begins", "_offset"), [key])
    counted = F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_offset")
    first = F.col("_row") == 1
    return whole.withColumn("version_number", counted.cast("long")).select(
        *hashed.columns, F.when(first, F.col("_before")).otherwise(F.col("_previous")).alias("previous_hash"), F.when(first, F.col("_begins")).otherwise(F.col("_start")).alias("is_version_start"), "version_number"
    )


def numbered(observations: DataFrame, key: str, order: Sequence[str], attributes: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every observation with ``attribute_hash``, its predecessor's, whether a version begins, and the version's number."""
    hashed = observations.withColumn("attribute_hash", surrogate_key(*map(F.col, attributes)))
    cold, hot = parted(hashed, hot_keys(observations, [key], hot_rows), [key])
    out = _numbered_by_window(cold, key, order)
    return out if hot is None else out.unionByName(_numbered_by_range(hot, key, order))


def marked(observations: DataFrame, key: str, order: Sequence[str], attributes: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``observations`` with ``attribute_hash``, its predecessor's and whether a version begins."""
    return numbered(observations, key, order, attributes, hot_rows).drop("version_number")


def _grouped(rows: DataFrame, key: str, order: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    return rows.groupBy(key, "version_number").agg(F.min(order[0]).alias("version_started_at"), *[F.min(a).alias(a) for a in attributes], F.min("attribute_hash").alias("attribute_hash"), F.count("*").alias("observations_in_version"))


def versions(observations: DataFrame, key: str, order: Sequence[str], attributes: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each run of equal attributes.  All windows share one shuffle on ``key``."""
    return _grouped(numbered(observations, key, order, attributes, hot_rows), key, order, attributes)


def dimension(observations: DataFrame, key: str, order: Sequence[str], attributes: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Type 2 dimension over half-open intervals; the first version reaches back to ``FLOOR``.

    A version ends where the next begins: the window's next row, or for a hot key the row with the next number.
    """
    hashed = observations.withColumn("attribute_hash", surrogate_key(*map(F.col, attributes)))
    cold, hot = parted(hashed, hot_keys(observations, [key], hot_rows), [key])
    following = F.lead("version_started_at").over(Window.partitionBy(key).orderBy("version_number"))
    v = _grouped(_numbered_by_window(cold, key, order), key, order, attributes).withColumn("next_started_at", following)
    if hot is not None:
        long = _grouped(_numbered_by_range(hot, key, order), key, order, attributes)
        later = long.select(F.col(key).alias("_key"), (F.col("version_number") - 1).alias("_number"), F.col("version_started_at").alias("next_started_at"))
        v = v.unionByName(long.join(later, long[key].eqNullSafe(later["_key"]) & (F.col("version_number") == F.col("_number")), "left").drop("_key", "_number"))
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return v.select(
        surrogate_key(F.col(key), F.col("version_number")).alias("sk"),
        key,
        "version_number",
        *attributes,
        F.when(F.col("version_number") == 1, stamp(FLOOR)).otherwise(F.col("version_started_at")).alias("valid_from"),
        F.coalesce("next_started_at", stamp(CEILING)).alias("valid_to"),
        F.col("next_started_at").isNull().alias("is_current"),
        F.col("version_started_at").alias("first_observed_at"),
        F.col("observations_in_version"),
    )


def asof_join(facts: DataFrame, dim: DataFrame, key: str, at: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each fact with the version valid at its time; ``how`` is ``inner`` or ``left``.

    An equi join on ``key`` with the interval as a residual condition, so both sides shuffle on the key only (or a small
    dimension is broadcast by Spark's own measure of it).  Facts of hot keys and their versions are scanned together in
    their order instead, in ranges, each fact with the last version that began: a row for each, whatever the number of
    versions.  Intervals of one key may not overlap; empty ones are never met.
    """
    d = dim.withColumnRenamed(key, f"_{key}")
    inside = (F.col(key) == F.col(f"_{key}")) & (F.col(at) >= F.col("valid_from")) & (F.col(at) < F.col("valid_to"))
    hot = hot_keys(facts.where(F.col(key).isNotNull()), [key], hot_rows)
    cold, many = parted(facts, hot, [key])
    out = cold.join(d, inside, how).drop(f"_{key}")
    if many is None:
        return out
    began = dim.join(F.broadcast(hot), key, "left_semi").where("valid_from < valid_to")
    rest = [c for c in dim.columns if c != key]
    seen = many.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_fact"))
    rows = began.select(F.col(key).alias("_k"), F.col("valid_from").alias("_t"), F.lit(0).alias("_kind"), F.struct(*rest).alias("_version")).unionByName(seen, allowMissingColumns=True)
    table, w = ranged(rows, ["_k"], ["_t", "_kind"])
    local = table.withColumn("_last", F.last("_version", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lasts = table.groupBy("_range", "_k").agg(F.max_by("_version", F.when(F.col("_kind") == 0, F.col("_t"))).alias("_version"))
    carried = earlier(lasts, ["_k"], {"_carried": lambda before: F.last("_version", ignorenulls=True).over(before)})
    whole = stitched(local, carried, ["_k"]).where("_kind = 1").withColumn("_version", F.coalesce("_last", "_carried"))
    valid = F.coalesce(F.col("_t") < F.col("_version.valid_to"), F.lit(False))
    met = whole.where(valid) if how == "inner" else whole.withColumn("_version", F.when(valid, F.col("_version")))
    return out.union(met.select(*[F.col(f"_fact.{c}") for c in facts.columns], *[F.col(f"_version.{c}") for c in rest]))
