"""JSON lines into a table: rows that fit its schema are appended, the others are kept with their place and the reason.

A batch is a partition of both tables, written as a whole, so loading a batch again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The partition column of both tables.
BATCH = "batch"
REJECTED = "file string, place long, line string, reason string"


def _fault(value: Column, schema: T.StructType) -> Column:
    """Why a line is no row of ``schema``: the first field that doesn't fit it; null if it is one."""
    reason = F.when(~F.schema_of_variant(value).startswith("OBJECT"), "not an object")
    for f in schema.fields:
        given, kind = F.try_variant_get(value, f"$.{f.name}", "string"), f.dataType.simpleString()
        typed = F.try_variant_get(value, f"$.{f.name}", kind)
        reason = reason.when(given.isNotNull() & typed.isNull(), f"{f.name}: not {kind}")
        if not f.nullable:
            reason = reason.when(given.isNull(), f"{f.name}: missing")
    return reason


def checked(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """``file``, ``place``, ``line`` with ``reason`` (null: none) and ``row``, a struct of ``schema``; blank lines are left out.

    Fields have plain types; one that isn't nullable has to be there; fields that the schema doesn't name are ignored.
    """
    value = F.try_parse_json("line")
    reason = F.when(value.isNull(), "not JSON").otherwise(_fault(value, schema))
    row = F.struct(*[F.try_variant_get(value, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields])
    return lines.where(F.trim("line") != "").select("file", "place", "line", reason.alias("reason"), row.alias("row"))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``place``, ``line`` of text files; places of a file ascend with its lines."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))


def ingest(spark: SparkSession, path: str, schema: T.StructType, table: str, rejects: str, batch: str) -> None:
    """Load the JSON lines below ``path`` as ``batch`` of ``table``, and what doesn't fit as the same batch of ``rejects``."""
    rows = checked(lines_of(spark, path), schema)
    put = lambda df, target: df.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch}")
    put(rows.where("reason is not null").select("file", "place", "line", "reason"), rejects)
    put(rows.where("reason is null").select("row.*"), table)  # last: a batch that is there has its rejects too
