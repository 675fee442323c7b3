"""CSV and Parquet sources with stated schemas, and their sinks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and a stated schema; a byte-order mark before the header is harmless.

    ``columns`` are those that are wanted: the others are cut but not converted.
    """
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", True).csv(path)
    return rows.select(*columns) if columns else rows


def verified_count(df: DataFrame, expected: int) -> DataFrame:
    """``df``, if it has the rows that it should have."""
    if (n := df.count()) != expected:
        raise ValueError(f"{n} rows instead of {expected}")
    return df


def seed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small reference table from one definition in code."""
    return spark.createDataFrame(rows, schema)


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Zstandard Parquet of each table, and the rows written of each."""
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
        counts[name] = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}").count()
    return counts


def write_manifest(spark: SparkSession, path: str, facts: dict) -> None:
    """A JSON manifest beside an export, on any file system that Spark writes."""
    spark.range(1).select(F.lit(json.dumps(facts, sort_keys=True)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The facts of a manifest."""
    return json.loads("".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def catalogue(tables: Mapping[str, DataFrame]) -> list[tuple[str, int, str, str]]:
    """Table, position, column and type of all ``tables``, as a question about them needs."""
    return [(name, k, f.name, f.dataType.simpleString()) for name, df in sorted(tables.items()) for k, f in enumerate(df.schema.fields, 1)]


def frozen_schema(df: DataFrame) -> dict:
    return json.loads(df.schema.json())
