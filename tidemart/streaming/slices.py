"""Slices that arrive as files, merged by key: late rows restate what they belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.merging import merge_table


def merge_arrivals(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Merge every file not yet seen into ``target`` (see ``merge_state``) and stop.  No watermark: it would drop late rows.

    Of the rows of a key that arrive together, the one with the largest ``order`` counts.
    """

    def each(batch: DataFrame, _: int) -> None:
        merge_table(batch.sparkSession, batch, target, keys, order=order)

    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
