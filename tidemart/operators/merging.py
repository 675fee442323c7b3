"""Merge tables: keyed tables in partitions, of which a merge rewrites only those that it has to.

A table is a folder with ``data`` (partitions of the runs that wrote them), ``manifests`` (Parquet: which partition is
where, with its smallest and largest key and its number of rows), ``filters`` (a Bloom filter of each partition's keys, as
bitmaps) and ``versions`` (a numbered file each).  A version's file is created last, and never replaced: readers see the
version before or after a merge, a merge that breaks off leaves nothing that a reader finds, and of two merges at once one fails.

Partitions are months of a column, so that the rows of a window stay together, or (without such a column) a
hash of the key.  A key may move to another month: partitions that may hold a key of the batch are found by their bounds
and, if the batch is small beside them, by their filters, looked at by key columns alone, and rewritten if they do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .loading import deduplicated, exists, restated
from .scans import same

#: The column of a table's partitions, and the partition of rows without a time.  Labels begin with a letter, so that no reader takes them for dates.
PART, TIMELESS = "_part", "m-none"
#: Bits of a partition's filter for each of its keys, and bits of one bitmap.
BITS_A_KEY, BITMAP = 16, 32768
#: Filters are asked if the questions (keys of the batch times partitions), so many times, are fewer than the keys that could be read instead.
PROBE_COST = 16


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions_of(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that can be read."""
    fs, p = _hadoop(spark, f"{path}/versions")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []


def _version(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{path}/versions/{number:010d}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, number: int, version: dict) -> None:
    """Create the version's file; fails if it is there."""
    fs, p = _hadoop(spark, f"{path}/versions/{number:010d}")
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(version).encode()))
    out.close()


def _key(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k).cast("string") for k in keys])


def _positions(bits: str) -> Column:
    """Places of a key's hash in a filter of so many bits."""
    return F.array(F.pmod("_key", F.col(bits)), F.pmod(F.xxhash64("_key"), F.col(bits)))


def _filters(rows: DataFrame, keys: Sequence[str], counts: DataFrame) -> DataFrame:
    """``part, bits, bucket, bitmap``: a partition's keys in as many bits (a power of two) as its size asks for."""
    sized = counts.select(F.col("part").alias(PART), F.pow(F.lit(2), F.greatest(F.ceil(F.log2(F.col("n") * BITS_A_KEY)), F.lit(15))).cast("long").alias("bits"))
    placed = rows.select(PART, _key(keys).alias("_key")).join(F.broadcast(sized), PART).select(PART, "bits", F.explode(_positions("bits")).alias("_at"))
    bucket = F.floor(F.col("_at") / BITMAP).alias("bucket")
    return placed.groupBy(F.col(PART).alias("part"), "bits", bucket).agg(F.bitmap_construct_agg(F.pmod("_at", F.lit(BITMAP))).alias("bitmap"))


def _near(new: DataFrame, keys: Sequence[str], manifest: DataFrame, own: Sequence[str]) -> DataFrame:
    """``part``, ``run``, ``n``: partitions but for those of ``own`` whose bounds of the first key meet those of ``new``."""
    first = F.col(keys[0])
    bounds = new.agg(F.min(first).alias("_low"), F.max(first).alias("_high"), F.max(first.isNull()).alias("_nulls"))
    meet = (F.col("low") <= F.col("_high")) & (F.col("high") >= F.col("_low")) | F.col("nulls") & F.col("_nulls")
    return manifest.where(~F.col("part").isin(list(own))).crossJoin(F.broadcast(bounds)).where(F.coalesce(meet, F.lit(False))).select("part", "run", "n")


def _suspects(new: DataFrame, keys: Sequence[str], manifest: DataFrame, filters: DataFrame) -> DataFrame:
    """Partitions (``part``) that may hold a key of ``new``, by bounds of the first key and by filter."""
    lowest = new.select(_key(keys).alias("_key"), F.col(keys[0]).alias("_first")).distinct()
    sizes = filters.select("bits").distinct()  # powers of two
    asked = lowest.crossJoin(F.broadcast(sizes)).withColumn("_at", F.explode(_positions("bits")))
    asked = asked.select("_key", "_first", "bits", F.floor(F.col("_at") / BITMAP).alias("bucket"), F.pmod("_at", F.lit(BITMAP)).alias("_bit"))
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = asked.join(filters, ["bits", "bucket"]).withColumn("_byte", byte).where("shiftright(_byte, cast(_bit % 8 as int)) & 1 = 1")
    both = held.groupBy("part", "_key").agg(F.count("*").alias("_n"), F.first("_first").alias("_first"))  # a row for each of the two places
    bounded = both.join(F.broadcast(manifest.select("part", "low", "high", "nulls")), "part")
    inside = (F.col("_first") >= F.col("low")) & (F.col("_first") <= F.col("high")) | F.col("_first").isNull() & F.col("nulls")
    return bounded.where((F.col("_n") >= 2) & F.coalesce(inside, F.lit(False))).select("part").distinct()


def _folders(spark: SparkSession, path: str, schema: T.StructType, parts: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of partitions, given as (partition, run)."""
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{run}/{PART}={part}" for part, run in parts])


def merge_table(spark: SparkSession, batch: DataFrame, path: str, keys: Sequence[str], *, at: str | None = None, order: Sequence[str] = (), parts: int = 64) -> list[str]:
    """Restate the keys of ``batch`` in the table at ``path``; the partitions that were written.

    Null keys are keys; of a key's rows the one with the largest ``order`` counts (see ``deduplicated``).  ``at`` names the
    column whose months make the partitions of a new table.  Without changes to make (an empty batch) there is no new version,
    but for the first.
    """
    numbers = versions_of(spark, path)
    version = _version(spark, path, numbers[-1]) if numbers else {"schema": batch.schema.json(), "at": at, "parts": parts, "manifest": None}
    schema, at = T.StructType.fromJson(json.loads(version["schema"])), version["at"]
    label = F.coalesce(F.date_format(F.col(at), "'m'yyyy-MM"), F.lit(TIMELESS)) if at else F.concat(F.lit("h"), F.pmod(_key(keys), F.lit(version["parts"])).cast("string"))
    new = written(deduplicated(batch.select(*schema.names), keys, order).withColumn(PART, label), "merge")
    sizes = {r[0]: r[1] for r in new.groupBy(PART).agg(F.count("*")).collect()}  # months, or hashes
    own = set(sizes)
    if not own and numbers:
        return []
    run, manifest, before = uuid.uuid4().hex, None, {}
    if version["manifest"]:
        manifest, filters = spark.read.parquet(f"{path}/manifests/{version['manifest']}"), spark.read.parquet(f"{path}/filters")
        before = {r.part: r.run for r in manifest.select("part", "run").collect()}
        # a key never moves to another hash
        near = {r.part: r.n for r in _near(new, keys, manifest, own).collect()} if at and before.keys() - own else {}
        doubted = set(near)
        if near and sum(sizes.values()) * len(near) * PROBE_COST < sum(near.values()):
            live = filters.join(F.broadcast(manifest.where(F.col("part").isin(list(near))).select("part", "run")), ["part", "run"], "left_semi").drop("run")
            doubted = {r[0] for r in _suspects(new, keys, manifest, live).collect()}
        moved = set()
        if doubted:
            # of any number of runs, so the partition comes from the file's path
            part = F.regexp_extract("_metadata.file_path", f"/{PART}=([^/]+)/", 1).alias(PART)
            held = _folders(spark, path, schema, [(p, before[p]) for p in sorted(doubted)]).select(part, *keys)
            moved = {r[0] for r in held.join(new, same(held, new, keys), "left_semi").select(PART).distinct().collect()}
        touched = sorted(own | moved)
        old = _folders(spark, path, schema, [(p, before[p]) for p in touched if p in before])
        rows = restated(old, new.drop(PART), keys).withColumn(PART, label)
    else:
        touched, rows = sorted(own), new
    rows.repartitionByRange(PART, _key(keys)).write.partitionBy(PART).parquet(f"{path}/data/{run}")
    name = uuid.uuid4().hex
    kept = [(p, r) for p, r in before.items() if p not in touched]
    if own:
        back = spark.read.parquet(f"{path}/data/{run}").withColumn(PART, F.col(PART).cast("string"))
        counts = back.groupBy(F.col(PART).alias("part")).agg(F.count("*").alias("n"), F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high"), F.max(F.col(keys[0]).isNull()).alias("nulls")).withColumn("run", F.lit(run))
        counts = written(counts, "counts")
        rest = manifest.join(F.broadcast(spark.createDataFrame(kept, "part string, run string")), ["part", "run"], "left_semi") if kept else None
        (counts if rest is None else rest.select(*counts.columns).unionByName(counts)).write.parquet(f"{path}/manifests/{name}")
        _filters(back, keys, counts).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{path}/filters")
    _commit(spark, path, (numbers[-1] if numbers else 0) + 1, {**version, "manifest": name if own else None})
    return touched


def merge_state(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table at ``path`` in its latest version, or in that of a number."""
    numbers = versions_of(spark, path)
    if not numbers or number is not None and number not in numbers:
        raise ValueError(f"there is no such version at {path}")
    version = _version(spark, path, numbers[-1] if number is None else number)
    schema = T.StructType.fromJson(json.loads(version["schema"]))
    parts = [(r.part, r.run) for r in spark.read.parquet(f"{path}/manifests/{version['manifest']}").collect()] if version["manifest"] else []
    return _folders(spark, path, schema, parts)


def partitions(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """``part``, ``run``, ``n``: the partitions of a version, the merge that wrote each, and its rows."""
    version = _version(spark, path, versions_of(spark, path)[-1] if number is None else number)
    return spark.read.parquet(f"{path}/manifests/{version['manifest']}").select("part", "run", "n") if version["manifest"] else spark.createDataFrame([], "part string, run string, n long")


def restore_snapshot(spark: SparkSession, source: str, target: str, keys: Sequence[str]) -> DataFrame:
    """A merge table again from a snapshot: keys have to be unique there, and merging its own rows into it has to change nothing."""
    rows = spark.read.parquet(source)
    if not (bad := rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(5)).isEmpty():
        raise ValueError(f"keys are repeated: {bad.collect()}")
    if exists(spark, target):
        raise ValueError(f"{target} is there already")
    merge_table(spark, rows, target, keys)
    state = merge_state(spark, target)
    before, some = state.count(), state.where(F.pmod(_key(keys), F.lit(64)) == 0)
    merge_table(spark, some, target, keys)
    if merge_state(spark, target).count() != before:
        raise ValueError("merging rows into their own table changed it")
    return merge_state(spark, target)
