"""Keys with very many rows take another way to the same results."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemart.operators import history, scans

START = dt.datetime(2024, 1, 1)


def observed(spark, seed, n=900, keys=("a", "b", None, "c")):
    """Most rows have the first key; some times are equal, some attributes null."""
    rng = random.Random(seed)
    rows = [(keys[0] if rng.random() < 0.6 else rng.choice(keys), START + dt.timedelta(hours=rng.randrange(400)), i, rng.choice(["x", "x", "y", None])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, at timestamp_ntz, i int, v string")


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_versions_of_hot_keys(spark, seed):
    seen = observed(spark, seed).repartition(7)
    args = ("k", ["at", "i"], ["v"])
    assert scans.hot_keys(seen, ["k"], 100).count() >= 1
    for f in (history.numbered, history.versions, history.dimension):
        assert rows_of(f(seen, *args, hot_rows=100)) == rows_of(f(seen, *args)), f.__name__


@pytest.mark.parametrize("how", ["inner", "left"])
def test_asof_join_of_hot_keys(spark, how):
    seen = observed(spark, 5)
    dim = history.dimension(seen, "k", ["at", "i"], ["v"]).where("version_number % 7 <> 3")  # with gaps
    facts = observed(spark, 6, keys=("a", "b", "nobody", None)).select("k", "at", F.col("i").alias("fact"))
    assert rows_of(history.asof_join(facts, dim, "k", "at", how, hot_rows=100)) == rows_of(history.asof_join(facts, dim, "k", "at", how))


def test_hot_asof_join_makes_a_row_for_each_and_many_tasks(spark):
    facts = spark.range(20_000).select(F.lit("a").alias("k"), (F.lit(START).cast("timestamp_ntz") + F.expr("make_interval(0,0,0,0,0,0,id)")).alias("t"), "id")
    dim = history.dimension(facts.select("k", F.col("t").alias("at"), "id", (F.col("id") % 2).alias("v")), "k", ["at", "id"], ["v"], hot_rows=1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = history.asof_join(facts, dim, "k", "t", hot_rows=1000)
        assert joined.count() == 20_000 and joined.where("id + 1 <> version_number").isEmpty()
        assert joined.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_of_hot_keys(spark):
    seen = observed(spark, 9).withColumn("n", F.when(F.col("i") % 5 != 0, F.col("i")))
    w = Window.partitionBy("k").orderBy("at", "i").rowsBetween(Window.unboundedPreceding, 0)
    plain = seen.withColumn("s", F.coalesce(F.sum("n").over(w), F.lit(0)))
    got = scans.running_sums(seen, ["k"], ["at", "i"], {"s": "n"}, hot_rows=100)
    assert rows_of(got) == rows_of(plain)
