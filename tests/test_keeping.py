"""Samples, sketches, JSON lines and snapshots against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.operators import sampling, sketches
from tidemart.plans.isolation import Leak
from tidemart.session import shared_path
from tidemart.sources import json_lines, snapshots


def plain_order(i, seed):
    return hashlib.md5(f"{i}-{seed}".encode()).hexdigest(), i


@pytest.mark.parametrize("n", [0, 1, 7, 500, 999, 1000, 5000])
def test_samples_of_any_size(spark, monkeypatch, n):
    monkeypatch.setattr(sampling, "RANKED", 3)
    monkeypatch.setattr(sampling, "DIGITS", 1)
    got = {r.id for r in sampling.seeded_sample(spark.range(1000), n, "id", 4).collect()}
    assert got == set(sorted(range(1000), key=lambda i: plain_order(i, 4))[:n])


def test_samples_with_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANKED", 3)
    rows = spark.range(50).select(F.lit(1).cast("long").alias("id")).unionByName(spark.range(5))
    assert sampling.seeded_sample(rows, 20, "id").count() == 20 and sampling.seeded_sample(rows.where("false"), 20, "id").isEmpty()


def plain_cover(rows, deficits, most, seed):
    """One row at a time: the largest gain, the first by hash."""
    left, picked = dict(deficits), []
    pool = sorted(rows, key=lambda r: plain_order(r[0], seed))
    while len(picked) < most and any(n > 0 for n in left.values()):
        gains = [sum(left.get(a, 0) > 0 for a in labels) for _, labels in pool]
        if not gains or max(gains) == 0:
            break
        i, labels = pool.pop(gains.index(max(gains)))
        picked.append(i)
        for a in labels:
            if left.get(a, 0) > 0:
                left[a] -= 1
    return picked


@pytest.mark.parametrize("seed", range(3))
def test_cover_is_plain_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [(i, sorted({rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 1, 2, 4]))})) for i in range(300)]
    deficits = {a: rng.randrange(0, 12) for a in "abcdefgz"}
    df = spark.createDataFrame(rows, "id long, labels array<string>")
    for most in (1000, 9):
        assert sampling.covering(df, deficits, "id", "labels", most, seed) == plain_cover(rows, deficits, most, seed)


def test_deficit_sample(spark):
    rows = [(i, ["common", *(["rare"] if i % 50 == 0 else []), *(["seldom"] if i % 100 == 1 else [])]) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, labels array<string>")
    drawn = sampling.deficit_sample(df, 80, id_col="id", labels="labels", random_share=0.5, floor=10, seed=2)
    got = {r.id: r.stratum for r in drawn.collect()}
    have = {a: sum(a in labels for i, labels in rows if i in got) for a in ("common", "rare", "seldom")}
    assert len(got) == 80 and have["rare"] >= 10 and have["seldom"] == 10 and list(got.values()).count("random") == 40
    assert sampling.deficit_sample(df.where("false"), 80, id_col="id", labels="labels").isEmpty()


def test_counts_merge_over_slices(spark):
    rows = spark.range(5000).select((F.col("id") % 9).alias("day"), (F.col("id") * 7 % 3001).alias("u"), F.when(F.col("id") % 3 > 0, F.col("id") % 40).alias("v"))
    first = rows.where("day < 5")
    numbers = sketches.dictionary(rows, "day", ["u", "v"], sketches.dictionary(first, "day", ["u", "v"]))
    assert numbers.select("number").distinct().count() == numbers.count()
    maps = sketches.bitmaps(rows, "day", ["u", "v"], numbers)
    for some in ("day in (1, 7)", "true", "false"):
        exact = {r.column: r.n for r in sketches.exact_counts(maps.where(some.replace("day", "slice"))).collect()}
        plain = rows.where(some).agg(F.count_distinct("u").alias("u"), F.count_distinct("v").alias("v")).first().asDict()
        assert exact == {c: n for c, n in plain.items() if n}
    about = {r.column: r.n for r in sketches.estimated_counts(sketches.sketches(rows, "day", ["u", "v"])).collect()}
    assert about["v"] == 40 and abs(about["u"] - 3001) < 150


def test_json_lines(spark, tmp_path):
    schema = T.StructType([T.StructField("i", T.LongType(), False), T.StructField("at", T.TimestampNTZType()), T.StructField("x", T.DoubleType())])
    lines = ['{"i": 1, "x": 2.5, "more": [1]}', '{"i": "2"}', "{", "", '{"x": 1}', '{"i": null}', "[]", "null", '{"i": 3, "x": "a"}', '{"i": 4, "at": "2024-01-02 03:04:05"}', '{"i": 5, "at": "soon"}', "7"]
    (tmp_path / "in.txt").write_text("\n".join(lines))
    table, rejects = shared_path(spark, "t"), shared_path(spark, "r")
    for _ in range(2):
        json_lines.ingest(spark, str(tmp_path / "in.txt"), schema, table, rejects, "a")
    json_lines.ingest(spark, str(tmp_path / "in.txt"), schema, table, rejects, "b")
    good = spark.read.schema(schema).parquet(f"{table}/batch=a").orderBy("i").collect()
    assert [(r.i, r.x, str(r["at"])) for r in good] == [(1, 2.5, "None"), (2, None, "None"), (4, None, "2024-01-02 03:04:05")]
    bad = [(r.line, r.reason) for r in spark.read.parquet(f"{rejects}/batch=a").orderBy("place").collect()]
    assert bad == [("{", "not JSON"), ('{"x": 1}', "i: missing"), ('{"i": null}', "i: missing"), ("[]", "not an object"), ("null", "not an object"), ('{"i": 3, "x": "a"}', "x: not double"), ('{"i": 5, "at": "soon"}', "at: not timestamp_ntz"), ("7", "not an object")]
    assert spark.read.parquet(table).count() == 6


def test_snapshot_sees_nothing_else(spark, monkeypatch):
    folder = shared_path(spark, "snapshot")
    snapshots.take({"a": spark.range(3), "b": spark.range(4)}, folder)
    spark.range(9).createOrReplaceTempView("callers")
    snapshot = snapshots.open_snapshot(spark, folder, ["a", "b"])
    assert snapshot.ask("select count(*) as n from a join b using (id)").first().n == 3
    for sql in ("select * from callers", f"select * from parquet.`{folder}/a`", "set spark.sql.ansi.enabled=false", "drop view a"):
        with pytest.raises((PermissionError, SyntaxError)):
            snapshot.ask(sql)
    monkeypatch.setattr(snapshots.Snapshot, "ask", lambda self, sql, n=1: self.session.sql(sql))
    with pytest.raises(Leak):
        snapshots.open_snapshot(spark, folder, ["a", "b"])
