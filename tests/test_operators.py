import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tidemart.operators import enrichment, evaluation, history, joining, loading, merging, ranking, segments
from tidemart.plans import models, quality
from tidemart.session import shared_path

OBSERVATIONS = [("a", 1, 1, "x"), ("a", 2, 2, "x"), ("a", 3, 3, "y"), ("a", 3, 4, "y"), ("a", 5, 5, "x"), ("b", 2, 6, None), ("b", 4, 7, "z")]


def observed(spark):
    rows = [(k, dt.datetime(2024, 1, d), i, v) for k, d, i, v in OBSERVATIONS]
    return spark.createDataFrame(rows, "k string, at timestamp_ntz, i int, v string")


def test_dimension_is_half_open_and_complete(spark):
    dim = history.dimension(observed(spark), "k", ["at", "i"], ["v"])
    assert sorted((r["k"], r["version_number"], r["v"], r["observations_in_version"], r["is_current"]) for r in dim.drop("valid_to").collect()) == [("a", 1, "x", 2, False), ("a", 2, "y", 2, False), ("a", 3, "x", 1, True), ("b", 1, None, 1, False), ("b", 2, "z", 1, True)]
    for check in (quality.no_overlap(dim, "k"), quality.one_current(dim, "k"), quality.reconciled(dim, observed(spark)), quality.unique(dim, "sk")):
        assert check.isEmpty()
    longer = dim.withColumn("valid_to", F.col("valid_to") + F.expr("interval 1 second")).where("not is_current").unionByName(dim.where("is_current"))
    assert quality.no_overlap(longer, "k").count() == 3 and quality.one_current(dim.where("not is_current"), "k").count() == 2
    assert quality.reconciled(dim.where("is_current"), observed(spark)).count() == 1
    cased = observed(spark).withColumn("raw", F.when(F.col("i") % 2 == 0, F.upper("v")).otherwise(F.col("v")))
    assert quality.same_boundaries(cased, "k", ["at", "i"], ["raw"], ["v"]).count() == 1 and quality.same_boundaries(cased, "k", ["at", "i"], ["v"], ["v"]).isEmpty()


def test_asof_join_reaches_back_and_keeps_grain(spark):
    dim = history.dimension(observed(spark), "k", ["at", "i"], ["v"])
    facts = spark.createDataFrame([("a", dt.datetime(1999, 1, 1)), ("a", dt.datetime(2024, 1, 3)), ("a", dt.datetime(2030, 1, 1)), ("b", dt.datetime(2024, 1, 3))], "k string, t timestamp_ntz")
    assert [r["version_number"] for r in history.asof_join(facts, dim, "k", "t").orderBy("k", "t").collect()] == [1, 2, 3, 1]


def test_global_ranks(spark):
    df = spark.range(103).withColumn("v", F.col("id") % 7)
    got = ranking.global_ntile(df, 5, [F.desc("v"), F.asc("id")], "g").orderBy(F.desc("v"), "id")
    sizes = [r["n"] for r in got.groupBy("g").agg(F.count("*").alias("n")).orderBy("g").collect()]
    assert sizes == [21, 21, 21, 20, 20] and [r["g"] for r in got.collect()] == sorted(r["g"] for r in got.collect())
    assert ranking.global_ntile(df.where("false"), 5, [F.asc("id")], "g").isEmpty()
    assert [r["p"] for r in ranking.global_row_number(df, [F.asc("id")], "p").orderBy("id").collect()] == list(range(1, 104))


def test_grid_refuses_too_many_cells(spark):
    with pytest.raises(ValueError):
        segments.complete_grid(spark.range(100), spark.range(100).withColumnRenamed("id", "j"), limit=1000)


def test_loads_are_idempotent(spark):
    path = shared_path(spark, "t")
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01")], "i int, day string")
    assert [loading.replace_slice(rows, path, "day", "2024-01-01") for _ in range(2)] == [2, 2]
    assert loading.replace_slice(rows.where("i = 1"), path, "day", "2024-01-02") == 1
    assert loading.replace_slice(rows.where("false"), path, "day", "2024-01-01") == 0
    assert spark.read.parquet(path).count() == 1


def test_restore_refuses_repeated_keys(spark):
    source = shared_path(spark, "snapshot")
    spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string").write.parquet(source)
    with pytest.raises(ValueError, match="repeated"):
        merging.restore_snapshot(spark, source, shared_path(spark, "target"), ["k"])


def test_overall_figures(spark):
    counts = spark.createDataFrame([("a", 8, 2, 0), ("b", 1, 0, 3), ("c", 0, 0, 0)], "label string, tp int, fp int, fn int")
    r = evaluation.overall(counts).first()
    assert (r.tp, r.fp, r.fn, r.micro_precision, r.micro_recall, r.macro_precision, r.macro_recall) == (9, 2, 3, 0.818182, 0.75, 0.9, 0.625)
    none = evaluation.overall(counts.where("label = 'c'")).first()
    assert (none.micro_f1, none.macro_f1) == (0.0, 0.0)


def test_batches_inside_groups(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 70, "a").when(F.col("id") < 90, None).otherwise("b").alias("g"), "id")
    got = {r.id: r.batch for r in ranking.batched(rows, 8, "g", "id").collect()}
    assert got == {i: (i if i < 70 else i - 70 if i < 90 else i - 90) // 8 for i in range(100)}


def test_excluding_and_suffixes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert joining.excluding(df, "v", None).count() == 2 and joining.excluding(df, "v", "b").count() == 1 and joining.excluding(df, "v", "a").count() == 0
    assert joining.suffixed_join(df, df, ["k"]).columns == ["k", "v_x", "v_y"]


def test_markers(spark):
    path = shared_path(spark, "markers")
    assert loading.missing_slices(spark, path, ["2024-01-01"]) == ["2024-01-01"]
    loading.mark_complete(spark, path, "2024-01-01", {})
    loading.mark_complete(spark, path, "2024-01-01", {"orders": 3})
    assert loading.missing_slices(spark, path, ["2024-01-01", "2024-01-02"]) == ["2024-01-02"]
    assert spark.read.parquet(path).count() == 1


def test_any_number_of_days_without_marker(spark):
    path = shared_path(spark, "markers")
    days = spark.range(4500).select(F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("day"))
    assert loading.without_marker(spark, path, days, "day").count() == 4500
    loading.mark_complete(spark, path, "2010-01-02", {})
    left = loading.without_marker(spark, path, days, "day")
    assert left.count() == 4499 and left.where("day = '2010-01-02'").isEmpty()


def test_queries_hold_more_days_and_types_than_fit_a_list(spark):
    from tidemart.queries import QUERIES

    event_type = F.when(F.col("id") % 13 == 0, "error").otherwise(F.concat(F.lit("t"), (F.col("id") % 1500).cast("string")))
    day = F.date_add(F.lit("2010-01-01").cast("date"), (F.col("id") % 4500).cast("int")).cast("timestamp_ntz")
    folder = shared_path(spark, "tables")
    rows = spark.range(1, 5001).select(F.col("id").alias("event_id"), day.alias("ts"), (F.col("id") % 3 * 5).alias("user_id"), event_type.alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.write.parquet(f"{folder}/events.parquet")
    even = sum((dt.date(2010, 1, 1) + dt.timedelta(days=k)).day % 2 == 0 for k in range(4500))
    assert QUERIES["m08_missing_slices"](spark, folder).count() == even > 2000
    reason = lambda i: "unparseable" if i % 3 * 5 % 10 == 0 else "missing" if i % 11 == 0 else "unknown_aspect" if i % 13 == 0 else "bad_sentiment" if i % 7 == 0 else "bad_severity" if i % 5 == 0 else None
    assert {(r["batch"], r["i"], r["reason"]) for r in QUERIES["m11_quarantine"](spark, folder).collect()} == {(i % 3 * 5, i, reason(i)) for i in range(1, 5001)}


def test_more_queries_than_are_broadcast(spark, monkeypatch):
    rows = [(i, [float((i * k) % 17 - 8) for k in (3, 5, 7, 11)]) for i in range(1, 120)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    top = lambda: sorted(map(tuple, ranking.vector_topk(df, df.where("id % 3 = 0"), 4, id_col="id", vector_col="v").collect()))
    whole = top()
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ranking, "VECTOR_BLOCK", 25)
    assert top() == whole and len(whole) == 39 * 4


def test_quarantine_reasons(spark):
    def label(i, aspects='["a"]', sentiment="neutral", severity="1"):
        return f'{{"i":{i},"aspects":{aspects},"sentiment":"{sentiment}","severity":"{severity}","no_content":false}}'

    good = "[" + ",".join([label(1), label(2, '["zzz"]'), label(3, sentiment="furious"), label(4, severity="high"), label(1, '["b"]'), label(9)]) + "]"
    responses = spark.createDataFrame([(1, good), (2, "not json")], "batch int, response string")
    items = spark.createDataFrame([(1, i, str(i)) for i in range(1, 6)] + [(2, 1, "x")], "batch int, i int, content_hash string")
    got = sorted((r["batch"], r["i"], r["reason"] or "") for r in enrichment.checked_labels(responses, items, ["a", "b"]).collect())
    assert got == [(1, 1, ""), (1, 1, "duplicate"), (1, 2, "unknown_aspect"), (1, 3, "bad_sentiment"), (1, 4, "bad_severity"), (1, 5, "missing"), (1, 9, "out_of_range"), (2, 1, "unparseable")]


def test_same_results(spark):
    frame = lambda rows, names="k, v": spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names.split(", "), ("double", "string"))))
    same = lambda df: df.first().is_same
    a = frame([(1.0, "a"), (2.0, "b"), (None, None)])
    assert same(evaluation.compared(a, frame([(None, None), (2.0, "b"), (1.0000000001, "a")], "x, y")))
    assert not same(evaluation.compared(a, frame([(None, "null"), (2.0, "b"), (1.0, "a")])))
    assert not same(evaluation.compared(frame([(1.0, "a")]), frame([(1.0, "a"), (1.0, "a")]))) and same(evaluation.compared(a.where("false"), a.where("false")))
    one, two = frame([(1.0, "a"), (2.0, "b")]), frame([(2.0, "b"), (1.0, "a")])
    assert same(evaluation.compared_in_order(one, two, [F.asc("k")], [F.asc("k")])) and not same(evaluation.compared_in_order(one, two, [F.asc("k")], [F.desc("k")]))


def test_models_stop_at_a_failed_check(spark):
    plan = {"a": models.Model(lambda t: t["src"].where("id > 2"), table=True), "b": models.Model(lambda t: t["a"].selectExpr("id * 2 as id"), checks=(lambda df: quality.holds(df, F.col("id") > 6),))}
    with pytest.raises(models.FailedCheck):
        models.build({"src": spark.range(5)}, plan)
    assert models.build({"src": spark.range(4, 9)}, plan)["b"].count() == 5


def test_checks_find_what_breaks_them(spark):
    df = spark.createDataFrame([(1, "x"), (1, None), (2, "ä")], "k int, v string")
    assert quality.unique(df, "k").count() == 1 and quality.not_null(df, "v").count() == 1
    assert quality.accepted(df, "v", ["x"]).count() == 1 and quality.ascii_only(df, "v").count() == 1
    assert quality.related(df, "k", spark.range(2), "id").count() == 1
    assert quality.single_provenance(df.where("false"), {"v": "x"}).count() == 1
    assert quality.same_grain(df, spark.range(2)).count() == 1


def test_stream_of_slices_keeps_late_rows(spark, tmp_path):
    from tidemart.streaming.slices import merge_arrivals

    source, target, at = str(tmp_path / "in"), str(tmp_path / uuid.uuid4().hex), str(tmp_path / "cp")
    put = lambda rows: spark.createDataFrame(rows, "k int, t int, v string").write.mode("append").parquet(source)
    put([(1, 5, "a"), (2, 5, "b")])
    schema = spark.read.parquet(source).schema
    merge_arrivals(spark, source, schema, target, at, ["k"], ["t"])
    put([(2, 1, "late"), (3, 1, "c"), (3, 2, "d")])
    merge_arrivals(spark, source, schema, target, at, ["k"], ["t"])
    assert sorted(map(tuple, merging.merge_state(spark, target).collect())) == [(1, 5, "a"), (2, 1, "late"), (3, 2, "d")]


def test_a_block_of_vectors_holds_a_tile_of_scores():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n = ranking.VECTOR_BLOCK
    x = np.random.default_rng(3).integers(1, 9, (n, 2)).astype(float)
    table = lambda name, k: pa.table({name: pa.array(range(k), pa.int64()), "x": pa.array(list(x[:k]), pa.list_(pa.float64())), "norm": np.sqrt((x[:k] * x[:k]).sum(axis=1))})
    v, q = table("vec_id", n), table("query_id", ranking.TILE)
    tracemalloc.start()
    got = ranking._block_topk(v, q, 5).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    scores = (x[7, 0] * x[:, 0] + x[7, 1] * x[:, 1]) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[7] * x[7]).sum()))
    expected = sorted((-s, i) for i, s in enumerate(scores) if i != 7)[:5]
    assert [i for own, i in zip(got["query_id"], got["vec_id"]) if own == 7] == [i for _, i in expected]


def test_vectors_of_different_sizes_are_refused():
    import pyarrow as pa

    odd = pa.table({"vec_id": [1, 2], "x": [[1.0], [1.0, 2.0, 3.0]], "norm": [1.0, 1.0]})
    with pytest.raises(ValueError):
        ranking._block_topk(odd, odd.rename_columns(["query_id", "x", "norm"]), 2)
