import datetime as dt
import json

import pytest
from pyspark.sql import types as T

from tidemart.operators.windows import covered, distinct_places, plan, reconciled
from tidemart.sources import files


def test_csv_with_mark_and_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('﻿id,text,n\n1,"two\nlines, ""quoted""",3\n2,,\n'.encode())
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])
    rows = files.read_csv(spark, str(path), schema)
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(1, 'two\nlines, "quoted"', 3), (2, None, None)]
    assert files.verified_count(rows, 2) is rows
    with pytest.raises(ValueError):
        files.verified_count(rows, 3)


def test_snapshot_and_manifest(spark, tmp_path):
    counts = files.write_snapshot({"a": spark.range(5), "b": spark.range(0)}, str(tmp_path / "s"))
    assert counts == {"a": 5, "b": 0}
    files.write_manifest(spark, str(tmp_path / "m"), counts)
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == counts == files.read_manifest(spark, str(tmp_path / "m"))
    assert files.catalogue({"b": spark.range(1), "a": spark.range(1).selectExpr("id", "'x' as s")}) == [("a", 1, "id", "bigint"), ("a", 2, "s", "string"), ("b", 1, "id", "bigint")]
    assert files.frozen_schema(spark.range(1))["fields"][0]["name"] == "id"


def test_window_plan():
    d = dt.date
    months = plan(d(2018, 1, 1), d(2018, 4, 1))
    assert len(months) == 3
    full = plan(d(2016, 9, 1), d(2018, 10, 18), d(2018, 9, 17))
    assert 50 <= len(full) <= 60 and full[0][0] == d(2016, 9, 1) and full[-1][1] == d(2018, 10, 18)
    assert all(a[1] == b[0] for a, b in zip(full, full[1:]))
    assert plan(d(2018, 2, 1), d(2018, 1, 1)) == []


def test_coverage():
    d = dt.date
    assert covered(d(2018, 11, 1), d(2018, 12, 1), d(2018, 10, 17)) == [] and covered(d(2018, 10, 1), d(2018, 12, 1), d(2018, 10, 17)) == [(d(2018, 10, 1), d(2018, 10, 18))]
    with pytest.raises(ValueError):
        covered(d(2018, 2, 1), d(2018, 1, 1), d(2018, 10, 17))
    distinct_places(raw="a", marts="b")
    with pytest.raises(ValueError):
        distinct_places(raw="a", marts="a")


def test_reconcile():
    assert reconciled({"orders": 3, "items": 2, "none": 0}, {"orders": 3, "items": 1}) == ["items", "none"]
