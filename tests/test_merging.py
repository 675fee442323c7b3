"""Merge tables: reruns, months, keys that move, and merges that break off."""

import datetime as dt

import pytest
from py4j.protocol import Py4JJavaError

from tidemart.operators import loading, merging
from tidemart.session import shared_path


def dated(spark, rows):
    return spark.createDataFrame([(k, v, None if m is None else dt.datetime(2024, m, 5)) for k, v, m in rows], "k long, v string, at timestamp_ntz")


def state(spark, path, number=None):
    return sorted(((r.k, r.v, r["at"].month if r["at"] else None) for r in merging.merge_state(spark, path, number).collect()), key=str)


def test_reruns_change_nothing_whatever_the_keys(spark):
    path, batch = shared_path(spark, "m"), dated(spark, [(None, "n", 1), (None, "m", 2), (1, "a", 1), (1, "b", 1), (2, "c", None)])
    for _ in range(3):
        merging.merge_table(spark, batch, path, ["k"], at="at", order=["v"])
    assert state(spark, path) == [(1, "b", 1), (2, "c", None), (None, "n", 1)]
    target = loading.merged(dated(spark, [(None, "old", 1), (3, "x", 1)]), batch, ["k"])
    for _ in range(2):
        target = loading.merged(target, batch, ["k"])
    assert sorted((str(r.k), r.v) for r in target.collect()) == [("1", "b"), ("2", "c"), ("3", "x"), ("None", "n")]
    found = {r.k: (r.n, r.n_different) for r in loading.conflicts(batch.unionByName(batch), ["k"]).collect()}
    assert found == {None: (4, 2), 1: (4, 2)}


def test_merge_writes_the_months_it_has_to(spark):
    path = shared_path(spark, "m")
    assert merging.merge_table(spark, dated(spark, [(k, "a", 1 + k % 12) for k in range(240)]), path, ["k"], at="at") == [f"m2024-{m:02}" for m in range(1, 13)]
    before = {r.part: r.run for r in merging.partitions(spark, path).collect()}
    assert merging.merge_table(spark, dated(spark, [(0, "b", 1), (999, "b", 1)]), path, ["k"]) == ["m2024-01"]
    after = {r.part: r.run for r in merging.partitions(spark, path).collect()}
    assert [p for p in before if before[p] != after[p]] == ["m2024-01"]
    # key 5 moves from June to March: both are written, and nothing else
    assert merging.merge_table(spark, dated(spark, [(5, "c", 3)]), path, ["k"]) == ["m2024-03", "m2024-06"]
    rows = state(spark, path)
    assert len(rows) == 241 and [r for r in rows if r[1] != "a"] == [(0, "b", 1), (5, "c", 3), (999, "b", 1)]
    assert len(state(spark, path, 1)) == 240 and merging.versions_of(spark, path) == [1, 2, 3]
    assert merging.merge_table(spark, dated(spark, []), path, ["k"]) == [] and merging.versions_of(spark, path) == [1, 2, 3]


def test_a_month_can_become_empty(spark):
    path = shared_path(spark, "m")
    merging.merge_table(spark, dated(spark, [(1, "a", 1), (2, "a", 2)]), path, ["k"], at="at")
    merging.merge_table(spark, dated(spark, [(1, "b", 2)]), path, ["k"])
    assert [r.part for r in merging.partitions(spark, path).collect()] == ["m2024-02"] and len(state(spark, path)) == 2


def test_broken_merges_leave_the_table_as_it_was(spark, monkeypatch):
    path = shared_path(spark, "m")
    merging.merge_table(spark, dated(spark, [(1, "a", 1), (2, "a", 2)]), path, ["k"], at="at")
    before = state(spark, path)
    commit = merging._commit
    for step in ("_commit", "_filters"):
        with monkeypatch.context() as m:
            m.setattr(merging, step, lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError, match="lost"):
                merging.merge_table(spark, dated(spark, [(1, "b", 3)]), path, ["k"])
        assert state(spark, path) == before
    with monkeypatch.context() as m:  # another merge was faster
        m.setattr(merging, "_commit", lambda s, p, n, v: commit(s, p, n - 1, v))
        with pytest.raises(Py4JJavaError):
            merging.merge_table(spark, dated(spark, [(1, "b", 3)]), path, ["k"])
    merging.merge_table(spark, dated(spark, [(1, "b", 3)]), path, ["k"])
    assert state(spark, path) == [(1, "b", 3), (2, "a", 2)]


def test_tables_without_a_time(spark):
    path = shared_path(spark, "m")
    assert len(merging.merge_table(spark, spark.range(1000).selectExpr("id", "'a' as v"), path, ["id"], parts=16)) == 16
    assert len(merging.merge_table(spark, spark.createDataFrame([(7, "b"), (5000, "b")], "id long, v string"), path, ["id"])) <= 2
    rows = merging.merge_state(spark, path)
    assert rows.count() == 1001 and rows.where("v = 'b'").count() == 2
    empty = shared_path(spark, "m")
    merging.merge_table(spark, rows.where("false"), empty, ["id"])
    assert merging.merge_state(spark, empty).count() == 0
    merging.merge_table(spark, rows, empty, ["id"])
    assert merging.merge_state(spark, empty).count() == 1001
    with pytest.raises(ValueError):
        merging.merge_state(spark, empty, 9)


def unasked(*_):
    raise AssertionError("filters are asked")


def test_large_batches_ask_no_filters(spark, monkeypatch):
    path = shared_path(spark, "m")
    merging.merge_table(spark, dated(spark, [(k, "a", 1 + k % 12) for k in range(240)] + [(None, "a", 2)]), path, ["k"], at="at")
    batch = dated(spark, [(k, "b", 12) for k in range(12, 60)] + [(None, "b", 12)])
    small = merging.merge_table(spark, dated(spark, [(5, "c", 12)]), path, ["k"])  # by filters
    with monkeypatch.context() as m:
        m.setattr(merging, "_suspects", unasked)
        assert merging.merge_table(spark, batch, path, ["k"]) == [f"m2024-{m:02}" for m in range(1, 13)]
    assert small == ["m2024-06", "m2024-12"]
    rows = {(k, month): v for k, v, month in state(spark, path)}
    assert len(rows) == 241 and rows[5, 12] == "c" and {k for (k, month), v in rows.items() if v == "b" and month == 12} == {None, *range(12, 60)}
    assert all(month == 1 + k % 12 for (k, month), v in rows.items() if v == "a")


@pytest.mark.parametrize("cost", [0, 10**9])
def test_filters_and_keys_find_the_same(spark, monkeypatch, cost):
    monkeypatch.setattr(merging, "PROBE_COST", cost)
    path = shared_path(spark, "m")
    merging.merge_table(spark, dated(spark, [(k, "a", 1 + k // 20) for k in range(240)] + [(None, "a", 11)]), path, ["k"], at="at")
    assert merging.merge_table(spark, dated(spark, [(5, "b", 3), (70, "b", 3), (9999, "b", 3), (None, "b", 3)]), path, ["k"]) == ["m2024-01", "m2024-03", "m2024-04", "m2024-11"]
    assert [r for r in state(spark, path) if r[1] == "b"] == [(5, "b", 3), (70, "b", 3), (9999, "b", 3), (None, "b", 3)]


def test_months_out_of_the_bounds_are_not_looked_at(spark, monkeypatch):
    path = shared_path(spark, "m")
    merging.merge_table(spark, dated(spark, [(k, "a", 1 + k // 20) for k in range(240)]), path, ["k"], at="at")
    monkeypatch.setattr(merging, "_suspects", unasked)
    assert merging.merge_table(spark, dated(spark, [(20, "b", 2), (39, "b", 2)]), path, ["k"]) == ["m2024-02"]
    assert len(state(spark, path)) == 240


def test_batches_are_deduplicated_once(spark, monkeypatch):
    path, seen = shared_path(spark, "m"), []
    merging.merge_table(spark, dated(spark, [(1, "a", 1), (2, "a", 2)]), path, ["k"], at="at")
    one = loading.deduplicated
    for module in (loading, merging):
        monkeypatch.setattr(module, "deduplicated", lambda *a: seen.append(a) or one(*a))
    merging.merge_table(spark, dated(spark, [(1, "b", 2), (1, "c", 1)]), path, ["k"], order=["v"])
    assert len(seen) == 1 and state(spark, path) == [(1, "c", 1), (2, "a", 2)]


def test_tables_in_hashes_ask_no_filters(spark, monkeypatch):
    path = shared_path(spark, "m")
    merging.merge_table(spark, spark.range(100).selectExpr("id", "'a' as v"), path, ["id"], parts=8)
    monkeypatch.setattr(merging, "_suspects", unasked)
    assert len(merging.merge_table(spark, spark.createDataFrame([(7, "b")], "id long, v string"), path, ["id"])) == 1
    assert merging.merge_state(spark, path).where("v = 'b'").count() == 1 and merging.merge_state(spark, path).count() == 100
