"""Every registered query with SQL gives DuckDB's rows."""

import duckdb
import pandas as pd
import pytest

from tidemart.queries import QUERIES, SQL
from tidemart.sources.files import TABLES


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(x):
        return None if x is None or (not isinstance(x, (list, tuple)) and pd.isna(x)) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted(str([plain(x) for x in r]) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, folder, duck, name):
    got, expected = QUERIES[name](spark, folder).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_point_without_optional_parts(spark, folder):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() == spark.read.parquet(f"{folder}/events.parquet").count()
