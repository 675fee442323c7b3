"""Sessions that see given tables and nothing else of the caller's.

A session made by ``newSession`` has views, functions and settings of its own.  The tables that it may read are put there as
views; paths can't be read as tables in it.  What all sessions share, the tables of the catalogue and global views, is for
whoever gives statements to such a session to keep out: see ``guard``.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


class Leak(RuntimeError):
    """A session that should be isolated can see what it shouldn't."""


def isolated(spark: SparkSession, tables: Mapping[str, DataFrame]) -> SparkSession:
    """A session with these tables as its only views, tried before it is handed out."""
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in tables.items():
        bridge = f"v{uuid.uuid4().hex}"  # a global view is the way from one session to another; it goes once the name is bound
        df.createGlobalTempView(bridge)
        try:
            session.table(f"global_temp.{bridge}").createOrReplaceTempView(name)
        finally:
            spark.catalog.dropGlobalTempView(bridge)
    tried(spark, session, set(tables))
    return session


def tried(spark: SparkSession, session: SparkSession, allowed: set[str]) -> None:
    """Raise ``Leak`` if ``session`` can read a view of ``spark`` that it wasn't given, or a path."""
    canary = f"v{uuid.uuid4().hex}"
    spark.range(1).createTempView(canary)
    try:
        for statement in (f"select * from {canary}", f"select * from parquet.`/{canary}`", f"select * from text.`/{canary}`"):
            try:
                session.sql(statement)
            except PySparkException as e:
                if "PATH_NOT_FOUND" in str(e):  # it went and looked
                    raise Leak(statement) from e
            else:
                raise Leak(statement)
    finally:
        spark.catalog.dropTempView(canary)
    if extra := {t.name for t in session.catalog.listTables() if t.isTemporary} - {a.lower() for a in allowed} - allowed:
        raise Leak(f"views that weren't given: {', '.join(sorted(extra))}")
