"""Snapshots that answer questions by themselves: copies of tables in a session that sees nothing else."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..plans.guard import guarded
from ..plans.isolation import Leak, isolated
from .files import write_snapshot


@dataclass(frozen=True)
class Snapshot:
    session: SparkSession
    names: frozenset[str]

    def ask(self, sql: str, max_rows: int = 200) -> DataFrame:
        """The answer to one query over the snapshot's tables (see ``guard``)."""
        return guarded(self.session, sql, set(self.names), max_rows)


def take(tables: Mapping[str, DataFrame], folder: str) -> dict[str, int]:
    """Copy tables to ``folder``; the rows of each."""
    return write_snapshot(dict(tables), folder)


def open_snapshot(spark: SparkSession, folder: str, names: list[str]) -> Snapshot:
    """The tables of a snapshot in a session of their own, which is tried from inside before it is handed out."""
    session = isolated(spark, {n: spark.read.parquet(f"{folder}/{n}") for n in names})
    snapshot = Snapshot(session, frozenset(names))
    first = names[0]
    for what, sql in {
        "read a file": f"select * from parquet.`{folder}/{first}`", "change a setting": "set spark.sql.runSQLOnFiles=true", "read files again": "reset spark.sql.runSQLOnFiles",
        "write a table": f"create table written as select * from {first}", "write a folder": f"insert overwrite directory '{folder}' select * from {first}", "call Java": f"select java_method('java.lang.System', 'getProperty', 'user.dir') from {first}",
    }.items():
        try:
            snapshot.ask(sql)
        except (PermissionError, SyntaxError, PySparkException):
            continue
        raise Leak(f"a snapshot's session could {what}")
    return snapshot
