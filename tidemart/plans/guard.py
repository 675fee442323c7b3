"""A read-only SQL surface: one query over allowed tables with allowed functions, a row
limit on the whole result, a budget on what is scanned, and a timeout.

A statement is put in brackets as the source of an outer query, so only a query can be one: Spark's own parser refuses all else.  It is
analysed in a session whose only views are the allowed tables, so names are resolved by Spark, common table expressions
by their scope; neither another view nor a path is there to be found.  What sessions share can be recognised by its names: a
statement that names a catalogue's table, or ``global_temp``, is refused, and so are functions off the list.

``guarded`` gives a lazy DataFrame, so a question that passes can be looked at, counted
or joined like any other; ``answer`` runs it.  What is refused raises PermissionError
with the reason, what is no query at all SyntaxError.
"""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .isolation import isolated

#: Functions that a question about the marts can need, by Spark's names.
FUNCTIONS = {
    "avg", "count", "max", "min", "sum", "variance", "any_value", "median", "mode", "stddev", "approx_count_distinct", "percentile_cont",
    "row_number", "rank", "dense_rank", "ntile", "lag", "lead", "first_value", "last_value", "first", "last", "coalesce", "ifnull", "nullif", "if",
    "greatest", "least", "case", "when", "abs", "ceil", "ceiling", "floor", "round", "power", "sqrt", "exp", "ln", "log10", "log", "mod", "sign",
    "try_divide", "div", "concat", "lower", "upper", "trim", "ltrim", "rtrim", "length", "substr", "substring", "replace", "contains", "left",
    "right", "lpad", "rpad", "split", "startswith", "endswith", "format_string", "regexp_like", "regexp_extract", "regexp_replace", "string_agg",
    "listagg", "array_agg", "current_date", "current_timestamp", "date", "to_timestamp_ntz", "timestamp", "date_add", "date_sub", "datediff",
    "date_trunc", "extract", "date_format", "to_date", "unix_date", "year", "month", "day", "quarter", "dayofweek", "hour", "minute", "second",
    "weekofyear", "timestampdiff", "date_part", "cast", "try_cast", "to_char", "bool_or", "bool_and", "count_if",
}
#: Words of SQL, and its types, that a bracket can follow.
BEFORE_BRACKETS = {
    "select", "distinct", "from", "join", "where", "on", "using", "and", "or", "not", "in", "exists", "as", "over", "filter", "group", "by", "order", "partition", "within",
    "having", "union", "all", "except", "intersect", "minus", "lateral", "then", "else", "between", "like", "ilike", "rlike", "any", "some", "limit", "offset", "is", "null",
    "cube", "rollup", "sets", "pivot", "unpivot", "for", "interval", "with", "values", "decimal", "numeric", "char", "varchar", "struct", "array",
}
#: Names that Spark takes for functions without brackets, and the one of global views.
NEVER = {"current_user", "session_user", "user", "current_catalog", "current_database", "current_schema", "global_temp", "transform", "map", "reduce", "table", "identifier"}

#: Comments, strings (which take no part), quoted names, names, and single signs.
_TOKEN = re.compile(r"""(?P<skip>--[^\n]*|/\*.*?\*/|\s+)|(?P<string>[rR]?'(?:\\.|[^'\\])*'|[rR]?"(?:\\.|[^"\\])*")|`(?P<quoted>(?:``|[^`])*)`|(?P<name>[^\W\d]\w*)|(?P<number>[\w.]+)|(?P<sign>.)""", re.S)


def _tokens(sql: str) -> list[tuple[str, str]]:
    """Kind and (lower-case) text of all but comments and white space."""
    found = [(m.lastgroup, m[m.lastgroup].lower()) for m in _TOKEN.finditer(sql)]
    return [("name" if kind == "quoted" else kind, text) for kind, text in found if kind != "skip"]


def _faults(spark: SparkSession, sql: str, allowed: set[str]) -> list[str]:
    tokens = [("", ""), *_tokens(sql), ("", "")]
    names = {text for kind, text in tokens if kind == "name"}
    # a name before a bracket is a function's, or an alias of which columns are listed: one that no function has can only be that
    called = {(text, before == ".") for (_, before), (kind, text), (_, after) in zip(tokens, tokens[1:], tokens[2:]) if kind == "name" and after == "("}
    odd = {(text, qualified) for text, qualified in called if text not in FUNCTIONS | BEFORE_BRACKETS}
    known = {f.name.lower().rpartition(".")[2] for f in spark.catalog.listFunctions()} if odd else set()
    catalogued = {t.name.lower() for db in spark.catalog.listDatabases() for t in spark.catalog.listTables(db.name) if not t.isTemporary}
    out = {
        "functions": {text for text, qualified in odd if qualified or text in known},
        "names": names & (NEVER | (catalogued - allowed)),
        "scripts": {"using" for (_, text), (after, _) in zip(tokens, tokens[1:]) if text == "using" and after == "string"},
    }
    return [f"{what} that aren't allowed: {', '.join(sorted(bad))}" for what, bad in out.items() if bad]


def guarded(spark: SparkSession, sql: str, tables: set[str], max_rows: int = 200) -> DataFrame:
    """The result of ``sql``, at most ``max_rows`` rows of it, if it is one query over ``tables`` (views or tables of ``spark``)."""
    allowed = {t.lower() for t in tables}
    if faults := _faults(spark, sql, allowed):
        raise PermissionError("; ".join(faults))
    if not allowed & {text for kind, text in _tokens(sql) if kind == "name"}:
        raise PermissionError(f"no table is read; there are {', '.join(sorted(allowed))}")
    session = isolated(spark, {t: spark.table(t) for t in tables})
    try:
        return session.sql(f"SELECT * FROM (\n{sql}\n) LIMIT {int(max_rows)}")
    except ParseException as e:
        raise SyntaxError(str(e)[:200]) from e
    except AnalysisException as e:
        raise PermissionError(f"{str(e)[:200]}; there are {', '.join(sorted(allowed))}") from e


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of all files below ``df``: what a scan of them reads at most."""
    files = df.inputFiles()
    return df.sparkSession.read.format("binaryFile").load(files).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] if files else 0


@dataclass
class Budget:
    """What all questions of one user may scan together; one of ``usual_bytes`` could be asked ``max_bytes // usual_bytes`` times."""

    #: 5 GiB, and 435 MiB for a question.
    max_bytes: int = 5 << 30
    usual_bytes: int = 435 << 20
    spent_bytes: int = 0
    asked: int = 0

    def spend(self, n: int) -> None:
        if self.asked >= self.max_bytes // self.usual_bytes:
            raise PermissionError(f"{self.asked} questions were asked, and no more are allowed")
        if self.spent_bytes + n > self.max_bytes:
            raise PermissionError(f"{self.spent_bytes} bytes were scanned; {n} more exceed {self.max_bytes}")
        self.spent_bytes, self.asked = self.spent_bytes + n, self.asked + 1


def answer(question: DataFrame, *, max_bytes: int = 1 << 30, seconds: float = 10.0, budget: Budget | None = None) -> list:
    """The rows of a guarded question, within a budget of scanned bytes and of time."""
    if (n := scanned_bytes(question)) > max_bytes:
        raise PermissionError(f"it would scan {n} bytes; {max_bytes} are allowed")
    if budget is not None:
        budget.spend(n)
    context, tag, late = question.sparkSession.sparkContext, f"guard-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return question.collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
