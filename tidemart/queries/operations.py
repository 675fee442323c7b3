"""Loads, exports, catalogues, accounts and small functions over the given tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fingerprint, human_bytes, qualified_name, strip_fences
from ..operators import enrichment as E
from ..operators import loading as L
from ..operators import merging as G
from ..operators.evaluation import compared, compared_in_order, fitted_total, overall
from ..operators.joining import excluding, suffixed_join
from ..operators.windows import plan
from ..plans import guard
from ..session import shared_path
from ..sources import files
from .aggregates import CONFUSION, _rated
from .registry import query


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _as_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


@query("s03_csv_with_mark", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    path = shared_path(t.spark, "csv")
    _as_csv(t["nation"].select(F.col("n_nationkey").alias("﻿n_nationkey"), "n_name"), path)
    return files.read_csv(t.spark, path, T.StructType([t["nation"].schema[c] for c in ("n_nationkey", "n_name")]))


@query("s04_csv_columns", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(t):
    path = shared_path(t.spark, "csv")
    _as_csv(t["supplier"], path)
    return files.read_csv(t.spark, path, t["supplier"].schema, ["s_suppkey", "s_acctbal"])


LISTED = ("nation", "orders", "part", "region")


@query("s10_catalogue", f"""WITH n AS ({' UNION ALL '.join(f"SELECT '{x}' AS name, count(*) AS held FROM {x}" for x in LISTED)})
SELECT table_name AS name, CAST(ordinal_position AS INTEGER) AS position, column_name, held FROM information_schema.columns JOIN n ON name = table_name""")
def _(t):
    tables = {name: t[name] for name in LISTED}
    listed = t.spark.createDataFrame([r[:3] for r in files.catalogue(tables)], "name string, position int, column_name string")
    held = _all([df.agg(F.count("*").alias("held")).select(F.lit(name).alias("name"), "held") for name, df in tables.items()])
    return listed.join(held, "name")


KEYS = {"nation": ["n_nationkey"], "orders": ["o_orderkey"], "labels": ["doc_id"], "lineitem": ["l_orderkey"]}


@query("s11_keys", " UNION ALL ".join(f"SELECT '{n}' AS name, '{', '.join(k)}' AS key, count(*) AS repeated FROM (SELECT {', '.join(k)} FROM {n} GROUP BY {', '.join(k)} HAVING count(*) > 1)" for n, k in KEYS.items()))
def _(t):
    from ..plans.quality import unique

    return _all([unique(t[n], *k).agg(F.count("*").alias("repeated")).select(F.lit(n).alias("name"), F.lit(", ".join(k)).alias("key"), "repeated") for n, k in KEYS.items()])


@query("s14_manifest", "SELECT o_orderstatus AS slice, count(*) AS n, count(*) AS loaded FROM orders GROUP BY 1")
def _(t):
    path, beside = shared_path(t.spark, "slices"), shared_path(t.spark, "manifest")
    t["orders"].write.partitionBy("o_orderstatus").parquet(path)
    written = {r[0]: r[1] for r in t["orders"].groupBy("o_orderstatus").agg(F.count("*")).collect()}  # a slice each
    files.write_manifest(t.spark, beside, written)
    owed = t.spark.createDataFrame(list(files.read_manifest(t.spark, beside).items()), "slice string, n long")
    loaded = L.slice_counts({"orders": path}, t.spark, "o_orderstatus")
    return owed.join(loaded.select("slice", F.col("n").alias("loaded")), "slice", "left")


@query("k02_create_once", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def _(t):
    path = shared_path(t.spark, "created")
    L.create_once(t["part"], path)
    L.create_once(t["part"].where("p_size < 10"), path)  # is there already
    return t.spark.read.parquet(path).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("k05_replace_reference", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def _(t):
    path = shared_path(t.spark, "reference")
    L.replace_reference(t["customer"], path)
    return L.replace_reference(t["customer"].where("c_acctbal > 0"), path).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("k06_markers", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(1 AS INTEGER) AS table_count, '{\"events\":' || count(*) || '}' AS row_counts, true AS is_stamped FROM events GROUP BY 1 UNION ALL SELECT '2030-01-01', 0, '{}', true")
def _(t):
    path = shared_path(t.spark, "markers")
    counts = t["events"].groupBy(F.to_date("ts").alias("slice_date")).agg(F.count("*").alias("n")).select("slice_date", F.lit("events").alias("name"), "n")
    L.mark_slices(counts.withColumn("n", F.lit(-1).cast("long")), path)
    L.mark_slices(counts, path)  # restates each
    L.mark_complete(t.spark, path, "2030-01-01", {})  # an empty slice is complete too
    return t.spark.read.parquet(path).select(F.col("slice_date").cast("string").alias("day"), "table_count", "row_counts", F.col("loaded_at").isNotNull().alias("is_stamped"))


@query("k11_restore_snapshot", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def _(t):
    snapshot = shared_path(t.spark, "snapshot")
    files.write_snapshot({"labels": t["labels"]}, snapshot)
    restored = G.restore_snapshot(t.spark, f"{snapshot}/labels", shared_path(t.spark, "restored"), ["doc_id"])
    return restored.groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("k12_export_manifest", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("nation", "supplier", "orders")))
def _(t):
    path = shared_path(t.spark, "export")
    files.write_manifest(t.spark, f"{path}-manifest", files.write_snapshot({n: t[n] for n in ("nation", "supplier", "orders")}, path))
    return t.spark.createDataFrame(list(files.read_manifest(t.spark, f"{path}-manifest").items()), "name string, n long")


@query("k15_wider_key", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(t):
    old = L.replace_reference(t["lineitem"].select("l_partkey", "l_suppkey", "l_orderkey"), shared_path(t.spark, "old"))
    return L.replace_reference(L.with_wider_key(old, ["l_partkey", "l_suppkey"]), shared_path(t.spark, "rebuilt"))


def _window_merged(t):
    """Orders, of which a late window restates some months and adds others, three times."""
    path, rows = shared_path(t.spark, "merged"), t["orders"].select("o_orderkey", F.col("o_orderstatus").alias("order_status"), "o_orderdate")
    G.merge_table(t.spark, rows.where(F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz")), path, ["o_orderkey"], at="o_orderdate")
    late = L.window_of(rows, "o_orderdate", "1998-01-01 00:00:00").withColumn("order_status", F.lit("restated"))
    for _ in range(3):  # reruns change nothing
        G.merge_table(t.spark, late, path, ["o_orderkey"])
    return path


@query("k17_merge_table", "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'restated' ELSE o_orderstatus END AS order_status FROM orders")
def _(t):
    return G.merge_state(t.spark, _window_merged(t)).select("o_orderkey", "order_status")


@query("k17_months_rewritten", "SELECT strftime(o_orderdate, 'm%Y-%m') AS part, count(*) AS n, o_orderdate >= TIMESTAMP '1998-01-01' AS is_rewritten FROM orders GROUP BY 1, 3")
def _(t):
    path = _window_merged(t)
    first = G.partitions(t.spark, path, 1).select("part", F.col("run").alias("_run"))
    return G.partitions(t.spark, path).join(first, "part", "left").select("part", "n", (~F.col("run").eqNullSafe(F.col("_run"))).alias("is_rewritten"))


@query("k17_moved_keys", "SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 1000 = 1 THEN o_orderdate + INTERVAL 3 MONTH ELSE o_orderdate END, '%Y-%m') AS month FROM orders")
def _(t):
    path, rows = shared_path(t.spark, "moved"), t["orders"].select("o_orderkey", "o_orderdate")
    G.merge_table(t.spark, rows, path, ["o_orderkey"], at="o_orderdate")
    later = rows.where("o_orderkey % 1000 = 1").withColumn("o_orderdate", F.col("o_orderdate") + F.expr("interval 3 month"))
    G.merge_table(t.spark, later, path, ["o_orderkey"])
    return G.merge_state(t.spark, path).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))


ODD_BATCH = "SELECT CASE WHEN doc_id % 5 > 0 THEN doc_id // 2 END AS doc_id, n_chars AS value, doc_id AS version FROM documents"


def _odd_batch(t):
    """Versions of documents under keys of which one is null and many are repeated."""
    return t["documents"].select(F.when(F.col("doc_id") % 5 > 0, F.expr("doc_id div 2")).alias("doc_id"), F.col("n_chars").alias("value"), F.col("doc_id").alias("version"))


@query("k07_upsert_odd_keys", f"WITH b AS ({ODD_BATCH}), n AS (SELECT doc_id, arg_max(value, version) AS value, max(version) AS version FROM b GROUP BY doc_id) SELECT * FROM n UNION ALL SELECT doc_id, quality, -1 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM n WHERE doc_id IS NOT NULL)")
def _(t):
    path = shared_path(t.spark, "upserted")
    G.merge_table(t.spark, t["labels"].select("doc_id", F.col("quality").cast("long").alias("value"), F.lit(-1).cast("long").alias("version")), path, ["doc_id"])
    for _ in range(3):  # reruns change nothing
        G.merge_table(t.spark, _odd_batch(t).withColumn("value", F.col("value").cast("long")), path, ["doc_id"], order=["version"])
    return G.merge_state(t.spark, path)


@query("k07_conflicts", f"SELECT doc_id, count(*) AS n, count(*) AS n_different FROM ({ODD_BATCH}) GROUP BY doc_id HAVING count(*) > 1")
def _(t):
    return L.conflicts(_odd_batch(t), ["doc_id"])


@query("p19_optional_filter", "SELECT 'all' AS asked, count(*) AS n FROM documents WHERE NULL IS NULL UNION ALL SELECT 'without src1', count(*) FROM documents WHERE source <> 'src1'")
def _(t):
    asked = {"all": None, "without src1": "src1"}
    return _all([excluding(t["documents"], "source", x).agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), "n") for name, x in asked.items()])


@query("j16_suffixed_join", "SELECT a.k AS nation, a.n AS n_customer, b.n AS n_supplier FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def _(t):
    counted = lambda df, key: df.groupBy(F.col(key).alias("nation")).agg(F.count("*").alias("n"))
    return suffixed_join(counted(t["customer"], "c_nationkey"), counted(t["supplier"], "s_nationkey"), ["nation"], "left", ("_customer", "_supplier"))


@query("a15_anchor_key", "SELECT o_custkey, as_of, count(*) AS n FROM orders CROSS JOIN (SELECT max(o_orderdate) AS as_of FROM orders) GROUP BY o_custkey, as_of")
def _(t):
    anchor = F.broadcast(t["orders"].agg(F.max("o_orderdate").alias("as_of")))
    return t["orders"].select("o_custkey").crossJoin(anchor).groupBy("o_custkey", "as_of").agg(F.count("*").alias("n"))


@query("a20_micro_macro", f"""WITH c AS ({CONFUSION}), s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
  round(coalesce(avg(tp::DOUBLE / nullif(tp + fp, 0)), 0), 6) AS macro_precision, round(coalesce(avg(tp::DOUBLE / nullif(tp + fn, 0)), 0), 6) AS macro_recall, round(coalesce(avg(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0)), 0), 6) AS macro_f1 FROM c)
SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS micro_precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS micro_recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS micro_f1 FROM s""")
def _(t):
    from ..operators.evaluation import confusion

    return overall(confusion(_rated(t), "source", "t", "g"))


@query("a24_fitted_total", """WITH s AS (SELECT octet_length(encode(text))::DOUBLE AS y, length(text)::DOUBLE AS x FROM documents WHERE text IS NOT NULL AND lang <> 'en'), w AS (SELECT count(*)::DOUBLE AS n, sum(length(text))::DOUBLE AS x FROM documents WHERE text IS NOT NULL),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 1)) AS sd FROM s)
SELECT round(b, 6) AS slope, round(a, 4) AS intercept, round(sd, 4) AS residual_sd, round(a * n + b * w.x, 0) AS total, round(a * n + b * w.x - 1.96::DOUBLE * sd * sqrt(n), 0) AS low, round(a * n + b * w.x + 1.96::DOUBLE * sd * sqrt(n), 0) AS high FROM f CROSS JOIN w""")
def _(t):
    docs = t["documents"].where("text is not null").select("lang", F.octet_length("text").cast("double").alias("y"), F.length("text").cast("double").alias("x"))
    found = fitted_total(docs.where("lang <> 'en'"), "y", "x", docs.agg(F.count("*").cast("double"), F.sum("x")))
    digits = {"slope": 6, "intercept": 4, "residual_sd": 4, "total": 0, "low": 0, "high": 0}
    return found.select(*[F.round(c, k).alias(c) for c, k in digits.items()])


@query("a25_value_counts", "SELECT 'lang' AS column_name, lang AS value, count(*) AS n, (SELECT count(DISTINCT lang) FROM documents) AS distinct_values FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), (SELECT count(DISTINCT source) FROM documents) FROM documents GROUP BY source")
def _(t):
    counted = lambda c: t["documents"].groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("column_name"), "value", "n")
    counts = counted("lang").unionByName(counted("source"))
    return counts.join(counts.groupBy("column_name").agg(F.count("value").alias("distinct_values")), "column_name")


@query("f08_fingerprint", "SELECT doc_id, substr(sha256(text), 1, 16) AS fingerprint FROM documents")
def _(t):
    return t["documents"].select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


@query("f11_strip_fences", "SELECT conv_id, turn, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS answer FROM conversations")
def _(t):
    fenced = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Here it is:\n```sql\n"), "text", F.lit("\n```\nand so on"))).otherwise(F.concat(F.lit(" \n"), "text"))
    return t["conversations"].select("conv_id", "turn", F.md5(strip_fences(fenced)).alias("answer"))


@query("f12_qualified_name", "SELECT n_nationkey, lower(r_name || '.' || n_name) AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    joined = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", qualified_name(F.concat_ws(".", F.lit("Catalog"), "r_name", "n_name")).alias("name"))


@query("f34_human_bytes", "SELECT source, CASE WHEN b < 1024 THEN printf('%.1f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576.0::DOUBLE) ELSE printf('%.1f GiB', b / 1073741824.0::DOUBLE) END AS size FROM (SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS b FROM documents GROUP BY source)")
def _(t):
    return t["documents"].groupBy("source").agg(F.sum(F.octet_length("text")).alias("b")).select("source", human_bytes(F.col("b")).alias("size"))


@query("v08_struct_to_array", "SELECT vec_id, len(embedding) AS size, CAST(embedding[1] AS DOUBLE) AS first_value, CAST(embedding[len(embedding)] AS DOUBLE) AS last_value FROM embeddings")
def _(t):
    listed = t["embeddings"].select("vec_id", F.transform("embedding", lambda x: F.struct(x.alias("element"))).alias("list"))
    plain = listed.select("vec_id", F.transform("list", lambda e: e["element"]).alias("v"))
    return plain.select("vec_id", F.size("v").cast("long").alias("size"), F.element_at("v", 1).cast("double").alias("first_value"), F.element_at("v", -1).cast("double").alias("last_value"))


@query("m04_window_counts", "SELECT CAST(CAST(CASE WHEN o_orderdate < TIMESTAMP '1998-06-01' THEN date_trunc('month', o_orderdate) ELSE date_trunc('day', o_orderdate) END AS DATE) AS VARCHAR) AS begins, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    import datetime as dt

    least, most = t["orders"].agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).first()
    windows = plan(least.replace(day=1), most + dt.timedelta(days=1), dt.date(1998, 6, 1)) if least else []
    planned = F.broadcast(t.spark.createDataFrame(windows, "begins date, ends date"))  # one row a month or day
    # a window holds no more than a month, so its month is a key to join on
    day = F.to_date("o_orderdate")
    inside = (F.trunc(day, "month") == F.trunc("begins", "month")) & (day >= F.col("begins")) & (day < F.col("ends"))
    return t["orders"].join(planned, inside).groupBy(F.col("begins").cast("string").alias("begins")).agg(F.count("*").alias("n"))


@query("m06_reconcile", "SELECT 'lineitem' AS name, '1994' AS slice, count(*) AS n, CAST(NULL AS BIGINT) AS loaded FROM lineitem WHERE year(l_shipdate) = 1994 HAVING count(*) > 0 UNION ALL SELECT 'orders', '1996', count(*), count(*) FILTER (o_orderpriority <> '1-URGENT') FROM orders WHERE year(o_orderdate) = 1996 HAVING count(*) FILTER (o_orderpriority = '1-URGENT') > 0")
def _(t):
    dated = {"orders": t["orders"].withColumn("y", F.year("o_orderdate")), "lineitem": t["lineitem"].withColumn("y", F.year("l_shipdate"))}
    owed = _all([df.groupBy(F.col("y").cast("string").alias("slice")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "slice", "n") for name, df in dated.items()])
    arrived = {"orders": dated["orders"].where("y <> 1996 or o_orderpriority <> '1-URGENT'"), "lineitem": dated["lineitem"].where("y <> 1994")}  # one slice short, one lost
    paths = {name: shared_path(t.spark, name) for name in arrived}
    for name, df in arrived.items():
        df.write.partitionBy("y").parquet(paths[name])
    return L.unreconciled(owed, L.slice_counts(paths, t.spark, "y"))


@query("m13_cost_log", "SELECT lang, CAST(count(*) FILTER (lang <> 'de') AS BIGINT) AS reviews, CAST(coalesce(sum(n) FILTER (lang <> 'de'), 0) AS BIGINT) AS input_tokens, round(coalesce(sum(n) FILTER (lang <> 'de'), 0) * 0.5::DOUBLE / 1e6, 9) AS cost_usd FROM (SELECT lang, text, length(text) AS n FROM documents WHERE text IS NOT NULL GROUP BY lang, text) GROUP BY lang")
def _(t):
    rows = t["documents"].where("text is not null").groupBy("lang", "text").agg(F.length("text").alias("tokens"))
    log = shared_path(t.spark, "cost-log")
    pending = rows.where("lang <> 'de'")  # those of one run are all in the cache
    E.accounted(rows, pending, "lang", F.col("tokens"), E.token_cost(F.col("tokens"), F.lit(0), F.lit(0.5), F.lit(0.0))).write.mode("append").parquet(log)
    return t.spark.read.parquet(log).withColumn("cost_usd", F.round("cost_usd", 9))


@query("m25_same_results", "SELECT 'other names' AS compared, count(DISTINCT o_orderstatus) AS n, true AS is_same FROM orders UNION ALL SELECT 'one row less', count(DISTINCT o_orderstatus), false FROM orders UNION ALL SELECT 'other order', count(DISTINCT o_orderstatus), count(DISTINCT o_orderstatus) < 2 FROM orders")
def _(t):
    by_status = t["orders"].groupBy("o_orderstatus")
    given = by_status.agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    other = by_status.agg(F.count("o_orderkey").alias("k"), (F.sum("o_totalprice") / F.count("*")).alias("v"))
    less = other.join(other.agg(F.max("o_orderstatus").alias("_last")), F.col("o_orderstatus") == F.col("_last"), "left_anti")
    found = {"other names": compared(given, other), "one row less": compared(given, less), "other order": compared_in_order(given, other, [F.asc("o_orderstatus")], [F.desc("o_orderstatus")])}
    return _all([df.select(F.lit(name).alias("compared"), F.col("n_a").alias("n"), "is_same") for name, df in found.items()])


@query("m25_same_rows", "SELECT 'other names' AS compared, count(*) AS n_a, count(*) AS n_b, true AS is_same FROM orders UNION ALL SELECT 'some rows less', count(*), count(*) FILTER (o_orderkey % 10 > 0), count(*) FILTER (o_orderkey % 10 = 0) = 0 FROM orders UNION ALL SELECT 'same order', count(*), count(*), true FROM orders UNION ALL SELECT 'other order', count(*), count(*), count(*) < 2 FROM orders")
def _(t):
    a = t["orders"].select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"))
    other = a.toDF("k", "status", "p").withColumn("p", F.col("p") + 1e-9)
    found = {
        "other names": compared(a, other), "some rows less": compared(a, other.where("k % 10 > 0")),
        "same order": compared_in_order(a, other, [F.asc("o_orderkey")], [F.asc("k")]), "other order": compared_in_order(a, other, [F.asc("o_orderkey")], [F.desc("k")]),
    }
    return _all([df.select(F.lit(name).alias("compared"), "n_a", "n_b", "is_same") for name, df in found.items()])


STATEMENTS = [
    ("SELECT count(*) FROM asked_orders", "SELECT count(*) FROM orders"),
    ("WITH a AS (SELECT o_custkey FROM asked_orders) SELECT count(DISTINCT o_custkey) FROM a", "SELECT count(DISTINCT o_custkey) FROM orders"),
    ("SELECT count(*) FROM (SELECT * FROM asked_orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM asked_orders)", "SELECT count(*) + count(*) FILTER (o_orderstatus = 'F') FROM orders"),
    ("SELECT count(*) FROM", None), ("SELECT 1; SELECT count(*) FROM asked_orders", None), ("DROP VIEW asked_orders", None), ("INSERT INTO asked_orders SELECT * FROM asked_orders", None), ("SELECT 1", None), ("SELECT count(*) FROM asked_lines", None),
    ("SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM asked_orders", None), ("SELECT count(*) FROM parquet.`/x`", None), ("EXPLAIN SELECT count(*) FROM asked_orders", None),
]


@query("g1_to_g8_statements", " UNION ALL ".join(f"SELECT {k}::BIGINT AS statement, {'true' if sql is None else 'false'} AS is_refused, {'CAST(NULL AS BIGINT)' if sql is None else f'({sql})'} AS answer" for k, (_, sql) in enumerate(STATEMENTS)))
def _(t):
    t["orders"].createOrReplaceTempView("asked_orders")
    out = []
    for k, (sql, _) in enumerate(STATEMENTS):
        try:
            asked = guard.guarded(t.spark, sql, {"asked_orders"}).toDF("answer")
            out.append(asked.select(F.lit(k).cast("long").alias("statement"), F.lit(False).alias("is_refused"), "answer"))
        except (PermissionError, SyntaxError):
            out.append(t.spark.range(1).select(F.lit(k).cast("long").alias("statement"), F.lit(True).alias("is_refused"), F.lit(None).cast("long").alias("answer")))
    return _all(out)


