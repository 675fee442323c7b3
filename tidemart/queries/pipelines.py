"""Slices, merges, enrichment and quarantine over whole tables."""

from pyspark.sql import functions as F

from ..operators import enrichment as E
from ..operators.loading import consistent_slice, mark_slices, merged, replace_slice, window_of, without_marker
from ..plans import marts as M
from ..session import shared_path
from .registry import query

#: Event ids that one response of m11 spans.
BATCH_IDS = 1000


@query("m01_incremental_merge", "SELECT o_orderkey AS order_id, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'restated' ELSE o_orderstatus END AS order_status FROM orders")
def _(t):
    rows = M.stg_orders(t).select("order_id", "order_status", "ordered_at")
    target = rows.where(F.col("ordered_at") < F.lit("1998-06-01").cast("timestamp_ntz"))
    batch = window_of(rows, "ordered_at", "1998-01-01 00:00:00").withColumn("order_status", F.lit("restated"))  # restates five months, adds the rest
    return merged(target, batch, ["order_id"]).select("order_id", "order_status")


@query("m02_consistent_slice", """WITH o AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01')
SELECT 'orders' AS name, count(*) AS n FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)""")
def _(t):
    tables = {n: t[n] for n in ("orders", "lineitem", "customer")}
    out = consistent_slice(tables, "orders", "o_orderdate", "1997-01-01 00:00:00", "1997-02-01 00:00:00", {"lineitem": ("l_orderkey", "o_orderkey")}, {"customer": ("c_custkey", "o_custkey")})
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in out.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("k03_replace_slice", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, min(event_id) AS first_event FROM events WHERE CAST(ts AS DATE) <> DATE '2024-01-03' GROUP BY 1")
def _(t):
    path = shared_path(t.spark, "slices")
    days = t["events"].withColumn("day", F.to_date("ts").cast("string"))
    days.write.partitionBy("day").parquet(path)
    for day in ("2024-01-02", "2024-01-02"):  # twice: a rerun changes nothing
        replace_slice(days.where(F.col("day") == day), path, "day", day)
    replace_slice(days.where("false"), path, "day", "2024-01-03")  # an empty slice still replaces
    back = t.spark.read.schema(days.schema).parquet(path)
    return back.groupBy(F.to_date("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("k07_upsert", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels")
def _(t):
    new = t["labels"].where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"))
    return merged(t["labels"].select("doc_id", "quality"), new, ["doc_id"])


@query("m08_missing_slices", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events GROUP BY CAST(ts AS DATE) HAVING day(CAST(ts AS DATE)) % 2 = 0")
def _(t):
    days = t["events"].select(F.to_date("ts").alias("slice_date")).distinct()
    path = shared_path(t.spark, "markers")
    mark_slices(days.where(F.day("slice_date") % 2 == 1).select("slice_date", F.lit("events").alias("name"), F.lit(1).cast("long").alias("n")), path)
    return without_marker(t.spark, path, days.select(F.col("slice_date").cast("string").alias("day")), "day")


@query("m10_dedup_by_content", "SELECT sha256(text || chr(0) || 'v1' || chr(0) || 'base') AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY text")
def _(t):
    rows = E.hashed(t["documents"], "text", "v1", "base")
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("m10_todo_after_cache", "SELECT content_hash FROM (SELECT DISTINCT sha256(text || chr(0) || 'v1' || chr(0) || 'base') AS content_hash FROM documents) WHERE content_hash NOT IN (SELECT sha256(text || chr(0) || 'v1' || chr(0) || 'base') FROM documents WHERE doc_id % 4 = 0)")
def _(t):
    rows = E.hashed(t["documents"], "text", "v1", "base")
    return E.todo(rows, rows.where("doc_id % 4 = 0"), "text").select("content_hash")


@query("m11_quarantine", """SELECT user_id AS batch, event_id AS i, CASE WHEN user_id % 10 = 0 THEN 'unparseable' WHEN event_id % 11 = 0 THEN 'missing' WHEN event_type = 'error' THEN 'unknown_aspect' WHEN event_id % 7 = 0 THEN 'bad_sentiment' WHEN event_id % 5 = 0 THEN 'bad_severity' END AS reason FROM events""")
def _(t):
    e = t["events"]
    sentiment = F.when(F.col("event_id") % 7 == 0, "furious").otherwise("neutral")
    severity = F.when(F.col("event_id") % 5 == 0, "9").otherwise("1")
    label = F.struct(F.col("event_id").cast("int").alias("i"), F.array("event_type").alias("aspects"), sentiment.alias("sentiment"), severity.alias("severity"), F.lit(False).alias("no_content"))
    # batches of a user hold the events of BATCH_IDS ids at most; one of missing items only still has its (empty) response
    batch = F.struct("user_id", F.floor(F.col("event_id") / BATCH_IDS).alias("part"))
    given = e.groupBy(batch.alias("batch")).agg(F.to_json(F.collect_list(F.when(F.col("event_id") % 11 != 0, label))).alias("response"))
    responses = given.select("batch", F.when(F.col("batch.user_id") % 10 == 0, "not json").otherwise(F.col("response")).alias("response"))
    items = e.select(batch.alias("batch"), F.col("event_id").cast("int").alias("i"), F.col("event_id").cast("string").alias("content_hash"))
    known = e.select("event_type").distinct().where(~F.col("event_type").eqNullSafe("error"))
    return E.checked_labels(responses, items, known).select(F.col("batch.user_id").alias("batch"), F.col("i").cast("long").alias("i"), "reason")


@query("m14_cost_reconciliation", "SELECT lang, CAST(sum(length(text)) AS BIGINT) AS expected, CAST(sum(n_chars) AS BIGINT) AS logged, CAST(sum(length(text)) - sum(n_chars) AS BIGINT) AS correction FROM documents GROUP BY lang")
def _(t):
    expected = t["documents"].groupBy("lang").agg(F.sum(F.length("text")).alias("expected"))
    logged = t["documents"].groupBy("lang").agg(F.sum("n_chars").alias("logged"))
    return expected.join(logged, "lang").withColumn("correction", F.col("expected") - F.col("logged"))


@query("m16_taxonomy_fold", "WITH n AS (SELECT event_type AS aspect, count(*) AS n FROM events GROUP BY 1) SELECT aspect, CASE WHEN n >= (SELECT avg(n) FROM n) THEN aspect ELSE p END AS folded_into, n FROM n LEFT JOIN (VALUES ('click', 'engagement'), ('view', 'engagement'), ('error', NULL)) x(a, p) ON a = aspect")
def _(t):
    from ..sources.files import seed

    counts = t["events"].groupBy(F.col("event_type").alias("aspect")).agg(F.count("*").alias("n"))
    parents = seed(t.spark, [("click", "engagement"), ("view", "engagement"), ("error", None)], "aspect string, parent_aspect string")
    return E.folded(counts, parents, counts.agg(F.avg("n")).scalar())


@query("m19_parity_seed", "SELECT DISTINCT p_type AS raw_value, nullif(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), '') AS normalized FROM part")
def _(t):
    from ..functions import normalize_text

    return t["part"].select(F.col("p_type").alias("raw_value")).distinct().withColumn("normalized", normalize_text(F.col("raw_value")))


@query("s01_csv_scan", "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment || chr(10) || '\"x\"' END AS note FROM customer")
def _(t):
    from pyspark.sql import types as T

    from ..sources.files import read_csv

    path = shared_path(t.spark, "csv")
    note = F.when(F.col("c_custkey") % 3 != 0, F.concat("c_mktsegment", F.lit('\n"x"')))
    t["customer"].select("c_custkey", "c_name", "c_acctbal", note.alias("note")).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    fields = [("c_custkey", T.LongType()), ("c_name", T.StringType()), ("c_acctbal", T.DoubleType()), ("note", T.StringType())]
    return read_csv(t.spark, path, T.StructType([T.StructField(*f) for f in fields]))


@query("k01_partitioned_slices", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, min(o_orderkey) AS first_order FROM orders WHERE year(o_orderdate) IN (1996, 1998) GROUP BY 1")
def _(t):
    path = shared_path(t.spark, "years")
    t["orders"].withColumn("y", F.year("o_orderdate")).repartition("y").write.partitionBy("y").parquet(path)
    years = t.spark.read.parquet(path).where(F.col("y").isin(1996, 1998))  # only these folders are read
    return years.groupBy(F.col("y").cast("int").alias("y")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


@query("k08_append_log", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def _(t):
    path = shared_path(t.spark, "log")
    for _ in range(2):
        t["events"].select("event_id", "event_type").write.mode("append").parquet(path)
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("k10_snapshot", "SELECT name, n FROM (SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'part', count(*) FROM part)")
def _(t):
    from ..sources.files import write_snapshot

    path = shared_path(t.spark, "snapshot")
    write_snapshot({n: t[n] for n in ("nation", "part")}, path)
    counts = [t.spark.read.parquet(f"{path}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("nation", "part")]
    return counts[0].unionByName(counts[1])


@query("g_guarded_sql", "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY o_orderstatus HAVING count(*) > 1")
def _(t):
    from ..plans import guard

    t["orders"].createOrReplaceTempView("guarded_orders")
    sql = "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM guarded_orders GROUP BY o_orderstatus HAVING count(*) > 1"
    return guard.guarded(t.spark, sql, {"guarded_orders"})
