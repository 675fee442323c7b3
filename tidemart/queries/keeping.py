"""What is kept beside tables and used again: samples, distinct counts by slice, rejected lines, snapshots, maps and arrivals."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import enrichment as E
from ..operators import sampling, sketches
from ..operators.merging import merge_state
from ..operators.windows import covered
from ..plans import guard
from ..session import shared_path
from ..sources import json_lines, snapshots
from ..streaming.slices import merge_arrivals
from .registry import query


@query("o08_large_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-11'), o_orderkey) AS r FROM orders) WHERE r <= (SELECT count(*) // 3 FROM orders)")
def _(t):
    keys = t["orders"].select("o_orderkey")
    return sampling.seeded_sample(keys, keys.count() // 3, "o_orderkey", 11)


LABELS = "SELECT doc_id, unnest(list_distinct([coalesce('lang ' || lang, 'lang'), coalesce('source ' || source, 'source'), 'length ' || CAST(length(CAST(n_chars AS VARCHAR)) AS VARCHAR)])) AS label FROM documents"


def _labelled(t):
    length = F.concat(F.lit("length "), F.length(F.col("n_chars").cast("string")).cast("string"))
    return t["documents"].select("doc_id", F.array(F.coalesce(F.concat(F.lit("lang "), "lang"), F.lit("lang")), F.coalesce(F.concat(F.lit("source "), "source"), F.lit("source")), length).alias("labels"))


@query("o09_deficit_sample", f"SELECT label, count(*) AS n, true AS is_covered FROM ({LABELS}) GROUP BY label")
def _(t):
    """Of every label the sample has 20 rows, or all that there are."""
    rows = _labelled(t)
    drawn = sampling.deficit_sample(rows, 400, id_col="doc_id", labels="labels", random_share=0.25, floor=20, seed=5)
    have = sampling.label_counts(rows.join(drawn.select("doc_id"), "doc_id", "left_semi"), "labels").withColumnRenamed("n", "_have")
    return sampling.label_counts(rows, "labels").join(have, "label", "left").select("label", "n", (F.coalesce("_have", F.lit(0)) >= F.least("n", F.lit(20))).alias("is_covered"))


@query("o09_deficit_strata", "SELECT 'random' AS stratum, least(count(*) // 8, count(*)) AS n FROM documents UNION ALL SELECT 'others', count(*) // 2 - count(*) // 8 FROM documents")
def _(t):
    size = t["documents"].count() // 2
    drawn = sampling.deficit_sample(_labelled(t), size, id_col="doc_id", labels="labels", random_share=0.25, floor=20, seed=5)
    return drawn.groupBy(F.when(F.col("stratum") == "random", "random").otherwise("others").alias("stratum")).agg(F.count("*").alias("n"))


@query("a03_distinct_by_slices", """SELECT month, 'event_type' AS "column", count(DISTINCT event_type) AS n FROM (SELECT strftime(ts, '%Y-%m') AS month, * FROM events) GROUP BY 1 UNION ALL
SELECT strftime(ts, '%Y-%m'), 'user_id', count(DISTINCT user_id) FROM events GROUP BY 1""")
def _(t):
    """Bitmaps are kept by day, and a month's are joined."""
    rows, columns = t["events"].select(F.to_date("ts").alias("day"), "user_id", "event_type"), ["user_id", "event_type"]
    numbers = sketches.kept(sketches.dictionary(rows, "day", columns), "numbers")
    maps = sketches.kept(sketches.bitmaps(rows, "day", columns, numbers), "bitmaps")
    return sketches.exact_counts(maps.withColumn("month", F.date_format("slice", "yyyy-MM")), ["month"])


@query("a25_sketched_counts", "SELECT day(ts) % 2 = 0 AS even_day, count(DISTINCT event_id) AS n, true AS is_close FROM events GROUP BY 1")
def _(t):
    """Sketches of days give what is seen on any set of days within 5 %; the exact count stands beside it."""
    rows = t["events"].select(F.to_date("ts").alias("day"), "event_id")
    even = (F.day("slice") % 2 == 0).alias("even_day")
    about = sketches.estimated_counts(sketches.kept(sketches.sketches(rows, "day", ["event_id"]), "sketches").withColumn("even_day", even), ["even_day"]).withColumnRenamed("n", "_about")
    exact = rows.groupBy((F.day("day") % 2 == 0).alias("even_day")).agg(F.count_distinct("event_id").alias("n"))
    return exact.join(about, "even_day").select("even_day", "n", (F.abs(F.col("_about") - F.col("n")) <= 0.05 * F.col("n")).alias("is_close"))


EVENT = T.StructType([T.StructField("event_id", T.LongType(), False), T.StructField("event_type", T.StringType(), False), T.StructField("value", T.DoubleType())])
DAMAGE = "CASE WHEN event_id % 17 = 0 THEN 'not JSON' WHEN event_id % 13 = 0 THEN 'event_id: not bigint' WHEN event_id % 11 = 0 THEN 'event_type: missing' WHEN event_id % 7 = 0 THEN 'value: not double' WHEN event_id % 5 = 0 THEN 'not an object' END"


@query("k09_json_ingest", f"SELECT {DAMAGE} AS reason, count(*) AS n, CAST(sum(length(event_type)) FILTER ({DAMAGE} IS NULL) AS BIGINT) AS letters FROM events GROUP BY 1")
def _(t):
    """Lines with planted damage: good ones are in the table, bad ones among the rejects, after two loads of the batch."""
    at = lambda n: F.col("event_id") % n == 0
    fields = [F.when(at(13), F.lit("x")).otherwise(F.col("event_id").cast("string")).alias("event_id"), F.when(~at(11), F.col("event_type")).alias("event_type"), F.when(at(7), F.lit("high")).otherwise(F.col("value").cast("string")).alias("value")]
    good = F.to_json(F.struct(F.when(~at(13), F.col("event_id")).alias("event_id"), fields[1], F.when(~at(7), F.col("value")).alias("value")))
    odd = F.to_json(F.struct(*fields))
    line = F.when(at(17), F.concat(F.lit("{"), F.substring(good, 1, 12))).when(at(13) | at(11) | at(7), odd).when(at(5), F.lit("[1, 2]")).otherwise(good)
    source, table, rejects = (shared_path(t.spark, n) for n in ("lines", "ingested", "rejected"))
    t["events"].select(line.alias("value")).write.text(source)
    for _ in range(2):
        json_lines.ingest(t.spark, source, EVENT, table, rejects, "b1")
    good_rows = t.spark.read.schema(EVENT).parquet(f"{table}/batch=b1").select(F.lit(None).cast("string").alias("reason"), F.length("event_type").cast("long").alias("letters"))
    bad_rows = t.spark.read.schema(json_lines.REJECTED).parquet(f"{rejects}/batch=b1").select("reason", F.lit(None).cast("long").alias("letters"))
    return good_rows.unionByName(bad_rows).groupBy("reason").agg(F.count("*").alias("n"), F.sum("letters").alias("letters"))


@query("s06_isolated_snapshot", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_totalprice) AS BIGINT) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def _(t):
    """Tables whose source is gone, asked in a session that sees nothing else."""
    source, folder = shared_path(t.spark, "source"), shared_path(t.spark, "snapshot")
    t["orders"].write.parquet(source)
    snapshots.take({"orders": t.spark.read.parquet(source), "customer": t["customer"]}, folder)
    gone = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    gone.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    snapshot = snapshots.open_snapshot(t.spark, folder, ["orders", "customer"])
    return snapshot.ask("select o_orderstatus, count(*) as n, cast(round(sum(o_totalprice), 0) as bigint) as total from orders join customer on c_custkey = o_custkey group by o_orderstatus")


HASH = "sha256(text || chr(0) || 'v1' || chr(0) || 'base')"


@query("m10_map_rows", f"SELECT doc_id, {HASH} AS content_hash, {HASH} IN (SELECT {HASH} FROM documents WHERE doc_id % 4 = 0) AS is_cached FROM documents")
def _(t):
    rows = E.hashed(t["documents"], "text", "v1", "base")
    return E.mapped(rows, rows.where("doc_id % 4 = 0"), "doc_id")


@query("m01_arriving_slices", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'late' ELSE o_orderstatus END AS order_status FROM orders")
def _(t):
    """Slices that arrive as files, a late one among them, merged by a stream that keeps its place."""
    source, target, at = (shared_path(t.spark, n) for n in ("arrivals", "arrived", "stream"))
    rows = t["orders"].select("o_orderkey", F.col("o_orderstatus").alias("order_status"), F.lit(1).alias("version"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    for slices in (rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1").unionByName(rows.where("o_orderkey % 6 = 0").withColumn("order_status", F.lit("late")).withColumn("version", F.lit(2)))):
        slices.write.mode("append").parquet(source)
        merge_arrivals(t.spark, source, schema, target, at, ["o_orderkey"], ["version"])
    return merge_state(t.spark, target).select("o_orderkey", "order_status")


@query("m03_covered_windows", "SELECT 'inside' AS asked, date_diff('month', min(o_orderdate), max(o_orderdate)) + 1 AS windows, count(*) AS n FROM orders UNION ALL SELECT 'beyond', 0, 0")
def _(t):
    """Windows of a load end where the data end, and one that begins behind them has none."""
    import datetime as dt

    first, last = t["orders"].agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).first()
    asked = {"inside": (first, last + dt.timedelta(days=900)), "beyond": (last + dt.timedelta(days=1), last + dt.timedelta(days=90))}
    planned = [(name, begins, ends) for name, (start, end) in asked.items() for begins, ends in covered(start, end, last)]
    windows = F.broadcast(t.spark.createDataFrame(planned, "asked string, begins date, ends date"))  # one row a month
    day = F.to_date("o_orderdate")
    loaded = t["orders"].join(windows, (day >= F.col("begins")) & (day < F.col("ends"))).groupBy("asked").agg(F.count_distinct("begins").alias("windows"), F.count("*").alias("n"))
    names = t.spark.createDataFrame([(name,) for name in asked], "asked string")
    return names.join(loaded, "asked", "left").select("asked", F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("n", F.lit(0)).alias("n"))


@query("o06_row_cap", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
def _(t):
    t["orders"].createOrReplaceTempView("capped_orders")
    return guard.guarded(t.spark, "select o_orderkey from capped_orders order by o_orderkey limit 1000", {"capped_orders"}, max_rows=7)


@query("m23_budget", "SELECT k, k > 3 AS is_refused, CASE WHEN k <= 3 THEN (SELECT count(*) FROM orders WHERE o_orderkey % k = 0) END AS answer FROM range(1, 6) r(k)")
def _(t):
    """Five questions of a user whose budget is good for three."""
    t["orders"].createOrReplaceTempView("budget_orders")
    asked = [guard.guarded(t.spark, f"select count(*) as answer from budget_orders where mod(o_orderkey, {k}) = 0", {"budget_orders"}) for k in range(1, 6)]
    size = guard.scanned_bytes(asked[0])
    budget, rows = guard.Budget(max_bytes=3 * size + 2, usual_bytes=size), []
    for k, question in enumerate(asked, 1):
        try:
            rows.append((k, False, guard.answer(question, budget=budget, seconds=600)[0].answer))
        except PermissionError:
            rows.append((k, True, None))
    return t.spark.createDataFrame(rows, "k long, is_refused boolean, answer long")
