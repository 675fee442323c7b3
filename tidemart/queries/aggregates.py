"""Aggregations and windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import wilson
from ..operators.evaluation import confusion, scores, set_agreement
from ..operators.history import marked, numbered
from ..operators.loading import latest_by
from ..operators.ranking import global_ntile
from .registry import query


@query("a01_counts", "SELECT event_type, count(*) AS n, count(nullif(user_id, 3)) AS known, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type")
def _(t):
    return t["events"].groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.nullif("user_id", F.lit(3))).alias("known"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("a04_decimal_sums", "SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS DOUBLE) AS price, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,6))) + sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) AS both FROM lineitem GROUP BY l_suppkey")
def _(t):
    money = "decimal(28,6)"
    p, q = F.sum(F.col("l_extendedprice").cast(money)), F.sum(F.col("l_quantity").cast(money))
    return t["lineitem"].groupBy("l_suppkey").agg(p.cast("double").alias("price"), (p + q).cast("double").alias("both"))


@query("a06_constant_in_group", "SELECT user_id, min(event_type) AS any_type, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY user_id")
def _(t):
    return t["events"].groupBy("user_id").agg(F.min("event_type").alias("any_type"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("a08_conditional", "SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, max(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) = 1 AS any_deep, CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS open_units FROM lineitem GROUP BY l_suppkey")
def _(t):
    units = F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("decimal(18,2)")).otherwise(F.lit(0))
    return t["lineitem"].groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.bool_or(F.col("l_discount") > 0.09).alias("any_deep"), F.sum(units).cast("double").alias("open_units"))


@query("a11_manual_pivot", "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source")
def _(t):
    return t["documents"].groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().fillna(0)


@query("a12_global", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value FROM events")
def _(t):
    return t["events"].agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("a13_count_of_counts", "SELECT n AS orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def _(t):
    return t["orders"].groupBy("o_custkey").agg(F.count("*").alias("orders")).groupBy("orders").agg(F.count("*").alias("customers"))


@query("a14_ratio_of_sums", "SELECT l_returnflag, round(100.0::DOUBLE * CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(28,6))) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS DOUBLE), 2) AS discount_pct FROM lineitem GROUP BY l_returnflag")
def _(t):
    part = F.sum((F.col("l_extendedprice") * F.col("l_discount")).cast("decimal(28,6)")).cast("double")
    return t["lineitem"].groupBy("l_returnflag").agg(F.round(100.0 * part / F.sum(F.col("l_extendedprice").cast("decimal(28,6)")).cast("double"), 2).alias("discount_pct"))


@query("a16_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def _(t):
    return t["orders"].groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("a17_json_lengths", "SELECT lang, CAST(sum(json_array_length(j)) AS BIGINT) AS words, round(avg(json_array_length(j)), 6) AS mean_words FROM (SELECT lang, to_json(string_split(source || ' ' || lang, ' ')) AS j FROM documents) GROUP BY lang")
def _(t):
    n = F.json_array_length(F.to_json(F.split(F.concat_ws(" ", "source", "lang"), " ")))
    return t["documents"].groupBy("lang").agg(F.sum(n).alias("words"), F.round(F.avg(n), 6).alias("mean_words"))


@query("a18_most_common", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def _(t):
    return t["documents"].groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


CONFUSION = "SELECT source, count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn, count(*) FILTER (NOT t AND NOT g) AS tn FROM (SELECT source, quality = 1 AS t, (toxic = 0 OR doc_id % 3 = 0) AS g FROM labels JOIN documents USING (doc_id)) GROUP BY source"


def _rated(t):
    return t["labels"].join(t["documents"], "doc_id").select("source", (F.col("quality") == 1).alias("t"), ((F.col("toxic") == 0) | (F.col("doc_id") % 3 == 0)).alias("g"))


@query("a19_confusion", CONFUSION)
def _(t):
    return confusion(_rated(t), "source", "t", "g")


def _wilson_sql(k, n, sign):
    p, m = f"({k}::DOUBLE / nullif({n}, 0))", f"nullif(({n})::DOUBLE, 0)"
    bound = f"(({p} + 1.959964 * 1.959964 / (2 * {m})) / (1 + 1.959964 * 1.959964 / {m}) {sign} 1.959964 * sqrt({p} * (1 - {p}) / {m} + 1.959964 * 1.959964 / (4 * {m} * {m})) / (1 + 1.959964 * 1.959964 / {m}))"
    return f"round(CASE WHEN {n} > 0 THEN {'greatest' if sign == '-' else 'least'}({bound}, {0.0 if sign == '-' else 1.0}::DOUBLE) END, 6)"


@query("a20_precision_recall", f"""WITH c AS ({CONFUSION}), s AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS p, tp::DOUBLE / nullif(tp + fn, 0) AS r FROM c)
SELECT source, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, {_wilson_sql('tp', '(tp + fp)', '-')} AS precision_low, {_wilson_sql('tp', '(tp + fp)', '+')} AS precision_high,
{_wilson_sql('tp', '(tp + fn)', '-')} AS recall_low, {_wilson_sql('tp', '(tp + fn)', '+')} AS recall_high, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM s""")
def _(t):
    return scores(confusion(_rated(t), "source", "t", "g"))


@query("a21_wilson", f"SELECT lang, {_wilson_sql('k', 'n', '-')} AS low, {_wilson_sql('k', 'n', '+')} AS high FROM (SELECT lang, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)")
def _(t):
    counted = t["labels"].join(t["documents"], "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return counted.select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("a22_contingency", "SELECT quality, count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS toxic FROM labels GROUP BY quality")
def _(t):
    return t["labels"].groupBy("quality").pivot("toxic", [0, 1]).count().fillna(0).select("quality", F.col("0").alias("clean"), F.col("1").alias("toxic"))


@query("a23_set_agreement", """WITH s AS (SELECT conv_id, list(DISTINCT role) FILTER (turn <= 2) AS a, list(DISTINCT role) FILTER (turn > 1) AS b FROM conversations GROUP BY conv_id),
c AS (SELECT coalesce(a, []) AS a, coalesce(b, []) AS b FROM s), j AS (SELECT len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM c)
SELECT count(*) AS n, count(*) FILTER (i = u) AS exact, round(avg(CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE i::DOUBLE / u END), 6) AS mean_jaccard FROM j""")
def _(t):
    roles = t["conversations"].groupBy("conv_id").agg(F.collect_set(F.when(F.col("turn") <= 2, F.col("role"))).alias("a"), F.collect_set(F.when(F.col("turn") > 1, F.col("role"))).alias("b"))
    return set_agreement(roles, "a", "b")


@query("a24_regression", "SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 1)), 6) AS residual_sd FROM (SELECT n_chars::DOUBLE AS y, length(text)::DOUBLE + doc_id % 5 AS x FROM documents)")
def _(t):
    xy = t["documents"].select(F.col("n_chars").cast("double").alias("y"), (F.length("text") + F.col("doc_id") % 5).cast("double").alias("x"))
    rest = F.sqrt((F.regr_syy("y", "x") - F.regr_sxy("y", "x") * F.regr_sxy("y", "x") / F.regr_sxx("y", "x")) / (F.count("*") - 1))
    return xy.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(rest, 6).alias("residual_sd"))


@query("a25_duplicated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return t["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("a26_empty_sum", "SELECT coalesce(sum(value), 0.0) AS total FROM events WHERE event_type = 'none'")
def _(t):
    return t["events"].where("event_type = 'none'").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


@query("a28_last_per_group", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(t):
    return latest_by(t["events"], ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


RUNS = "SELECT event_id, user_id, ts, event_type, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query("w01_lag_change", f"SELECT event_id, CASE WHEN before IS NULL OR before <> event_type THEN 1 ELSE 0 END AS is_version_start FROM ({RUNS})")
def _(t):
    return marked(t["events"], "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "is_version_start")


@query("w03_running_version", f"SELECT event_id, CAST(sum(CASE WHEN before IS NULL OR before <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS version_number FROM ({RUNS})")
def _(t):
    return numbered(t["events"], "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "version_number")


@query("w06_ntile", "SELECT c_custkey, ntile(5) OVER (ORDER BY c_acctbal DESC, c_custkey) AS r_score FROM customer")
def _(t):
    return global_ntile(t["customer"].select("c_custkey", "c_acctbal"), 5, [F.desc("c_acctbal"), F.asc("c_custkey")], "r_score").select("c_custkey", "r_score")


@query("w07_share_of_total", "SELECT n AS orders, count(*) AS customers, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY n")
def _(t):
    counted = t["orders"].groupBy("o_custkey").agg(F.count("*").alias("orders")).groupBy("orders").agg(F.count("*").alias("customers"))
    total = F.broadcast(counted.agg(F.sum("customers").alias("_total")))
    return counted.crossJoin(total).select("orders", "customers", F.round(100.0 * F.col("customers") / F.col("_total"), 2).alias("pct"))


@query("w08_count_over_distinct", "SELECT DISTINCT lang, count(*) OVER () AS rows_in_all FROM documents")
def _(t):
    total = F.broadcast(t["documents"].agg(F.count("*").alias("rows_in_all")))
    return t["documents"].select("lang").distinct().crossJoin(total)


@query("w11_group_transform", "SELECT event_id, max(value) OVER (PARTITION BY user_id) AS top_value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_value FROM events")
def _(t):
    w = Window.partitionBy("user_id")
    return t["events"].select("event_id", F.max("value").over(w).alias("top_value"), F.lag("value").over(w.orderBy("ts", "event_id")).alias("before_value"))
