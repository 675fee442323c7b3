"""Dimensions, facts, marts, and questions asked of them."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions import surrogate_key
from ..operators.segments import OTHER_SEGMENT, SEGMENTS
from ..plans import marts as M
from ..plans import quality as Q
from ..session import written
from .registry import query


def _dim_sql(rows: str, key: str, at: str, tie: str, attribute: str) -> str:
    """A Type 2 dimension in SQL, as a sub-select."""
    return f"""(WITH h AS (SELECT {key} AS k, {at} AS a, {tie} AS tie, {attribute} AS v, md5(coalesce(CAST({attribute} AS VARCHAR), '_dbt_utils_surrogate_key_null_')) AS hash FROM {rows}),
g AS (SELECT *, lag(hash) OVER (PARTITION BY k ORDER BY a, tie) AS p FROM h),
n AS (SELECT *, CAST(sum(CASE WHEN p IS NULL OR p <> hash THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, tie ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version_number FROM g),
v AS (SELECT k, version_number, min(a) AS started, min(v) AS v, count(*) AS obs FROM n GROUP BY 1, 2),
w AS (SELECT *, lead(started) OVER (PARTITION BY k ORDER BY version_number) AS nxt FROM v)
SELECT md5(concat_ws('-', CAST(k AS VARCHAR), CAST(version_number AS VARCHAR))) AS sk, k, version_number, v,
  CASE WHEN version_number = 1 THEN TIMESTAMP '1900-01-01 00:00:00' ELSE started END AS valid_from,
  coalesce(nxt, TIMESTAMP '9999-12-31 23:59:59') AS valid_to, nxt IS NULL AS is_current, started AS first_observed_at, obs AS observations_in_version FROM w)"""


EVENT_DIM = _dim_sql("events", "user_id", "ts", "event_id", "event_type")
CUSTOMER_DIM = _dim_sql("orders", "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
SHOWN = "sk, k AS {0}, version_number, v AS {1}, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, is_current, first_observed_at, observations_in_version"
FACT = f"""(SELECT o_orderkey AS order_id, o_custkey AS customer_id, d.sk AS customer_sk, d.version_number, o_orderstatus AS order_status, o_orderdate AS ordered_at, CAST(o_totalprice AS DECIMAL(28,6)) AS order_value,
  coalesce(e.item_count, 0) AS item_count, coalesce(e.seller_count, 0) AS seller_count, coalesce(e.product_count, 0) AS product_count, e.items_value, e.units, CASE WHEN e.last_shipped_at IS NOT NULL THEN date_diff('day', o_orderdate, e.last_shipped_at) END AS delivery_days
FROM orders JOIN {CUSTOMER_DIM} d ON o_custkey = d.k AND o_orderdate >= d.valid_from AND o_orderdate < d.valid_to
LEFT JOIN (SELECT l_orderkey, count(*) AS item_count, count(DISTINCT l_suppkey) AS seller_count, count(DISTINCT l_partkey) AS product_count, sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS items_value, sum(CAST(l_quantity AS DECIMAL(28,6))) AS units, max(l_shipdate) AS last_shipped_at FROM lineitem GROUP BY 1) e ON e.l_orderkey = o_orderkey)"""
PEOPLE = """(SELECT o_custkey AS customer_id, count(*) AS order_count, count(*) > 1 AS is_repeat, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS monetary_value, max(o_orderdate) AS last_order_at, date_diff('day', max(o_orderdate), (SELECT max(o_orderdate) FROM orders)) AS recency_days FROM orders GROUP BY o_custkey)"""
LADDER = "".join(f" WHEN r_score BETWEEN {r[0]} AND {r[1]} AND m_score BETWEEN {m[0]} AND {m[1]} THEN '{name}'" for name, r, m in SEGMENTS)
RFM = f"""(SELECT *, CASE{LADDER} ELSE '{OTHER_SEGMENT}' END AS rfm_segment
FROM (SELECT *, ntile(5) OVER (ORDER BY recency_days DESC, customer_id) AS r_score, ntile(5) OVER (ORDER BY monetary_value, customer_id) AS m_score FROM {PEOPLE}))"""
TAXONOMY = "(VALUES " + ", ".join(f"('{a}', '{g}', {str(c).lower()})" for a, g, c in M.TAXONOMY) + ") x(aspect, aspect_group, is_complaint)"
MART = f"""(WITH people AS (SELECT customer_id, rfm_segment FROM {RFM}), reviewed AS (SELECT l_orderkey, bool_or(l_discount > 0.05) AS has FROM lineitem GROUP BY 1),
owned AS (SELECT o_orderkey AS order_id, customer_id, rfm_segment, coalesce(has, false) AS has FROM orders JOIN people ON o_custkey = customer_id LEFT JOIN reviewed ON l_orderkey = o_orderkey),
totals AS (SELECT rfm_segment, count(DISTINCT customer_id) AS customers_in_segment, count(order_id) AS orders_in_segment, count(*) FILTER (has) AS orders_with_review_text FROM owned GROUP BY 1),
mentions AS (SELECT rfm_segment, l_returnflag || '-' || l_linestatus AS aspect, count(DISTINCT order_id) AS m, count(DISTINCT order_id || '/' || l_partkey) AS l FROM lineitem JOIN owned ON order_id = l_orderkey WHERE l_discount > 0.05 GROUP BY 1, 2)
SELECT t.rfm_segment, x.aspect, x.aspect_group, x.is_complaint, 'v1' AS label_version, customers_in_segment, orders_in_segment, orders_with_review_text,
  CASE WHEN orders_in_segment = 0 THEN 0 ELSE round(100.0::DOUBLE * orders_with_review_text / orders_in_segment, 2) END AS coverage_pct, coalesce(m, 0) AS orders_mentioning, coalesce(l, 0) AS lines_mentioning,
  CASE WHEN orders_with_review_text = 0 THEN NULL ELSE round(100.0::DOUBLE * coalesce(m, 0) / orders_with_review_text, 4) END AS rate_of_reviewed,
  CASE WHEN orders_in_segment = 0 THEN NULL ELSE round(100.0::DOUBLE * coalesce(m, 0) / orders_in_segment, 4) END AS rate_of_all
FROM totals t CROSS JOIN {TAXONOMY} LEFT JOIN mentions USING (rfm_segment, aspect))"""


def _shown(dim):
    return dim.withColumn("valid_from", F.col("valid_from").cast("string")).withColumn("valid_to", F.col("valid_to").cast("string"))


@query("m26_scd2_events", f"SELECT {SHOWN.format('user_id', 'event_type')} FROM {EVENT_DIM}")
def _(t):
    return _shown(M.event_dimension(t))


@query("m26_scd2_customers", f"SELECT {SHOWN.format('customer_id', 'priority')} FROM {CUSTOMER_DIM}")
def _(t):
    return _shown(M.dim_customers(t))


@query("j02_asof_join", f"SELECT event_id, user_id, ts, value, sk, version_number, d.v AS event_type FROM events JOIN {EVENT_DIM} d ON user_id = d.k AND ts >= d.valid_from AND ts < d.valid_to")
def _(t):
    return M.events_as_of(t).select("event_id", "user_id", "ts", "value", "sk", "version_number", "event_type")


@query("j14_version_drift", f"SELECT o_orderkey, d.v AS priority_then, c.v AS priority_now FROM orders JOIN {CUSTOMER_DIM} d ON o_custkey = d.k AND o_orderdate >= d.valid_from AND o_orderdate < d.valid_to JOIN {CUSTOMER_DIM} c ON c.k = d.k AND c.is_current WHERE d.v IS DISTINCT FROM c.v")
def _(t):
    facts, dim = M.fct_orders(t).select("order_id", "customer_sk"), M.dim_customers(t)
    then = dim.select(F.col("sk").alias("customer_sk"), "customer_id", F.col("priority").alias("priority_then"))
    now = dim.where("is_current").select("customer_id", F.col("priority").alias("priority_now"))
    joined = facts.join(then, "customer_sk").join(now, "customer_id")
    return joined.where(~F.col("priority_then").eqNullSafe(F.col("priority_now"))).select(F.col("order_id").alias("o_orderkey"), "priority_then", "priority_now")


@query("stg_customers", "SELECT c_custkey AS customer_id, c_name AS customer_name, nullif(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')), '') AS customer_name_normalized, coalesce(n_name, 'unknown') AS nation, c_mktsegment AS market_segment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    return M.stg_customers(t)


@query("dim_parts", "SELECT p_partkey AS part_id, p_name AS part_name, p_brand AS brand, p_type AS type, CASE WHEN nullif(p_size, 1) IS NOT NULL THEN round(p_size * p_retailprice, 2) END AS size_value FROM part")
def _(t):
    return M.dim_parts(t)


@query("dim_suppliers", "SELECT s_suppkey AS supplier_id, s_name AS supplier_name, coalesce(n_name, 'unknown') AS nation, s_name <> nullif(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')), '') AS name_was_normalized FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    return M.dim_suppliers(t)


@query("fct_orders", f"SELECT * REPLACE (CAST(order_value AS DOUBLE) AS order_value, CAST(items_value AS DOUBLE) AS items_value, CAST(units AS DOUBLE) AS units, CAST(delivery_days AS DOUBLE) AS delivery_days) FROM {FACT}")
def _(t):
    return M.fct_orders(t).withColumns({c: F.col(c).cast("double") for c in ("order_value", "items_value", "units", "delivery_days")})


@query("m27_rfm", f"SELECT customer_id, order_count, is_repeat, monetary_value, last_order_at, recency_days, r_score, m_score, rfm_segment FROM {RFM}")
def _(t):
    return M.customer_rfm(t).select("customer_id", "order_count", "is_repeat", "monetary_value", "last_order_at", "recency_days", "r_score", "m_score", "rfm_segment")


@query("m28_segment_aspect", f"SELECT * FROM {MART}")
def _(t):
    return M.fct_segment_aspect(t)


@query("gold_order_figures", f"SELECT count(*) AS orders, count(DISTINCT customer_id) AS customers, CAST(sum(order_value) AS DOUBLE) AS revenue, round(CAST(sum(order_value) AS DOUBLE) / count(*), 4) AS mean_value, CAST(max(order_value) AS DOUBLE) AS top_value, count(*) FILTER (seller_count > 1) AS multi_seller, round(avg(delivery_days) FILTER (order_status = 'F'), 6) AS mean_days FROM {FACT}")
def _(t):
    f = M.fct_orders(t)
    revenue = F.sum("order_value").cast("double")
    return f.agg(F.count("*").alias("orders"), F.countDistinct("customer_id").alias("customers"), revenue.alias("revenue"), F.round(revenue / F.count("*"), 4).alias("mean_value"), F.max("order_value").cast("double").alias("top_value"), F.count_if(F.col("seller_count") > 1).alias("multi_seller"), F.round(F.avg(F.when(F.col("order_status") == "F", F.col("delivery_days"))), 6).alias("mean_days"))


@query("gold_orders_by_status", f"SELECT order_status, count(*) AS orders FROM {FACT} GROUP BY order_status")
def _(t):
    return M.fct_orders(t).groupBy("order_status").agg(F.count("*").alias("orders"))


@query("gold_segment_totals", f"SELECT DISTINCT rfm_segment, customers_in_segment, orders_in_segment, orders_with_review_text, coverage_pct FROM {MART}")
def _(t):
    return M.fct_segment_aspect(t).select("rfm_segment", "customers_in_segment", "orders_in_segment", "orders_with_review_text", "coverage_pct").distinct()


@query("gold_top_aspects", f"SELECT aspect, CAST(sum(orders_mentioning) AS BIGINT) AS total FROM {MART} GROUP BY aspect ORDER BY total DESC, aspect LIMIT 5")
def _(t):
    return M.fct_segment_aspect(t).groupBy("aspect").agg(F.sum("orders_mentioning").alias("total")).orderBy(F.desc("total"), "aspect").limit(5)


@query("gold_aspect_facts", f"SELECT aspect_group, count(DISTINCT aspect) AS aspects, count(DISTINCT aspect) FILTER (is_complaint) AS complaints, min(label_version) AS label_version FROM {MART} GROUP BY aspect_group")
def _(t):
    return M.fct_segment_aspect(t).groupBy("aspect_group").agg(F.countDistinct("aspect").alias("aspects"), F.countDistinct(F.when(F.col("is_complaint"), F.col("aspect"))).alias("complaints"), F.min("label_version").alias("label_version"))


@query("demo_complaints_by_segment", f"SELECT rfm_segment, max(coverage_pct) AS coverage_pct, round(sum(CASE WHEN is_complaint THEN rate_of_reviewed ELSE 0 END), 2) AS among_reviewed, round(sum(CASE WHEN is_complaint THEN rate_of_all ELSE 0 END), 2) AS among_all FROM {MART} GROUP BY rfm_segment")
def _(t):
    rate = lambda c: F.round(F.sum(F.when(F.col("is_complaint"), F.col(c)).otherwise(0.0)), 2)
    return M.fct_segment_aspect(t).groupBy("rfm_segment").agg(F.max("coverage_pct").alias("coverage_pct"), rate("rate_of_reviewed").alias("among_reviewed"), rate("rate_of_all").alias("among_all"))


@query("demo_aspect_share", f"SELECT aspect, aspect_group, CAST(sum(orders_mentioning) AS BIGINT) AS mentioning, round(100.0::DOUBLE * CAST(sum(orders_mentioning) AS BIGINT) / CAST(sum(orders_with_review_text) AS BIGINT), 2) AS pct FROM {MART} GROUP BY 1, 2")
def _(t):
    return M.fct_segment_aspect(t).groupBy("aspect", "aspect_group").agg(F.sum("orders_mentioning").alias("mentioning"), F.round(100.0 * F.sum("orders_mentioning") / F.sum("orders_with_review_text"), 2).alias("pct"))


@query("demo_two_segments", f"SELECT aspect, max(CASE WHEN rfm_segment = 'champions' THEN rate_of_reviewed END) AS champions_pct, max(CASE WHEN rfm_segment = 'hibernating' THEN rate_of_reviewed END) AS hibernating_pct FROM {MART} WHERE rfm_segment IN ('champions', 'hibernating') GROUP BY aspect")
def _(t):
    rows = M.fct_segment_aspect(t).where(F.col("rfm_segment").isin("champions", "hibernating"))
    return rows.groupBy("aspect").agg(*[F.max(F.when(F.col("rfm_segment") == s, F.col("rate_of_reviewed"))).alias(f"{s}_pct") for s in ("champions", "hibernating")])


@query("dash_version_histogram", f"SELECT version_number, count(*) AS customers FROM {CUSTOMER_DIM} GROUP BY version_number")
def _(t):
    return M.dim_customers(t).groupBy("version_number").agg(F.count("*").alias("customers"))


@query("dash_revenue_by_class", f"SELECT v AS priority, count(*) AS orders, CAST(sum(f.order_value) AS DOUBLE) AS revenue FROM {FACT} f JOIN {CUSTOMER_DIM} d ON f.customer_sk = d.sk GROUP BY v ORDER BY revenue DESC LIMIT 15")
def _(t):
    dim = M.dim_customers(t).select(F.col("sk").alias("customer_sk"), "priority")
    joined = M.fct_orders(t).select("customer_sk", "order_value").join(dim, "customer_sk")
    return joined.groupBy("priority").agg(F.count("*").alias("orders"), F.sum("order_value").cast("double").alias("revenue")).orderBy(F.desc("revenue")).limit(15)


@query("m29_misattribution", f"SELECT count(*) AS orders, count(*) FILTER (d.sk <> c.sk) AS superseded, count(*) FILTER (d.v <> c.v) AS different, count(*) FILTER (d.sk <> c.sk AND d.v = c.v) AS returned FROM orders JOIN {CUSTOMER_DIM} d ON o_custkey = d.k AND o_orderdate >= d.valid_from AND o_orderdate < d.valid_to JOIN {CUSTOMER_DIM} c ON c.k = d.k AND c.is_current")
def _(t):
    dim = M.dim_customers(t)
    then = dim.select(F.col("sk").alias("customer_sk"), "customer_id", F.col("priority").alias("p"))
    now = dim.where("is_current").select("customer_id", F.col("sk").alias("now_sk"), F.col("priority").alias("q"))
    joined = M.fct_orders(t).select("customer_sk").join(then, "customer_sk").join(now, "customer_id")
    other, differs = F.col("customer_sk") != F.col("now_sk"), F.col("p") != F.col("q")
    return joined.agg(F.count("*").alias("orders"), F.count_if(other).alias("superseded"), F.count_if(differs).alias("different"), F.count_if(other & ~differs).alias("returned"))


@query("t01_to_t08_checks", "SELECT * FROM (VALUES ('t01_grain', 0::BIGINT), ('t02_overlap', 0), ('t03_current', 0), ('t04_reconciled', 0), ('t05_keys', 0), ('t06_ascii', 0), ('t07_boundaries', 0), ('t08_provenance', 0)) v(name, offending)")
def _(t):
    dim, mart, orders = written(M.dim_customers(t), "dim-customers"), M.fct_segment_aspect(t), M.stg_orders(t)
    return _counted(_checks(dim, written(M.fct_orders(t, dim).select("order_id"), "fct-orders"), orders, M.stg_customers(t), mart, orders.withColumn("raw", F.upper("priority")).withColumn("normal", F.lower("priority"))))


def _checks(dim, facts, orders, customers, mart, cased):
    return {
        "t01_grain": Q.same_grain(facts, orders),
        "t02_overlap": Q.no_overlap(dim, "customer_id"),
        "t03_current": Q.one_current(dim, "customer_id"),
        "t04_reconciled": Q.reconciled(dim, orders),
        "t05_keys": Q.unique(dim.select(surrogate_key(F.col("customer_id"), F.col("version_number")).alias("sk")), "sk"),
        "t06_ascii": Q.ascii_only(customers, "customer_name_normalized"),
        "t07_boundaries": Q.same_boundaries(cased, "customer_id", ["ordered_at", "order_id"], ["raw"], ["normal"]),
        "t08_provenance": Q.single_provenance(mart, {"label_version": "v1"}),
    }


def _counted(found):
    rows = [bad.agg(F.count("*").alias("offending")).select(F.lit(name).alias("name"), "offending") for name, bad in found.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


#: Offenders by plain SQL: versions that reach a day into the next, customers with every version current, versions that are there twice.
PLANTED = f"""WITH d AS (SELECT * FROM {CUSTOMER_DIM}), two AS (SELECT k FROM d GROUP BY k HAVING count(*) > 1),
c AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END AS raw, lower(o_orderpriority) AS normal, o_orderdate AS a, o_orderkey AS tie FROM orders),
b AS (SELECT raw IS DISTINCT FROM lag(raw) OVER w AS x, normal IS DISTINCT FROM lag(normal) OVER w AS y FROM c WINDOW w AS (PARTITION BY k ORDER BY a, tie))
SELECT 't01_grain' AS name, count(*) AS offending FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'F' LIMIT 1)
UNION ALL SELECT 't02_overlap', count(*) FILTER (NOT is_current) FROM d
UNION ALL SELECT 't03_current', count(*) FROM two
UNION ALL SELECT 't04_reconciled', 1
UNION ALL SELECT 't05_keys', count(*) FILTER (version_number = 1) FROM d
UNION ALL SELECT 't06_ascii', count(*) FILTER (c_mktsegment = 'BUILDING') FROM customer
UNION ALL SELECT 't07_boundaries', CASE WHEN count(*) FILTER (x) <> count(*) FILTER (y) THEN 1 ELSE 0 END FROM b
UNION ALL SELECT 't08_provenance', count(DISTINCT is_complaint) FILTER (is_complaint) FROM {TAXONOMY}"""


@query("t01_to_t08_planted", PLANTED)
def _(t):
    """The same checks on tables that break each of them."""
    orders, dim = M.stg_orders(t), written(M.dim_customers(t), "dim-customers")
    broken = dim.withColumn("valid_to", F.when(F.col("is_current"), F.col("valid_to")).otherwise(F.col("valid_to") + F.expr("INTERVAL 1 DAY"))).withColumn("is_current", F.lit(True))
    mart = M.fct_segment_aspect(t).withColumn("label_version", F.when(F.col("is_complaint"), "v2").otherwise("v1"))
    cased = orders.withColumn("raw", F.when(F.col("order_id") % 2 == 0, F.upper("priority")).otherwise(F.col("priority"))).withColumn("normal", F.lower("priority"))
    customers = M.stg_customers(t).withColumn("customer_name_normalized", F.when(F.col("market_segment") == "BUILDING", F.concat("customer_name_normalized", F.lit("é"))).otherwise(F.col("customer_name_normalized")))
    found = _checks(broken, orders.where("order_status <> 'F'"), orders, customers, mart, cased)
    twice = dim.unionByName(dim.where("version_number = 1"))
    found["t04_reconciled"] = Q.reconciled(twice, orders)
    found["t05_keys"] = Q.unique(twice, "sk")
    return _counted(found)


@query("gold_customers_by_class", f"SELECT v AS priority, count(*) AS customers FROM {CUSTOMER_DIM} WHERE is_current GROUP BY v")
def _(t):
    return M.dim_customers(t).where("is_current").groupBy("priority").agg(F.count("*").alias("customers"))


@query("gold_one_aspect_by_segment", f"SELECT rfm_segment, orders_mentioning FROM {MART} WHERE aspect = 'R-F'")
def _(t):
    return M.fct_segment_aspect(t).where("aspect = 'R-F'").select("rfm_segment", "orders_mentioning")


@query("gold_lowest_coverage", f"SELECT rfm_segment, max(coverage_pct) AS coverage FROM {MART} GROUP BY rfm_segment ORDER BY coverage, rfm_segment LIMIT 1")
def _(t):
    return M.fct_segment_aspect(t).groupBy("rfm_segment").agg(F.max("coverage_pct").alias("coverage")).orderBy("coverage", "rfm_segment").limit(1)


@query("gold_aspects_of_a_segment", f"SELECT aspect, rate_of_reviewed FROM {MART} WHERE rfm_segment = 'hibernating' ORDER BY rate_of_reviewed DESC, aspect")
def _(t):
    return M.fct_segment_aspect(t).where("rfm_segment = 'hibernating'").select("aspect", "rate_of_reviewed").orderBy(F.desc("rate_of_reviewed"), "aspect")


@query("w05_lead_intervals", f"SELECT k AS customer_id, version_number, coalesce(date_diff('day', first_observed_at, lead(first_observed_at) OVER (PARTITION BY k ORDER BY version_number)), -1) AS days_to_next FROM {CUSTOMER_DIM} WHERE NOT is_current")
def _(t):
    from pyspark.sql import Window

    from ..functions import day_diff

    dim = M.dim_customers(t).where("not is_current")
    following = F.lead("first_observed_at").over(Window.partitionBy("customer_id").orderBy("version_number"))
    return dim.select("customer_id", "version_number", F.coalesce(day_diff(following, F.col("first_observed_at")), F.lit(-1)).alias("days_to_next"))
