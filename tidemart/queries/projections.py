"""Scans, projections, predicates and scalar functions."""

from pyspark.sql import functions as F

from ..functions import blank_to_null, contains_non_ascii, content_hash, day_diff, has_mojibake, month_start, normalize_text, surrogate_key
from ..operators.enrichment import token_cost
from ..operators.loading import window_of
from .registry import query


@query("s05_parquet_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'")
def _(t):
    return t["lineitem"].where(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_extendedprice")


@query("s07_views", "SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders")
def _(t):
    t["orders"].createOrReplaceTempView("tidemart_orders")
    return t.spark.sql("SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM tidemart_orders")


@query("s15_range", "SELECT r.i AS i, count(*) AS n FROM range(12) r(i) JOIN nation ON n_regionkey = r.i % 5 GROUP BY r.i")
def _(t):
    return t.spark.range(12).withColumnRenamed("id", "i").join(t["nation"], F.col("n_regionkey") == F.col("i") % 5).groupBy("i").agg(F.count("*").alias("n"))


@query("p01_project_rename_cast", "SELECT CAST(p_partkey AS VARCHAR) AS part_id, CAST(p_size AS BIGINT) AS size_class, CAST(round(p_retailprice) AS INTEGER) AS price_whole, lower(p_type) AS type FROM part")
def _(t):
    return t["part"].select(F.col("p_partkey").cast("string").alias("part_id"), F.col("p_size").cast("long").alias("size_class"), F.round("p_retailprice").cast("int").alias("price_whole"), F.lower("p_type").alias("type"))


@query("p02_blank_to_null", "SELECT conv_id, turn, nullif(trim(CASE WHEN role = 'user' THEN '  ' ELSE role END), '') AS role FROM conversations")
def _(t):
    return t["conversations"].select("conv_id", "turn", blank_to_null(F.when(F.col("role") == "user", "  ").otherwise(F.col("role"))).alias("role"))


@query("p03_null_flag", "SELECT o_orderkey, nullif(o_orderstatus, 'O') IS NOT NULL AS is_settled FROM orders")
def _(t):
    return t["orders"].select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).isNotNull().alias("is_settled"))


@query("p04_bounding_box", "SELECT s_nationkey, count(*) AS n, round(avg(s_acctbal), 6) AS mean_balance, min(s_name) AS any_name FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000 AND s_nationkey BETWEEN 5 AND 20 GROUP BY s_nationkey")
def _(t):
    box = t["supplier"].where(F.col("s_acctbal").between(0, 5000) & F.col("s_nationkey").between(5, 20))
    return box.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 6).alias("mean_balance"), F.min("s_name").alias("any_name"))


@query("p05_config_filter", "SELECT doc_id, source FROM documents WHERE lang = 'de' AND source = 'src3'")
def _(t):
    wanted = {"lang": "de", "source": "src3"}
    df = t["documents"]
    for column, value in wanted.items():
        df = df.where(F.col(column) == value)
    return df.select("doc_id", "source")


@query("p06_boolean_predicate", "SELECT doc_id FROM (SELECT doc_id, toxic = 1 AS is_toxic FROM labels) WHERE is_toxic")
def _(t):
    return t["labels"].withColumn("is_toxic", F.col("toxic") == 1).where("is_toxic").select("doc_id")


@query("p07_case_ladder", "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'middle' WHEN o_totalprice >= 20000 THEN 'small' ELSE 'tiny' END AS class FROM orders")
def _(t):
    p = F.col("o_totalprice")
    return t["orders"].select("o_orderkey", F.when(p >= 300000, "large").when(p >= 100000, "middle").when(p >= 20000, "small").otherwise("tiny").alias("class"))


@query("p08_case_null_guard", "SELECT p_partkey, CASE WHEN nullif(p_size, 1) IS NOT NULL THEN round(p_size * p_retailprice, 2) END AS volume FROM part")
def _(t):
    size = F.nullif("p_size", F.lit(1))
    return t["part"].select("p_partkey", F.when(size.isNotNull(), F.round(size * F.col("p_retailprice"), 2)).alias("volume"))


@query("p09_zero_denominator", "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN NULL ELSE round(100.0::DOUBLE * count(*) FILTER (event_type = 'error') / count(*) FILTER (event_type = 'purchase'), 4) END AS errors_per_purchase FROM events GROUP BY user_id")
def _(t):
    from ..functions import ratio_or

    counts = t["events"].groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    return counts.select("user_id", ratio_or(F.col("e"), F.col("p"), None, 100, 4).alias("errors_per_purchase"))


@query("p10_coalesce", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(nullif(d.source, 'src1'), 'unknown') AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    joined = t["documents"].join(t["labels"], "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(F.nullif("source", F.lit("src1")), F.lit("unknown")).alias("source"))


@query("p11_high_water_mark", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE event_id % 7 <> 0) - INTERVAL 1 DAY")
def _(t):
    mark = t["events"].where("event_id % 7 <> 0").agg(F.max("ts")).scalar()
    return t["events"].where(F.col("ts") >= mark - F.expr("INTERVAL 1 DAY")).select("event_id")


@query("p12_in_list", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (0, 2, 4)")
def _(t):
    return t["nation"].where(F.col("n_regionkey").isin(0, 2, 4)).select("n_nationkey", "n_name")


@query("p13_distinct_from", "SELECT a.doc_id FROM documents a JOIN labels b USING (doc_id) WHERE nullif(a.lang, 'en') IS DISTINCT FROM nullif(CASE WHEN b.quality = 1 THEN 'en' ELSE 'fr' END, 'en')")
def _(t):
    joined = t["documents"].join(t["labels"], "doc_id")
    a = F.nullif("lang", F.lit("en"))
    b = F.nullif(F.when(F.col("quality") == 1, "en").otherwise("fr"), F.lit("en"))
    return joined.where(~a.eqNullSafe(b)).select("doc_id")


@query("p15_distinct", "SELECT DISTINCT lang, source FROM documents")
def _(t):
    return t["documents"].select("lang", "source").distinct()


@query("p16_literal_stamp", "SELECT r_regionkey, 'v1' AS label_version, 'base' AS label_model FROM region")
def _(t):
    return t["region"].select("r_regionkey", F.lit("v1").alias("label_version"), F.lit("base").alias("label_model"))


@query("p17_non_ascii", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[^\\x00-\\x7F]')")
def _(t):
    return t["documents"].where(contains_non_ascii(F.col("text"))).select("doc_id")


@query("p18_half_open_window", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-04-01'")
def _(t):
    return window_of(t["orders"], "o_orderdate", "1997-03-01 00:00:00", "1997-04-01 00:00:00").select("o_orderkey", "o_orderdate")


@query("p21_not_equal", "SELECT s_suppkey FROM supplier WHERE nullif(s_nationkey, 3) <> 5")
def _(t):
    return t["supplier"].where(F.nullif("s_nationkey", F.lit(3)) != 5).select("s_suppkey")


@query("p23_star_and_expression", "SELECT *, length(n_name) AS name_length FROM nation")
def _(t):
    return t["nation"].withColumn("name_length", F.length("n_name").cast("long"))


#: The steps of the normalisation are the behaviour itself.
NORMALIZED = "nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({0})), '[¨¯´¸`^]', ' ', 'g'), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '')"


@query("f01_normalize_text", f"SELECT doc_id, md5({NORMALIZED.format('text')}) AS normalized_md5, length({NORMALIZED.format('text')}) AS normalized_length FROM documents")
def _(t):
    clean = t["documents"].select("doc_id", normalize_text(F.col("text")).alias("n"))
    return clean.select("doc_id", F.md5("n").alias("normalized_md5"), F.length("n").cast("long").alias("normalized_length"))


@query("f05_mojibake", "SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[^\\x00-\\x7F]')) AS non_ascii, count(*) FILTER (regexp_matches(strip_accents(text), '[^\\x00-\\x7F]')) AS mojibake FROM documents GROUP BY lang")
def _(t):
    return t["documents"].groupBy("lang").agg(F.count("*").alias("n"), F.count_if(contains_non_ascii(F.col("text"))).alias("non_ascii"), F.count_if(has_mojibake(F.col("text"))).alias("mojibake"))


@query("f06_surrogate_key", "SELECT p_partkey, md5(concat_ws('-', p_brand, coalesce(CAST(nullif(p_size, 1) AS VARCHAR), '_dbt_utils_surrogate_key_null_'))) AS sk FROM part")
def _(t):
    return t["part"].select("p_partkey", surrogate_key(F.col("p_brand"), F.nullif("p_size", F.lit(1))).alias("sk"))


@query("f07_content_hash", "SELECT doc_id, sha256(text || chr(0) || 'v1' || chr(0) || 'base') AS content_hash FROM documents")
def _(t):
    return t["documents"].select("doc_id", content_hash(F.col("text"), "v1", "base").alias("content_hash"))


@query("f10_length_bands", "SELECT CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 3000 THEN 'middle' ELSE 'long' END AS band, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def _(t):
    n = F.length("text")
    band = F.when(n < 500, "short").when(n < 3000, "middle").otherwise("long")
    return t["documents"].groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum(n).alias("chars"))


@query("f21_day_diff", "SELECT l_orderkey, l_linenumber, l_shipdate, date_diff('day', o_orderdate, l_shipdate) AS days, date_diff('day', o_orderdate, l_shipdate) < 0 AS is_early FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    joined = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    days = day_diff(F.col("l_shipdate"), F.col("o_orderdate"))
    return joined.select("l_orderkey", "l_linenumber", "l_shipdate", days.alias("days"), (days < 0).alias("is_early"))


@query("f24_month_sequence", "SELECT CAST(CAST(m AS DATE) AS VARCHAR) AS month, count(o_orderkey) AS orders FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH)) AS m) LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY 1")
def _(t):
    month = month_start(F.col("o_orderdate"))
    months = t["orders"].agg(F.min(month).alias("a"), F.max(month).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    counted = t["orders"].groupBy(month.alias("month")).agg(F.count("o_orderkey").alias("orders"))
    return months.join(counted, "month", "left").select(F.col("month").cast("string").alias("month"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query("f25_add_interval", "SELECT event_id, ts + INTERVAL 1 DAY AS next_day, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def _(t):
    return t["events"].select("event_id", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("next_day"), F.to_date("ts").cast("string").alias("day"))


@query("f33_token_cost", "SELECT doc_id, round(coalesce((n_chars / 1e6 * CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.75 END + length(source) / 1e6 * CASE lang WHEN 'en' THEN 2.0 WHEN 'de' THEN 3.0 END) * CASE WHEN n_chars > 3000 THEN 2.0 ELSE 1.0 END * CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 1.0 END, 0.0), 9) AS cost FROM documents")
def _(t):
    from ..sources.files import seed

    prices = F.broadcast(seed(t.spark, [("en", 0.5, 2.0), ("de", 0.75, 3.0)], "lang string, rate_in double, rate_out double"))
    joined = t["documents"].join(prices, "lang", "left")
    cost = token_cost(F.col("n_chars"), F.length("source"), F.col("rate_in"), F.col("rate_out"), long_from=3000, batch=F.col("doc_id") % 2 == 0)
    return joined.select("doc_id", F.round(cost, 9).alias("cost"))
