"""Joins, sorts, limits, samples and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ranking import batched
from ..operators.sampling import seeded_sample, stratified_sample
from ..operators.segments import complete_grid
from .registry import query


@query("j01_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j03_left_unknown", "SELECT o_orderkey, coalesce(f, 'unknown') AS first_flag FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def _(t):
    first = t["lineitem"].groupBy("l_orderkey").agg(F.min("l_returnflag").alias("f"))
    return t["orders"].join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("f", F.lit("unknown")).alias("first_flag"))


@query("j04_left_derived", "SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(t):
    counted = t["orders"].groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t["customer"].join(counted, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("j05_scalar_anchor", "SELECT o_orderkey, date_diff('day', o_orderdate, a.as_of) AS age_days FROM orders CROSS JOIN (SELECT max(o_orderdate) AS as_of FROM orders) a")
def _(t):
    anchor = F.broadcast(t["orders"].agg(F.max("o_orderdate").alias("as_of")))
    return t["orders"].crossJoin(anchor).select("o_orderkey", F.datediff(F.to_date("as_of"), F.to_date("o_orderdate")).cast("long").alias("age_days"))


@query("j06_complete_grid", "SELECT l.lang, s.source, count(d.doc_id) AS docs, count(b.doc_id) AS labelled FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN documents d ON d.lang = l.lang AND d.source = s.source LEFT JOIN labels b ON b.doc_id = d.doc_id GROUP BY 1, 2")
def _(t):
    grid = complete_grid(t["documents"].select("lang").distinct(), t["documents"].select("source").distinct())
    counted = t["documents"].join(t["labels"].select("doc_id", F.lit(1).alias("one")), "doc_id", "left").groupBy("lang", "source").agg(F.count("*").alias("d"), F.count("one").alias("b"))
    full = grid.join(counted, ["lang", "source"], "left")
    return full.select("lang", "source", F.coalesce("d", F.lit(0)).alias("docs"), F.coalesce("b", F.lit(0)).alias("labelled"))


@query("j08_three_way", "SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(t):
    joined = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("customers"))


@query("j09_fan_out", "SELECT o_orderkey, l_partkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_discount > 0.05")
def _(t):
    lines = t["lineitem"].where("l_discount > 0.05")
    return t["orders"].join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_partkey", "l_linenumber")


@query("j10_hash_bridge", "WITH m AS (SELECT doc_id, sha256(text) AS h FROM documents), r AS (SELECT h, min(doc_id) AS first_doc, count(*) AS copies FROM m GROUP BY h) SELECT doc_id, first_doc, copies FROM m JOIN r USING (h)")
def _(t):
    bridge = t["documents"].select("doc_id", F.sha2("text", 256).alias("h"))
    results = bridge.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    return bridge.join(results, "h").select("doc_id", "first_doc", "copies")


@query("j11_two_hash_bridge", "WITH e AS (SELECT sha256(text || 'e') AS eh, text FROM documents GROUP BY text), l AS (SELECT sha256(text || 'l') AS lh, min(doc_id) AS doc_id FROM documents GROUP BY text) SELECT doc_id, eh FROM e JOIN l ON l.lh = sha256(e.text || 'l')")
def _(t):
    texts = t["documents"].select("text").distinct()
    embedded = texts.select(F.sha2(F.concat("text", F.lit("e")), 256).alias("eh"), F.sha2(F.concat("text", F.lit("l")), 256).alias("lh"))
    labelled = t["documents"].groupBy(F.sha2(F.concat("text", F.lit("l")), 256).alias("lh")).agg(F.min("doc_id").alias("doc_id"))
    return embedded.join(labelled, "lh").select("doc_id", "eh")


@query("j12_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    some = t["orders"].where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t["customer"].join(some, "c_custkey", "left_semi").select("c_custkey")


@query("j13_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t["documents"].join(t["labels"], "doc_id", "left_anti").select("doc_id")


@query("j15_two_runs", "SELECT a.conv_id, a.n AS user_turns, b.n AS other_turns FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1) a JOIN (SELECT conv_id, count(*) AS n FROM conversations WHERE role <> 'user' GROUP BY 1) b USING (conv_id)")
def _(t):
    a = t["conversations"].where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("user_turns"))
    b = t["conversations"].where("role <> 'user'").groupBy("conv_id").agg(F.count("*").alias("other_turns"))
    return a.join(b, "conv_id")


@query("j17_theta", "SELECT r_name, count(*) AS larger FROM region JOIN nation ON n_nationkey > r_regionkey GROUP BY r_name")
def _(t):
    return t["region"].join(t["nation"], F.col("n_nationkey") > F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("larger"))


@query("j18_degenerate", "SELECT n_name, r_name FROM nation JOIN region ON r_name IS NOT NULL")
def _(t):
    return t["nation"].crossJoin(t["region"].where("r_name is not null")).select("n_name", "r_name")


@query("j19_lateral_unnest", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def _(t):
    return t["part"].select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"))


@query("j20_scalar_totals", "SELECT a.n AS orders, b.n AS order_keys FROM (SELECT count(*) AS n FROM orders) a CROSS JOIN (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem) b")
def _(t):
    return t["orders"].agg(F.count("*").alias("orders")).crossJoin(t["lineitem"].agg(F.countDistinct("l_orderkey").alias("order_keys")))


@query("o01_order_by", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def _(t):
    top = t["orders"].orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)
    return top.select("o_orderkey", "o_totalprice", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


@query("o02_order_by_gap", "SELECT lang, abs(coalesce(max(CASE WHEN source = 'src1' THEN n END), 0) - coalesce(max(CASE WHEN source = 'src2' THEN n END), 0)) AS gap FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY lang ORDER BY gap DESC, lang")
def _(t):
    counted = t["documents"].groupBy("lang", "source").agg(F.count("*").alias("n"))
    one = lambda s: F.coalesce(F.max(F.when(F.col("source") == s, F.col("n"))), F.lit(0))
    return counted.groupBy("lang").agg(F.abs(one("src1") - one("src2")).alias("gap")).orderBy(F.desc("gap"), "lang")


@query("o08_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '-7'), doc_id LIMIT 50")
def _(t):
    return seeded_sample(t["documents"].select("doc_id"), 50, "doc_id", 7)


@query("o09_stratified_sample", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '-3'), doc_id) AS r FROM documents) WHERE r <= 10")
def _(t):
    return stratified_sample(t["documents"].select("lang", "doc_id"), 10, "lang", "doc_id", 3)


@query("o10_batches", "SELECT source, b AS batch, count(*) AS size, min(doc_id) AS first_doc FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS b FROM documents) GROUP BY 1, 2")
def _(t):
    return batched(t["documents"].select("source", "doc_id"), 20, "source", "doc_id").groupBy("source", "batch").agg(F.count("*").alias("size"), F.min("doc_id").alias("first_doc"))


@query("o11_union_all", "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def _(t):
    return t["nation"].select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")).unionByName(t["region"].select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))


@query("o12_set_difference", "(SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels) EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def _(t):
    labelled = t["documents"].where("lang = 'en'").select("doc_id").intersect(t["labels"].select("doc_id"))
    return labelled.subtract(t["labels"].where("toxic = 1").select("doc_id"))
