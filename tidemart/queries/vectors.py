"""Vector search and JSON arrays."""

from pyspark.sql import functions as F

from ..functions import is_subset, l2_norm, sorted_distinct, string_array
from ..operators.ranking import vector_topk
from .registry import query

TOP = """(SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 10)"""


def _top(t):
    return vector_topk(t["embeddings"], t["embeddings"].where("vec_id % 100 = 0"), 10, id_col="vec_id", vector_col="embedding")


@query("v06_vector_topk", f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM {TOP}")
def _(t):
    return _top(t).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("v06_vector_topk_with_text", f"SELECT query_id, rank, vec_id, lang, n_chars FROM {TOP} JOIN documents ON doc_id = vec_id")
def _(t):
    hits = _top(t).select("query_id", "rank", "vec_id")
    return hits.join(t["documents"], F.col("vec_id") == F.col("doc_id")).select("query_id", "rank", "vec_id", "lang", "n_chars")


@query("v06_vector_topk_with_orders", f"SELECT query_id, rank, vec_id, o_orderkey FROM {TOP} JOIN orders ON o_custkey = vec_id")
def _(t):
    hits = _top(t).select("query_id", "rank", "vec_id")
    return t["orders"].join(hits, F.col("o_custkey") == F.col("vec_id")).select("query_id", "rank", "vec_id", "o_orderkey")


@query("v06_vector_topk_by_label", f"SELECT query_id, label, count(*) AS hits, max(round(score, 6)) AS best FROM {TOP} JOIN embeddings USING (vec_id) GROUP BY 1, 2")
def _(t):
    joined = _top(t).join(t["embeddings"].select("vec_id", "label"), "vec_id")
    return joined.groupBy("query_id", "label").agg(F.count("*").alias("hits"), F.max(F.round("score", 6)).alias("best"))


@query("v07_vector_checks", "SELECT len(embedding) AS size, count(*) AS n, count(*) FILTER (abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 0.001) AS off_norm FROM embeddings GROUP BY 1")
def _(t):
    off = F.abs(l2_norm(F.col("embedding")) - 1) > 0.001
    return t["embeddings"].groupBy(F.size("embedding").cast("long").alias("size")).agg(F.count("*").alias("n"), F.count_if(off).alias("off_norm"))


@query("v01_unnest_json", "SELECT conv_id, turn, unnest(CASE WHEN turn % 2 = 0 THEN [role, 'x'] ELSE [] END) AS tag FROM conversations")
def _(t):
    tags = F.when(F.col("turn") % 2 == 0, F.to_json(F.array(F.col("role"), F.lit("x")))).otherwise(F.lit("[]"))
    return t["conversations"].select("conv_id", "turn", F.explode(string_array(tags)).alias("tag"))


@query("v03_json_values", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t["events"].select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("v04_sorted_distinct", "SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM documents GROUP BY source")
def _(t):
    return t["documents"].groupBy("source").agg(F.collect_set("lang").alias("l")).select("source", F.array_join(sorted_distinct(F.col("l")), ",").alias("langs"))


@query("v10_array_in_enum", "SELECT source, len(list_filter(list_distinct(list(lang)), lambda x: x NOT IN ('de', 'en', 'fr'))) = 0 AS is_known FROM documents GROUP BY source")
def _(t):
    return t["documents"].groupBy("source").agg(is_subset(F.collect_set("lang"), ["de", "en", "fr"]).alias("is_known"))
