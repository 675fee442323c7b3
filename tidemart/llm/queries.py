"""Registered queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, direct_codes, exact_topk, language_id, licenses, mixing, near_duplicates, packing, prefix_trie, secrets, token_counts, warc
from .common import shared_path, table

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; TOKENIZER_DIR names another folder."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, ann.Params(k=20))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, mix = mixing.plan_for(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return mixing.report(sizes, mix)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), near_duplicates.Params(shingle_words=2, percent=80))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.fit(secrets.labelled_findings(spark))
    found = secrets.scan(table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.col("secret_start").cast("long").alias("secret_start"), F.col("secret_length").cast("long").alias("secret_length"), "rule", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    return warc.read(spark, path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), end_id=2, capacity=4096)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.sentencepiece_vocabulary(tokenizer_path(PIECES))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary, byte_fallback=True, split_marks=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, exact_topk.Params(k=5, scale=256.0))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    direct_codes.write(table(spark, sf_dir, "documents"), path, tokenizer_path(WORD_BPE), end_id=2)
    return direct_codes.read(spark, path)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), collocations.Params(min_count=30, top=2000))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, conversations = prefix_trie.rebuilt(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(turns, conversations)


#: Brute force over all rows, as SQL.
EXACT_TOPK_SQL = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.x, d.x) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

WARC_SQL = """WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, bytes,
    list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT) + 1, 1)), lambda a, b: a || b) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, bytes) AS first FROM d)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f"""

#: Sets by list functions, links by counting common shingles, components by the smallest label that can be reached.
NEAR_DUPLICATES_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM w),
r AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
u AS (SELECT rep, n, unnest(s) AS x FROM r),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),
least_of AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least(r.rep, c), doc_id) AS component_id, coalesce(least(r.rep, c), doc_id) = doc_id AS kept
FROM s LEFT JOIN r USING (s) LEFT JOIN least_of USING (rep)"""

#: All phrases by lists, cuts and inner phrases by ranges of each candidate's words.
COLLOCATIONS_SQL = r"""WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) x(k) WHERE len(w) >= k),
f AS (SELECT lang, w[i:i + k - 1] AS w, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, w, k, f AS a FROM f WHERE k > 1),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM c),
s AS (
  SELECT cut.lang, cut.w, any_value(a) AS a, min({'score': CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT), 'j': j, 'l': x.f, 'r': y.f}) AS m
  FROM cut JOIN f x ON x.lang = cut.lang AND x.w = cut.w[1:j] JOIN f y ON y.lang = cut.lang AND y.w = cut.w[j + 1:] GROUP BY cut.lang, cut.w),
inner_of AS (SELECT lang, a, w, k, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) x(m) WHERE m < k),
longest AS (SELECT lang, w[i:i + m - 1] AS w, max(a) AS longer FROM inner_of GROUP BY 1, 2),
kept AS (SELECT s.lang, array_to_string(s.w, ' ') AS phrase, a, m.l AS l, m.r AS r, m.score AS score FROM s LEFT JOIN longest USING (lang, w) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)) WHERE rank <= 2000"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_source_mix": op2_source_mix,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_secret_scan": op4_secret_scan,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_license_scan": op8_license_scan,
    "op9_exact_topk": op9_exact_topk,
    "op10_language_id": op10_language_id,
    "op11_direct_codes": op11_direct_codes,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op3_near_duplicates": NEAR_DUPLICATES_SQL, "op5_warc": WARC_SQL, "op8_license_scan": licenses.oracle_sql(), "op9_exact_topk": EXACT_TOPK_SQL, "op12_collocations": COLLOCATIONS_SQL}
