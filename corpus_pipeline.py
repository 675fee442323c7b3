"""A corpus pipeline of five stages: language ID, near-duplicate removal, secret
redaction, source mixing, packing.

Every stage takes what the one before it kept, as a table with the columns of
``documents``, and returns such a table; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm import language_id, mixing, near_duplicates, packing, secrets
from tidemart.llm.common import materialize, table
from tidemart.llm.queries import WORD_BPE, tokenizer_path
from tidemart.operators.ranking import global_row_number

#: Documents whose language is less certain than this go.
LEAST_LANGUAGE_SCORE = 0.5


def with_plain_names(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """``docs`` with columns that no operator adds, and what each is now called."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), lambda name: f"c{docs.columns.index(name)}"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letters, or no language that is more likely than not."""
    plain, named = with_plain_names(docs)
    found = language_id.identify(plain, language_id.fit(docs), text_col=named("text"))
    sure = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).select(*plain.columns).toDF(*docs.columns)


def with_own_ids(docs: DataFrame) -> DataFrame:
    """``row`` (all of ``docs``), ``text`` and an ``own`` id for every row: the one given, for one row of each; new
    ones after all others for rows without an id or whose id another row has, in the order of ids and of hashes.

    Where the greatest id leaves no room after it, all ids are moved down.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("given"), "text")
    repeated = materialize(rows.where("given is not null").groupBy("given").agg(F.count("*").alias("n")).where("n > 1").select("given"), "repeated-ids")
    shared = rows.where("given is null").unionByName(rows.join(repeated, "given", "left_semi"))
    if shared.isEmpty():
        return rows.select("row", "text", F.col("given").alias("own"))
    # rows that are equal throughout are told apart by where they are read
    order = [F.asc_nulls_last("given"), F.xxhash64("text").asc(), F.xxhash64("row").asc(), F.asc("tie")]
    numbered = materialize(global_row_number(shared.withColumn("tie", F.monotonically_increasing_id()), order, "place"), "shared-ids")
    first = numbered.where("given is not null").groupBy("given").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    room = numbered.agg(F.max("place")).first()[0]
    least, most = rows.agg(F.min("given"), F.max("given")).first()
    least, most = (0, -1) if most is None else (least, most)
    down = 0 if most + room < 1 << 63 else room
    if least - down < -(1 << 63):
        raise ValueError("ids leave no room for those of documents without one")
    moved, new = F.col("given") - F.lit(down), F.col("place") + F.lit(most - down)
    alone = rows.where("given is not null").join(repeated, "given", "left_anti").select("row", "text", moved.alias("own"))
    return alone.unionByName(numbered.join(first, "place", "left").select("row", "text", F.when(F.col("first"), moved).otherwise(new).alias("own")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id; one without an id only if none has one.

    Rows with one id and different texts are documents of their own.
    """
    rows = with_own_ids(docs)
    found = near_duplicates.near_duplicates(rows, near_duplicates.Params(shingle_words=5, percent=80), id_col="own")
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias("own")), "gone")
    return rows.join(gone, "own", "left_anti").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    clean = secrets.redact(docs, secrets.fit(secrets.labelled_findings(spark)))
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return clean.withColumn("n_chars", length)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, dealt to its shards."""
    plain, named = with_plain_names(docs)
    mixed = mixing.mix(plain, weights=(5, 2, 1), share=1.5, cap=2.0, id_col=named("doc_id"), text_col=named("text"), source_col=named("source"))
    return mixed.repartition("shard").sortWithinPartitions("shard", "shard_order").select(*plain.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    # executors are full of what the stages before have left, so workers remember less than they might
    return packing.pack(docs, tokenizer_path(WORD_BPE), end_id=2, capacity=4096, cache_words=100_000)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


#: Naive Bayes, the forest and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
