"""Content-addressed enrichment: fold equal texts, skip known ones, check labels, keep accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import content_hash, is_subset, sorted_distinct


def hashed(rows: DataFrame, text_col: str, version: str, model: str) -> DataFrame:
    return rows.withColumn("content_hash", content_hash(F.col(text_col), version, model))


def mapped(rows: DataFrame, cached: DataFrame, id_col: str) -> DataFrame:
    """``id_col``, ``content_hash``, ``is_cached``: a row for every text in scope, those too whose content has its result already.

    Results are joined through it, so a text that costs nothing still has to point at one.
    """
    known = cached.select("content_hash").distinct().withColumn("_known", F.lit(True))
    return rows.select(id_col, "content_hash").join(known, "content_hash", "left").select(id_col, "content_hash", F.col("_known").isNotNull().alias("is_cached"))


def todo(rows: DataFrame, cached: DataFrame, text_col: str) -> DataFrame:
    """Each content not yet cached, once."""
    return rows.groupBy("content_hash").agg(F.min(text_col).alias(text_col)).join(cached.select("content_hash").distinct(), "content_hash", "left_anti")


LABEL = "struct<i:int,aspects:array<string>,sentiment:string,severity:string,no_content:boolean>"
SENTIMENTS = ["positive", "negative", "mixed", "neutral"]


def checked_labels(responses: DataFrame, items: DataFrame, aspects: list[str] | DataFrame) -> DataFrame:
    """Every item of every batch with its label, or the reason why it has none.

    ``responses``: batch, response (a JSON array of labels).  ``items``: batch, i,
    content_hash.  ``aspects``: the known ones, as a list or, for any number, a table
    of one column.  Reasons: unparseable, out_of_range, duplicate, missing,
    unknown_aspect, bad_sentiment, bad_severity.  Of duplicates the first counts.
    """
    parsed = responses.select("batch", F.from_json("response", f"array<{LABEL}>").alias("labels"))
    each = parsed.select("batch", F.posexplode_outer("labels").alias("pos", "l")).where("pos is not null").select("batch", "pos", "l.*")
    firsts = each.groupBy("batch", "i").agg(F.min(F.struct("pos", "aspects", "sentiment", "severity", "no_content")).alias("l"), F.count("*").alias("n"))
    joined = items.join(parsed.select("batch", F.col("labels").isNull().alias("broken")), "batch", "left").join(firsts, ["batch", "i"], "left")
    if isinstance(aspects, DataFrame):
        known = aspects.toDF("known").distinct()
        used = firsts.select("batch", "i", F.explode("l.aspects").alias("used"))
        unknown = used.join(known, F.col("used").eqNullSafe(F.col("known")), "left_anti").select("batch", "i", F.lit(True).alias("unknown")).distinct()
        joined = joined.join(unknown, ["batch", "i"], "left")
        is_known = F.col("l.aspects").isNotNull() & F.col("unknown").isNull()
    else:
        is_known = F.coalesce(is_subset(F.col("l.aspects"), aspects), F.lit(False))
    severity = F.expr("try_cast(l.severity as int)")
    reason = (
        F.when(F.coalesce("broken", F.lit(True)), "unparseable")
        .when(F.col("l").isNull(), "missing")
        .when(~is_known, "unknown_aspect")
        .when(~F.coalesce(F.col("l.sentiment").isin(SENTIMENTS), F.lit(False)), "bad_sentiment")
        .when(~F.coalesce(severity.between(0, 3), F.lit(False)), "bad_severity")
    )
    label = lambda c: F.when(reason.isNull(), c)
    good = joined.select("batch", "i", "content_hash", label(sorted_distinct(F.col("l.aspects"))).alias("aspects"), label(F.col("l.sentiment")).alias("sentiment"), label(severity).alias("severity"), reason.alias("reason"))
    extra = each.join(items.select("batch", "i"), ["batch", "i"], "left_anti").select("batch", "i", F.lit("out_of_range").alias("reason"))
    again = firsts.where("n > 1").join(items.select("batch", "i"), ["batch", "i"], "left_semi").select("batch", "i", F.lit("duplicate").alias("reason"))
    odd = extra.unionByName(again).select("batch", "i", F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("array<string>").alias("aspects"), F.lit(None).cast("string").alias("sentiment"), F.lit(None).cast("int").alias("severity"), "reason")
    return good.unionByName(odd)


def token_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column, *, long_from: int | None = None, long_factor: float = 2.0, batch: Column | None = None) -> Column:
    """Price per million tokens; dearer beyond ``long_from`` input tokens, half in a batch, 0 if unpriced."""
    cost = tokens_in / F.lit(1e6) * rate_in + tokens_out / F.lit(1e6) * rate_out
    if long_from is not None:
        cost = cost * F.when(tokens_in > long_from, long_factor).otherwise(1.0)
    if batch is not None:
        cost = cost * F.when(batch, 0.5).otherwise(1.0)
    return F.coalesce(cost, F.lit(0.0))


def accounted(rows: DataFrame, pending: DataFrame, run: str, tokens: Column, cost: Column) -> DataFrame:
    """What each run over ``rows`` comes to: the contents still ``pending``, their tokens and cost; a run that finds all in the cache has a row of zeros."""
    spent = pending.groupBy(run).agg(F.count("*").alias("reviews"), F.sum(tokens).alias("input_tokens"), F.sum(cost).alias("cost_usd"))
    joined = rows.select(run).distinct().join(spent, run, "left")
    return joined.select(run, F.coalesce("reviews", F.lit(0)).alias("reviews"), F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"))


def folded(counts: DataFrame, parents: DataFrame, threshold: Column | float) -> DataFrame:
    """Aspects below ``threshold`` become their parent, or go without one."""
    joined = counts.join(F.broadcast(parents), "aspect", "left")
    return joined.select("aspect", F.when(F.col("n") >= threshold, F.col("aspect")).otherwise(F.col("parent_aspect")).alias("folded_into"), "n")
