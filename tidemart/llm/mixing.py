"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is permuted by a seeded hash of its documents and cut into blocks of
about ``block_docs`` along that order.  A source whose target is ``e`` times its
size and a rest has a quota of all its blocks ``e`` times, then of as many more as
reach the rest; the last of them gives single documents that add up to what is
left.  A splitting tree deals these exact quotas to the output shards: halves of
the shards again and again, drawing at each node how many blocks of every group of
sources go to the left half (multivariate hypergeometric: as if all blocks were
shuffled and dealt); inside a group, halves of its sources over the slots that the
group has in every shard, in the same way.  Each shard then draws the next blocks
of its sources' permutations, disjoint from all other shards' within a round, and
shuffles locally by a hash of document and round.  What the mix takes of a
document is the number of draws of its block, nothing else.

Sources stay in tables.  The driver sees sums, and the block counts of at most
``GROUPS`` groups of sources by shard.  Rows meet their source's figures and their
block's draws in joins whose keys are bounded, hot sources included.

Targets: weights are dealt to sources in code-point order, null last, repeating;
a target stops at ``cap`` times its source's size, and the excess is shared out
again by weight until none is above.

Edge cases: a null source is a source; a null or empty text has size 0 and takes
no words; rows with equal id and text are taken together, unless there are more of
them than a block holds (these are told apart by numbers; as they are equal, what is
taken doesn't depend on how the table is cut); a null id is an id like others;
sources of size 0 get target 0; an empty table gives an empty result; other
columns are kept by ``mix`` unless called like one that it adds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from ..operators.scans import running_sums
from .common import looked_up, materialize, scratch, without, word_count

BLOCK_DOCS = 64
GROUPS = 512
MAX_SHARDS = 4096
#: An end block's documents are fitted in units of so small a part of their sum (of one word, if that is more).
FIT_STEPS = 1_000_000
#: NumPy's bound on what one hypergeometric draw is made from; with more blocks than that, blocks are larger.
MAX_BLOCKS = 900_000_000
#: More equal rows than this are numbered in ranges.
CROWD = 1000
#: Blocks whose words are added up together on the way to a source's last block.
STRIDE = 1 << 16


def fitting(sizes: Sequence[int], room: float) -> list[bool]:
    """Which of ``sizes``, early ones first, add up to ``room`` as nearly as may be; bit s of a step is set if s can be reached."""
    unit = max(1, -(-sum(sizes) // FIT_STEPS))
    sizes, room = [-(-n // unit) for n in sizes], max(0.0, room / unit)
    steps = [1]
    for n in reversed(sizes):
        steps.append(steps[-1] | steps[-1] << n)
    reach = steps[-1]
    low = (reach & ((1 << int(room) + 1) - 1)).bit_length() - 1
    above = reach >> int(room) + 1
    high = int(room) + 1 + (above & -above).bit_length() - 1 if above else low
    left = high if high - room < room - low else low
    take = []
    for k, n in enumerate(sizes):
        rest = steps[len(sizes) - 1 - k]
        take.append(0 < n <= left and bool(rest >> left - n & 1))
        left -= n if take[-1] else 0
    return take


def split_quotas(blocks: Sequence[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each group's ``blocks`` go to each shard (shards x groups), by halving the shards."""
    out = np.zeros((shards, len(blocks)), dtype=np.int64)

    def split(have: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            out[first] = have
            return
        left = n // 2
        some = rng.multivariate_hypergeometric(have, int(round(have.sum() * left / n)), method="marginals") if len(have) else have
        split(some, first, left)
        split(have - some, first + left, n - left)

    split(np.array(blocks, dtype=np.int64), 0, shards)
    return out


def deal(blocks: np.ndarray, slots: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """For one source after another, how many of its ``blocks`` are in each shard's ``slots``, by halving the sources."""
    if len(blocks) == 1:
        yield slots
        return
    half = len(blocks) // 2
    left = rng.multivariate_hypergeometric(slots, int(blocks[:half].sum()), method="marginals")
    yield from deal(blocks[:half], left, rng)
    yield from deal(blocks[half:], slots - left, rng)


@dataclass(frozen=True)
class Mix:
    """``sources``: key, source_size, target, blocks.  ``dealt``: a row for each drawn block: key, block, round, shard,
    and whether it is the ``last``, of which only ``chosen`` (key, h) are drawn.  ``crowded``: key and h of rows told apart."""

    sources: DataFrame
    dealt: DataFrame
    chosen: DataFrame
    crowded: DataFrame
    shards: int
    seed: int


def described(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """``key``, ``h``, ``at`` of a row: its source, a hash of its id and text, and where it was read."""
    source = F.col(source_col).cast("string")
    ident = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")), F.lit(seed))
    return [F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)).alias("key"), ident.alias("h"), F.monotonically_increasing_id().alias("at")]


def told_apart(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """``rows`` with an ``h`` of their own where too many share one; ``at`` goes.

    These have equal ids and texts, so they are numbered in any order: however the table is cut, the same hashes are given.
    """
    if crowded.isEmpty():
        return rows.drop("at")
    many = materialize(rows.join(crowded, ["key", "h"], "left_semi").withColumn("_one", F.lit(1)), "crowded-rows", keep=True)
    numbered = running_sums(many, ["key", "h"], ["at"], {"_number": "_one"}, CROWD).withColumn("h", F.xxhash64("h", "_number"))
    return rows.join(crowded, ["key", "h"], "left_anti").drop("at").unionByName(numbered.drop("at", "_one", "_number"))


def _block(h: Column, blocks: Column) -> Column:
    """The block, along the order of hashes, of a row."""
    return F.least(F.floor(F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53)) * blocks).cast("long"), blocks - 1)


def with_targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """``sources`` (size, weight) with ``target``: ``share`` of all sizes by weight, none above ``cap`` times its size.

    Sources that the present level puts above their cap are fixed there and the level rises for the others, until it
    stays; each step is one aggregate, and only sums reach the driver.
    """
    some = sources.where("size > 0")
    level, total = 0.0, None
    full = F.col("weight") * F.lit(0.0) > cap * F.col("size")
    while True:
        all_size, full_size, free, n = some.agg(F.sum("size"), F.sum(F.when(full, F.col("size")).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)), F.count_if(full)).first()
        total = min(share, cap) * (all_size or 0)
        before, level = level, (total - cap * full_size) / free if free else level
        if not free or level <= before:
            break
        full = F.col("weight") * F.lit(level) > cap * F.col("size")
    return sources.withColumn("target", F.when(F.col("size") > 0, F.least(F.col("weight") * F.lit(level) if free else F.lit(float("inf")), F.lit(float(cap)) * F.col("size"))).otherwise(0.0))


def last_blocks(words: DataFrame, sources: DataFrame) -> DataFrame:
    """``key``, ``cut``, ``room``: each source's block in which its rest ends, and what is left for it.

    Sums run over strides of blocks, then over the blocks of one stride, so no task sorts all blocks of a source.
    """
    before = lambda order: F.sum("words").over(Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    rest = sources.select("key", "rest")
    strides = words.groupBy("key", F.floor(F.col("block") / STRIDE).alias("stride")).agg(F.sum("words").alias("words")).withColumn("before", before("stride"))
    strides = strides.join(rest, "key").where("before + words > rest").groupBy("key").agg(F.min(F.struct("stride", "before", "rest")).alias("s")).select("key", "s.*")
    inside = words.withColumn("stride", F.floor(F.col("block") / STRIDE)).join(strides.withColumnRenamed("before", "earlier"), ["key", "stride"])
    inside = inside.withColumn("before", F.col("earlier") + before("block")).where("before + words > rest")
    return inside.groupBy("key").agg(F.min(F.struct("block", (F.col("rest") - F.col("before")).alias("room"))).alias("e")).select("key", F.col("e.block").alias("cut"), "e.room")


def plan(sizes: DataFrame, weights: Sequence[float], *, share: float, cap: float, shards: int | None, words_per_shard: int, block_docs: int, seed: int) -> tuple[DataFrame, Mix]:
    """The rows of ``sizes`` (key, h, at, doc_id, size, source) with their blocks, and the mix decided from them."""
    spark = sizes.sparkSession
    rows, words = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block_docs = max(block_docs, -(-rows * (int(cap) + 1) // MAX_BLOCKS))
    crowded = materialize(sizes.groupBy("key", "h").agg(F.count("*").alias("n")).where(F.col("n") > block_docs).select("key", "h"), "crowded", keep=True)

    found = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("size"), F.count("*").alias("n"))
    placed = global_row_number(found, [F.asc("key")], "place")  # the key of a null source comes last
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    weighed = materialize(placed.withColumn("weight", weight), "sources")
    rounds = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    decided = with_targets(weighed, share, cap).withColumn("rounds", rounds).withColumn("rest", F.col("target") - F.col("rounds") * F.col("size")).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / block_docs)).cast("long"))
    decided = materialize(decided.withColumnRenamed("size", "source_size"), "targets", keep=True)

    blocked = looked_up(told_apart(sizes, crowded), decided.select("key", "source_size", "target", "blocks"), ["key"])
    blocked = materialize(blocked.withColumn("block", _block(F.col("h"), F.col("blocks"))), "blocks", keep=True)
    per_block = materialize(blocked.groupBy("key", "block").agg(F.sum("size").alias("words")), "words")
    ends = materialize(last_blocks(per_block, decided), "ends")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        docs = group.groupby("h", as_index=False).agg(key=("key", "first"), size=("size", "sum"), room=("room", "first")).sort_values("h")
        return docs.loc[fitting(docs["size"].tolist(), float(docs["room"].iloc[0])), ["key", "h"]]

    last = blocked.join(ends.withColumnRenamed("cut", "block"), ["key", "block"]).select("key", "h", "size", "room")
    chosen = materialize(last.groupBy("key").applyInPandas(fill, "key string, h long"), "chosen", keep=True)

    each = decided.join(ends, "key", "left")
    quota = F.col("rounds") * F.col("blocks") + F.coalesce("cut", F.lit(0)) + F.coalesce(F.col("room") > 0, F.lit(False)).cast("int")
    several = max(1, -(-weighed.count() // GROUPS))
    each = materialize(each.select("key", "place", F.floor((F.col("place") - 1) / several).cast("int").alias("group"), "blocks", "rounds", F.coalesce("cut", F.lit(-1)).alias("cut"), quota.alias("quota")), "quotas")
    n = shards or max(1, min(MAX_SHARDS, -(-int(min(share, cap) * words) // words_per_shard)))
    totals = [r["n"] for r in each.groupBy("group").agg(F.sum("quota").alias("n")).orderBy("group").collect()]
    slots = spark.sparkContext.broadcast(split_quotas(totals, n, np.random.default_rng(seed)))

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group, g, out = group.sort_values("place"), int(group["group"].iloc[0]), []
        for row, counts in zip(group.itertuples(), deal(group["quota"].to_numpy(), slots.value[:, g], np.random.default_rng([seed, g]))):
            drawn = np.flatnonzero(counts)
            out.append(pd.DataFrame({"key": row.key, "blocks": row.blocks, "rounds": row.rounds, "cut": row.cut, "shard": drawn.astype(np.int32), "first": (np.cumsum(counts) - counts)[drawn], "n": counts[drawn]}))
        return pd.concat(out)

    runs = each.groupBy("group").applyInPandas(draw, "key string, blocks long, rounds long, cut long, shard int, first long, n long")
    place = runs.withColumn("place", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    drawn = place.select("key", (F.col("place") % F.col("blocks")).alias("block"), F.floor(F.col("place") / F.col("blocks")).alias("round"), "shard", "rounds", "cut")
    dealt = drawn.select("key", "block", "round", "shard", ((F.col("round") == F.col("rounds")) & (F.col("block") == F.col("cut"))).alias("last"))
    return blocked, Mix(decided.select("key", "source_size", "target", "blocks"), materialize(dealt, "dealt", keep=True), chosen, crowded, n, seed)


def plan_for(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int | None = None, words_per_shard: int = 5_000_000, block_docs: int = BLOCK_DOCS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, Mix]:
    """The sizes and blocks of all rows, and the mix decided from them."""
    sizes = docs.select(*described(docs, seed, id_col, text_col, source_col), F.col(id_col).cast("long").alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).cast("string").alias("source"))
    with scratch(docs.sparkSession):
        return plan(materialize(sizes, "sizes"), weights, share=share, cap=cap, shards=shards, words_per_shard=words_per_shard, block_docs=block_docs, seed=seed)


def report(blocked: DataFrame, mix: Mix) -> DataFrame:
    """What the shards draw of every document: doc_id, size, source_size, target, taken, source."""
    draws = mix.dealt.groupBy("key", "block").agg(F.count_if(~F.col("last")).alias("draws"), F.bool_or("last").alias("last"))
    rows = blocked.join(draws, ["key", "block"], "left").join(mix.chosen.withColumn("chosen", F.lit(True)), ["key", "h"], "left")
    times = F.coalesce("draws", F.lit(0)) + F.coalesce(F.col("last") & F.col("chosen"), F.lit(False)).cast("int")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), "source")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix, a document as often as it is drawn, with ``shard`` and ``shard_order``."""
    _, decided = plan_for(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    kept = without(docs, ["shard", "shard_order"]).columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *described(docs, decided.seed, id_col, text_col, source_col))
    rows = told_apart(looked_up(rows, decided.sources.select("key", "blocks"), ["key"]), decided.crowded).withColumn("block", _block(F.col("h"), F.col("blocks")))
    drawn = rows.join(decided.dealt, ["key", "block"]).join(decided.chosen.withColumn("chosen", F.lit(True)), ["key", "h"], "left")
    drawn = drawn.where(~F.col("last") | F.coalesce("chosen", F.lit(False)))
    order = F.xxhash64("h", "round", F.lit(decided.seed + 1))
    return drawn.select("row.*", "shard", order.alias("shard_order"))
