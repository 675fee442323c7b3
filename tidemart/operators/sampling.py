"""Samples without replacement that a rerun repeats: uniform, by stratum, and to cover what labels lack."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Hexadecimal digits of the hash that one histogram tells apart, and rows that are ranked at a time.
DIGITS = 4
RANKED = 100_000
HASH_DIGITS = 32


def drawing_order(id_col: str, seed: int) -> Column:
    """The hash that rows are drawn by."""
    return F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed))))


def seeded_sample(df: DataFrame, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same ones on every run: those of the smallest hashes, ties by id.

    A histogram of the hashes' first digits finds the bucket in which the sample ends; all rows before it are taken, and only
    those inside are ranked.  A bucket that is too large to rank has a histogram of its own.
    """
    rows, before, prefix = df.withColumn("_h", drawing_order(id_col, seed)), 0, ""
    while True:
        bucket = F.substring("_h", 1, len(prefix) + DIGITS)
        counts = rows.where(F.col("_h").startswith(prefix)).groupBy(bucket.alias("p")).agg(F.count("*").alias("n")).collect()  # at most 16 ** DIGITS
        cut = None
        for p, inside in sorted(counts):
            if before + inside > n:
                cut = p
                break
            before += inside
        if cut is None:
            return df  # there are no more than n
        prefix = cut
        if inside <= RANKED or len(prefix) == HASH_DIGITS:
            break
    within = rows.where(F.col("_h").startswith(prefix)).orderBy("_h", id_col).limit(n - before)
    return rows.where(F.col("_h") < prefix).unionByName(within).drop("_h")


def stratified_sample(df: DataFrame, per_stratum: int, stratum: str, id_col: str, seed: int = 0) -> DataFrame:
    """``per_stratum`` rows of every stratum, chosen as by ``seeded_sample``."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(drawing_order(id_col, seed), id_col))
    return df.withColumn("_r", rank).where(F.col("_r") <= per_stratum).drop("_r")


def label_counts(rows: DataFrame, labels: str) -> DataFrame:
    """``label``, ``n``: rows that have each label."""
    return rows.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def covering(rows: DataFrame, deficits: Mapping[str, int], id_col: str, labels: str, most: int, seed: int = 0) -> list:
    """Ids of at most ``most`` rows picked greedily: each closes as many open deficits as any row then can, the first by hash if several do.

    The same picks as one row at a time.  A row's gain is the number of open labels that it has, and gains only fall: rows are
    picked gain by gain, from the largest, in the order of their hashes, until a label closes.  So a round needs only the
    first rows of one gain, as many as the open deficits can ask for, and there are no more rounds than labels and gains together.
    """
    pool = written(rows.select(F.col(id_col).alias("id"), F.array_distinct(labels).alias("labels"), drawing_order(id_col, seed).alias("h")), "pool")
    left, picked = {label: n for label, n in deficits.items() if n > 0}, []
    gain, passed = len(left), None
    while left and gain and len(picked) < most:
        have = F.size(F.array_intersect("labels", F.array(*map(F.lit, sorted(left)))))
        wanted = min(most - len(picked), math.ceil(sum(left.values()) / gain))
        able = pool.where(have == gain)
        if passed is not None:  # what comes before has been looked at with this gain
            able = able.where((F.col("h") > passed[0]) | (F.col("h") == passed[0]) & (F.col("id") > passed[1]))
        if picked:
            able = able.join(F.broadcast(pool.sparkSession.createDataFrame([(i,) for i in picked], pool.select("id").schema)), "id", "left_anti")
        closed = False
        for row in able.orderBy("h", "id").limit(wanted).collect():  # at most the sum of the deficits
            picked.append(row.id)
            passed = (row.h, row.id)
            for label in row.labels:
                if label in left:
                    left[label] -= 1
                    if not left[label]:
                        del left[label]
                        closed = True
            if closed or len(picked) >= most:
                break
        if not closed:  # no row of this gain is left
            gain, passed = min(gain - 1, len(left)), None
        elif len(left) < gain:
            gain, passed = len(left), None
    return picked


def deficit_sample(rows: DataFrame, size: int, *, id_col: str, labels: str, random_share: float = 0.5, floor: int = 30, min_occurrences: int = 1, seed: int = 0) -> DataFrame:
    """``id_col``, ``stratum``: a random sample, then rows that bring rare labels to ``floor`` occurrences, then random ones up to ``size``.

    Labels with fewer than ``min_occurrences`` rows aren't counted.  ``id_col`` has to be unique.
    """
    rows = written(rows.select(id_col, labels), "labelled")
    n_random = int(size * random_share)
    drawn = written(seeded_sample(rows, n_random, id_col, seed), "random")
    have = {r.label: r.n for r in label_counts(drawn, labels).collect()}
    kept = [r.label for r in label_counts(rows, labels).where(F.col("n") >= min_occurrences).collect()]  # a taxonomy's labels
    others = rows.join(drawn.select(id_col), id_col, "left_anti")
    picked = covering(others, {label: floor - have.get(label, 0) for label in kept}, id_col, labels, size - n_random, seed)
    kind = rows.schema[id_col].dataType.simpleString()
    targeted = rows.sparkSession.createDataFrame([(i,) for i in picked], f"`{id_col}` {kind}")
    spare = size - n_random - len(picked)
    top_up = seeded_sample(others.join(F.broadcast(targeted), id_col, "left_anti"), spare, id_col, seed).select(id_col)
    named = lambda df, stratum: df.select(id_col, F.lit(stratum).alias("stratum"))
    return named(drawn, "random").unionByName(named(targeted, "targeted")).unionByName(named(top_up, "top_up"))
