"""Prefix trie of conversations: which share their first turns, and what not storing these twice saves.

A conversation is a string of turns; ``prefixes`` has a fingerprint of each of its prefixes (128 bits, a sum over
positions, so that the turns of a very long conversation can be added up in ranges).  The trie is compacted: a node is a
place where conversations part or end, with the extent ``(parent's depth, own depth]`` on the path of one of them, its
owner.  It is hashed at its handle, the two-fattest number in that interval: the one with most trailing zero bits.

Conversations are inserted in two batches, a sample first, then all others:

1. ``located``: each of the second batch searches its exit node by fat binary search: it asks for its prefix at the
   two-fattest depth of the interval that is left, goes on behind the node found there or before that depth, and
   so needs as many steps as its length has bits.  From the last node it walks along the owner's path to the
   first turn that differs, and into the owner's child that goes on with this turn, if there is one.
2. ``inserted``: of those that leave the trie at one place with one next turn, one (by a hash, so any of them) becomes
   the owner of a new path; the others, which have this turn in common, walk along it to where they leave it.
   Groups fall apart as under a random pivot, so rounds grow with the logarithm of the number of conversations.

Counts go upwards from the last round's owners to the first's, over compacted nodes alone.  At the end edges are expanded: a
node for each depth.

``rebuilt`` makes the conversations of the contract: the first h turns of the block's first conversation, then the
own ones after the h first, h = crc32(id) % 9.

Edge cases: null roles and texts are empty; turns that are equal in number are ordered by their fingerprints, so
repeated rows are turns of their own; a null id is no conversation; a conversation without turns ends at the root; an
empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scans import running_sums
from .common import looked_up, materialize

#: Conversations share turns with the first of a block of so many, and fewer of them than ``BORROWED``.
BLOCK = 5
BORROWED = 9
#: One conversation in so many is in the first batch.
SAMPLE = 16
#: A conversation with more turns is added up in ranges.
LONG = 1000
#: Depths of an edge that are expanded at a time, and characters of ids that are joined at a time.
EDGE_BLOCK = 4096
CHUNK_CHARS = 1 << 16
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EMPTY = hashlib.sha256(b"").hexdigest()


class Built(NamedTuple):
    #: ``c, o, e, len, n1, n2, round``: owners, the owner whose path they leave (null: the root), where, and the prefix behind it.
    owners: DataFrame
    #: ``c, o, e``: conversations that end on the path of another.
    ended: DataFrame
    rounds: int


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def rebuilt(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``c, depth, t, bytes`` of every rebuilt turn (``t`` a fingerprint of role and text), and ``c, len`` of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    print_of = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    own = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("turn"), print_of.alias("t"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("_one"))
    own = materialize(own, "turns")
    placed = materialize(running_sums(own, ["c"], ["turn", "t"], {"pos": "_one"}, LONG).select("c", "pos", "t", "bytes"), "placed")
    base, h = F.col("c") - F.col("c") % BLOCK, F.crc32(F.col("c").cast("string").cast("binary")) % BORROWED
    lengths = placed.groupBy("c").agg(F.count("*").alias("n")).withColumn("base", base).withColumn("h", h)
    of_base = lengths.where("c = base").select(F.col("c").alias("base"), F.col("n").alias("_of_base"))
    lengths = materialize(lengths.join(of_base, "base", "left").withColumn("m", F.least("h", F.coalesce("_of_base", F.lit(0)))), "lengths")
    borrowed = placed.where(F.col("pos") < BORROWED).withColumnRenamed("c", "base").join(lengths.select("base", "c", "h"), "base").where("pos <= h").select("c", F.col("pos").alias("depth"), "t", "bytes")
    kept = looked_up(placed, lengths.select("c", "h", "m", "n"), ["c"], counted="n").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "t", "bytes")
    convs = lengths.select("c", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    return borrowed.unionByName(kept), convs


def prefixes(turns: DataFrame) -> DataFrame:
    """``c, depth, h1, h2, bytes, cum``: the fingerprint of every prefix, the bytes of its last turn and of all."""
    words = []
    for seed in (1, 2):
        x = F.xxhash64(F.lit(seed), F.col("t"), F.col("depth"))
        words += [x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)]
    rows = materialize(turns.select("c", "depth", "bytes", *[w.alias(f"_{k}") for k, w in enumerate(words)]), "words")
    summed = running_sums(rows, ["c"], ["depth"], {**{f"s{k}": f"_{k}" for k in range(4)}, "cum": "bytes"}, LONG)
    h = [F.xxhash64(F.lit(seed), F.col("depth"), *[F.col(f"s{k}") for k in range(4)]).alias(f"h{seed}") for seed in (1, 2)]
    return materialize(summed.select("c", "depth", *h, "bytes", "cum"), "prefixes")


def two_fattest(low: str, high: str) -> Column:
    """The number in ``(low, high]`` with most trailing zero bits."""
    k = f"length(bin({low} ^ {high})) - 1"
    return F.expr(f"shiftleft(shiftright({high}, {k}), {k})")


def walked(p: DataFrame, pairs: DataFrame) -> DataFrame:
    """``c, len, o, e, n1, n2``: where each conversation ``c`` leaves the path of ``o``, known to be behind depth ``low``,
    and its prefix one turn on (null: it ends there)."""
    rest = p.select("c", "depth", "h1", "h2").join(pairs.select("c", "o", "low"), "c").where("depth > low")
    other = p.select(F.col("c").alias("o"), "depth", F.col("h1").alias("_1"), F.col("h2").alias("_2"))
    differs = F.col("_1").isNull() | (F.col("_1") != F.col("h1")) | (F.col("_2") != F.col("h2"))
    first = rest.join(other, ["o", "depth"], "left").where(differs).groupBy("c").agg(F.min(F.struct("depth", "h1", "h2")).alias("_m"))
    return pairs.join(first, "c", "left").select("c", "len", "o", F.coalesce(F.col("_m.depth") - 1, "len").alias("e"), F.col("_m.h1").alias("n1"), F.col("_m.h2").alias("n2"))


def inserted(p: DataFrame, exits: DataFrame, first_round: int) -> Built:
    """Insert all conversations that leave the trie at ``exits`` (a table)."""
    owners, ended, number = [], [], first_round
    while True:
        ended.append(exits.where("n1 is null").select("c", "o", "e"))
        going = exits.where("n1 is not null")
        chosen = materialize(going.groupBy("e", "n1", "n2").agg(F.min(F.struct(F.xxhash64("c").alias("by"), "c", "o", "len")).alias("_r"), F.count("*").alias("_n")), "chosen")
        owners.append(chosen.select("_r.c", "_r.o", "e", "_r.len", "n1", "n2", F.lit(number).alias("round")))
        number += 1
        groups = chosen.where("_n > 1").select("e", "n1", "n2", F.col("_r.c").alias("_owner"), "_n")
        if groups.isEmpty():
            return Built(_union(owners), _union(ended), number)
        joined = looked_up(going.select("c", "len", "e", "n1", "n2"), groups, ["e", "n1", "n2"], counted="_n").where("_owner <> c")
        exits = materialize(walked(p, joined.select("c", "len", F.col("_owner").alias("o"), (F.col("e") + 1).alias("low"))), "exits")


def nodes_of(built: Built) -> DataFrame:
    """``c, pd, ed, kids, ends, least`` of every compacted node but the root: extents on owners' paths, owners that leave it, and conversations that end there."""
    none = F.lit(None).cast("long")
    marks = _union([
        built.owners.where("o is not null").select(F.col("o").alias("c"), F.col("e").alias("ed"), F.lit(1).alias("kids"), F.lit(0).alias("ends"), none.alias("least")),
        built.ended.where("o is not null").select(F.col("o").alias("c"), F.col("e").alias("ed"), F.lit(0).alias("kids"), F.lit(1).alias("ends"), F.col("c").alias("least")),
        built.owners.select("c", F.col("len").alias("ed"), F.lit(0).alias("kids"), F.lit(1).alias("ends"), F.col("c").alias("least")),
    ])
    summed = marks.groupBy("c", "ed").agg(F.sum("kids").alias("kids"), F.sum("ends").alias("ends"), F.min("least").alias("least"))
    above = F.lag("ed").over(Window.partitionBy("c").orderBy("ed"))
    return summed.join(built.owners.select("c", F.col("e").alias("_e")), "c").withColumn("pd", F.coalesce(above, "_e")).drop("_e")


def located(p: DataFrame, convs: DataFrame, built: Built, longest: int) -> DataFrame:
    """Exits of ``convs`` from the trie: see ``walked``."""
    handles = nodes_of(built).select("c", "ed", two_fattest("pd", "ed").alias("depth")).join(p, ["c", "depth"])
    handles = materialize(handles.select(F.col("depth").alias("f"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), F.col("c").alias("_o"), F.col("ed").alias("_ed")), "handles")
    at = convs.select("c", "len", F.lit(0).cast("long").alias("low"), F.col("len").alias("high"), F.lit(None).cast("long").alias("o"), F.lit(0).cast("long").alias("known"))
    prints = p.select("c", F.col("depth").alias("f"), "h1", "h2")
    for step in range(longest.bit_length()):
        asked = at.withColumn("f", F.when(F.col("low") < F.col("high"), two_fattest("low", "high")).otherwise(F.lit(-1).cast("long")))
        found = asked.join(prints, ["c", "f"], "left")
        # whoever has nothing left to ask keeps a key of its own, so that these rows stay spread
        found = found.withColumn("_1", F.coalesce("h1", "c")).withColumn("_2", F.coalesce("h2", "c")).join(handles, ["f", "_1", "_2"], "left")
        hit, asks = F.col("_o").isNotNull(), F.col("f") > 0
        at = found.select("c", "len", F.when(hit, F.least("_ed", "high")).otherwise(F.col("low")).alias("low"), F.when(asks & ~hit, F.col("f") - 1).otherwise(F.col("high")).alias("high"), F.coalesce("_o", "o").alias("o"), F.when(hit, F.col("f")).otherwise(F.col("known")).alias("known"))
        if step % 3 == 2:
            at = materialize(at, "asked")
    at = materialize(at, "asked")
    first = prints.where("f = 1").select("c", F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    at_root = at.where("o is null").join(first, "c", "left").select("c", "len", "o", F.lit(0).cast("long").alias("e"), "n1", "n2")
    exits = materialize(at_root.unionByName(walked(p, at.where("o is not null").select("c", "len", "o", F.col("known").alias("low")))), "exits")
    children = built.owners.select("e", "n1", "n2", F.col("c").alias("_child"))
    while True:  # by the theory of z-fast tries once, as the exit node or its parent has been found
        further = materialize(looked_up(exits.where("n1 is not null"), children, ["e", "n1", "n2"]), "further")
        down = further.where("_child is not null")
        if down.isEmpty():
            return exits
        below = walked(p, down.select("c", "len", F.col("_child").alias("o"), (F.col("e") + 1).alias("low")))
        exits = materialize(_union([exits.where("n1 is null"), further.where("_child is null").drop("_child"), below]), "exits")


def build(p: DataFrame, convs: DataFrame, sample: int = SAMPLE) -> Built:
    """The trie over all of ``convs`` (a table of ``c`` and ``len``)."""
    drawn = F.pmod(F.xxhash64("c"), F.lit(sample)) == 0
    first = p.where("depth = 1").select("c", F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    nowhere = convs.where(drawn).join(first, "c", "left").select("c", "len", F.lit(None).cast("long").alias("o"), F.lit(0).cast("long").alias("e"), "n1", "n2")
    begun = inserted(p, materialize(nowhere, "exits"), 0)
    longest = convs.agg(F.coalesce(F.max("len"), F.lit(0))).first()[0]
    more = inserted(p, located(p, convs.where(~drawn), begun, longest), begun.rounds)
    return Built(materialize(begun.owners.unionByName(more.owners), "owners"), materialize(begun.ended.unionByName(more.ended), "ended"), more.rounds)


def _summed(p: DataFrame, built: Built) -> tuple[DataFrame, DataFrame]:
    """Compacted nodes with what is in their subtrees, and the sums ``c, o, e, n, leaves, least, saved`` of owners' whole paths."""
    depth = p.select("c", F.col("depth").alias("ed"), "cum")
    own = built.owners.join(depth.select("c", F.col("ed").alias("e"), F.col("cum").alias("_cum_e")), ["c", "e"], "left")
    nodes = nodes_of(built).join(depth, ["c", "ed"]).join(own.select("c", "o", "e", "len", "round", F.coalesce("_cum_e", F.lit(0)).alias("_cum_e")), "c")
    nodes = materialize(nodes.withColumn("_before", F.coalesce(F.lag("cum").over(Window.partitionBy("c").orderBy("ed")), "_cum_e")), "nodes")
    done, totals = [], []
    below = Window.partitionBy("c").orderBy(F.desc("ed"))
    to_here, deeper = below.rowsBetween(Window.unboundedPreceding, 0), below.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    for number in range(built.rounds - 1, -1, -1):
        level = nodes.where(F.col("round") == number)
        if totals:
            attached = _union(totals).where("o is not null").groupBy(F.col("o").alias("c"), F.col("e").alias("ed")).agg(F.sum("n").alias("_n"), F.sum("leaves").alias("_leaves"), F.min("least").alias("_least"), F.sum("saved").alias("_saved"))
            level = level.join(attached, ["c", "ed"], "left")
        else:
            level = level.select("*", *[F.lit(None).cast("long").alias(c) for c in ("_n", "_leaves", "_least", "_saved")])
        leaf = F.when((F.col("ed") == F.col("len")) & (F.col("kids") == 0), 1).otherwise(0)
        level = level.withColumn("n", F.sum(F.col("ends") + F.coalesce("_n", zero)).over(to_here)).withColumn("leaves", F.sum(F.coalesce("_leaves", zero) + leaf).over(to_here)).withColumn("conv", F.min(F.least("least", "_least")).over(to_here))
        level = level.withColumn("_edge", (F.col("n") - 1) * (F.col("cum") - F.col("_before"))).withColumn("_saved", F.coalesce("_saved", zero))
        level = level.withColumn("below", F.coalesce(F.sum("_edge").over(deeper), zero) + F.sum("_saved").over(to_here))
        level = materialize(level.select("c", "o", "e", "len", "pd", "ed", "cum", "kids", "n", "leaves", "conv", "below", "_edge", "_saved"), "level")
        done.append(level)
        totals.append(materialize(level.groupBy("c", "o", "e").agg(F.max("n").alias("n"), F.max("leaves").alias("leaves"), F.min("conv").alias("least"), F.sum(F.col("_edge") + F.col("_saved")).alias("saved")), "totals"))
    return _union(done), _union(totals)


def digests(ends: DataFrame) -> DataFrame:
    """``o, e, sha``: of each place in ``c, o, e`` the SHA-256 of its ids, ascending and joined by commas.

    Ids are joined to chunks where ranges of them are; only chunks meet where a place's digest is taken, in their order.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, first, held, size = None, None, [], 0
        for batch in batches:
            out: list[tuple] = []
            for o, e, c in zip(*(column.to_pylist() for column in batch.columns)):
                if held and ((o, e) != place or size > CHUNK_CHARS):
                    out.append((*place, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    place, first = (o, e), c
                held.append(str(c))
                size += len(held[-1]) + 1
            yield _batch(out, ["o", "e", "first", "ids"])
        yield _batch([(*place, first, ",".join(held))] if held else [], ["o", "e", "first", "ids"])

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, digest = None, None
        for batch in batches:
            out = []
            for o, e, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if place != (o, e):
                    if digest:
                        out.append((*place, digest.hexdigest()))
                    place, digest = (o, e), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _batch(out, ["o", "e", "sha"])
        yield _batch([(*place, digest.hexdigest())] if digest else [], ["o", "e", "sha"])

    by = [F.asc_nulls_first("o"), F.asc("e"), F.asc("c")]
    ranges = ends.select("o", "e", "c").repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(chunks, "o long, e long, first long, ids string")
    return ranges.repartition("o", "e").sortWithinPartitions("o", "e", "first").select("o", "e", "ids").mapInArrow(taken, "o long, e long, sha string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"ids": pa.string(), "sha": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(name, pa.int64())) for k, name in enumerate(names)], names=names)


def trie(turns: DataFrame, convs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each node: see ``NODES``."""
    p, convs = prefixes(turns), materialize(convs, "conversations")
    built = build(p, convs, sample)
    nodes, totals = _summed(p, built)
    ends = materialize(digests(built.ended.unionByName(built.owners.select("c", F.col("c").alias("o"), F.col("len").alias("e")))), "ends")
    at_root = ends.where("o is null")

    over = totals.where("o is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("least").alias("least"))
    turnless = built.ended.where("o is null").agg(F.count("*").alias("_n"), F.min("c").alias("_least"))
    root = over.crossJoin(turnless).select(
        F.least("least", "_least").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), (F.col("n") + F.col("_n")).alias("n_convs"), F.col("kids").alias("n_children"), F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens")
    ).where("n_convs > 0")
    root = root.crossJoin(at_root.agg(F.coalesce(F.max("sha"), F.lit(EMPTY)).alias("ends_sha256")))
    root = materialize(root, "root")

    above = F.lag("conv").over(Window.partitionBy("c").orderBy("ed"))
    placed = nodes.withColumn("_above", above)
    # an owner's first node hangs below a node of the path that it leaves
    parents = nodes.select(F.col("c").alias("o"), F.col("ed").alias("e"), F.col("conv").alias("_parent"))
    tops = placed.where("pd = e and o is not null").join(parents, ["o", "e"])
    tops = tops.unionByName(placed.where("pd = e and o is null").crossJoin(F.broadcast(root.select(F.col("conv_id").alias("_parent")))))
    hung = placed.where("pd <> e").withColumn("_parent", F.col("_above")).unionByName(tops)
    hung = hung.join(ends.where("o is not null").select(F.col("o").alias("c"), F.col("e").alias("ed"), "sha"), ["c", "ed"], "left")

    starts = hung.withColumn("_from", F.explode(F.sequence(F.col("pd") + 1, F.col("ed"), F.lit(EDGE_BLOCK).cast("long"))))
    depths = starts.withColumn("depth", F.explode(F.sequence("_from", F.least(F.col("_from") + (EDGE_BLOCK - 1), "ed")))).withColumnRenamed("cum", "_cum_end")
    full = depths.join(p.select("c", "depth", "bytes", "cum"), ["c", "depth"])
    inside = F.col("depth") < F.col("ed")
    expanded = full.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("pd") + 1, F.col("conv")).otherwise(F.col("_parent")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(inside, F.lit(1)).otherwise(F.col("kids") + (F.col("ed") < F.col("len")).cast("int")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("_cum_end") - F.col("cum") + F.col("bytes"))).alias("saved_tokens"), F.when(inside, F.lit(EMPTY)).otherwise(F.coalesce("sha", F.lit(EMPTY))).alias("ends_sha256"),
    )
    return root.unionByName(expanded)
