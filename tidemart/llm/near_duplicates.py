"""Near-duplicate documents by chosen-path set similarity join.

A document is the set of its distinct word shingles.  Rows with equal sets are
folded first: one row, that of the smallest id, stands for each distinct set.
Every set gets minwise values, each by a hash function of its own.  In each of
several independent trees a node has ``branches`` of these functions for itself and
a set goes to one child for each, named by its minwise token there; sets that
agree in much end up together.  After ``depth`` levels:

1. in every node the smallest id is paired with each other member, and in a node
   of more than ``led_from`` members so are a few others, the first in other orders, so
   that they are the same ones in most nodes of a large group;
2. pairs whose sizes and parities allow it are confirmed on the full sets;
3. nodes whose members the links leave apart are compared exhaustively between
   the parts.  Members outside a node's largest part are dealt in probes and
   all its members in blocks, both of at most about ``node_limit`` members and
   ``node_shingles`` shingles, and each set of probes meets each block in a group of
   its own; a pair that meets in several nodes is looked at in the first.  Members
   of pairs that sizes and parities allow meet once more, with their full sets,
   and only links leave the group;
4. the links of both rounds are joined into components.

Members already known to be connected aren't paired again, so a group of n copies
costs a small multiple of n pairs.  No two nodes share a hash function, so a link of
similarity s is missed by one tree with probability q(depth), q(k) =
(1 - s + s q(k - 1)) ** branches, q(0) = 0, and the trees miss independently.  With two
branches q is 0.059 at the limit of 0.8 after three levels and never above 0.0625,
so five trees miss less than one such link in a million, whatever the depth.  With
more documents there are more levels, so that nodes stay small.  Nothing else can
miss a link: a set's parities are one bit for each of ``PARITY_BITS`` residues of its
hashes, the parity of their number; two sets differ in at least as many shingles
as their parities in bits, so a pair is only left out when its full sets can't
reach ``percent``, whatever that is.

Words are runs of characters other than ASCII white space, after lower-casing A-Z.

Edge cases: a null text or one without words has the empty set and is linked with
nothing; fewer words than a shingle has make one shingle; rows repeated with one
id are one vertex, and each of them is returned; a null id takes no part (its
component is null, and it isn't kept); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, bounded_batches, let_go, looked_up, materialize, parts, scratch
from .components import connected_components

_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)
#: Bits of a set's parities, a multiple of 64.
PARITY_BITS = 1024


@dataclass(frozen=True)
class Params:
    shingle_words: int = 5
    percent: int = 80
    trees: int = 5
    #: Levels; by default three, and one more for each 20-fold number of documents beyond ``docs_at_three``.
    depth: int | None = None
    docs_at_three: int = 4_000_000
    branches: int = 2
    leaders: int = 6
    led_from: int = 16
    node_limit: int = 512
    node_shingles: int = 2_000_000
    seed: int = 20240601

    @property
    def levels(self) -> int:
        return self.depth or 3

    @property
    def coordinates(self) -> int:
        """Minwise values of a set: ``branches`` for each node of each tree."""
        return self.trees * sum(self.branches ** (level + 1) for level in range(self.levels))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    tokens = (text or "").encode("utf-8", "replace").translate(ASCII_LOWER).split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    n = min(words, len(tokens))
    rolled = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        rolled = rolled * _K + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(rolled + np.uint64(n)))


def _signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 8192):
        np.minimum(least, (shingles[None, at : at + 8192] * factors[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each residue has an odd number of hashes, as bits."""
    odd = np.bincount((shingles % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool))


def _may_link(n_a: np.ndarray, n_b: np.ndarray, parity_a: np.ndarray, parity_b: np.ndarray, p: Params) -> np.ndarray:
    """Whether sets of these sizes and parities can be similar enough; no pair that is gets False.

    ``common / (n_a + n_b - common) >= percent / 100`` is the same as
    ``differing * (100 + percent) <= (n_a + n_b) * (100 - percent)``.
    """
    differing = np.bitwise_count(parity_a ^ parity_b).sum(axis=-1, dtype=np.int64)
    return differing * (100 + p.percent) <= (n_a + n_b) * (100 - p.percent)


def _factors(p: Params) -> np.ndarray:
    return np.random.default_rng(p.seed).integers(0, 1 << 62, p.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _tree_leaves(sig: np.ndarray, p: Params) -> np.ndarray:
    """The last nodes (rows x nodes) that each row's signature leads to; equal places are the same path of choices."""
    nodes = np.broadcast_to(_mix((np.arange(p.trees, dtype=np.uint64) + np.uint64(1)) * _K + np.uint64(p.seed)), (len(sig), p.trees))
    at = 0
    for _ in range(p.levels):
        children = np.repeat(nodes, p.branches, axis=1)
        own = np.arange(at, at := at + children.shape[1])
        nodes = _mix(children * _K + _mix(sig[:, own].astype(np.uint64) * _K + (own + 1).astype(np.uint64)))
    return nodes


def _matrix(column: pa.Array, coordinates: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, coordinates)


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, PARITY_BITS // 64)


def sketch(docs: DataFrame, p: Params, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n`` shingles, ``digest`` of the whole set, ``sig`` and ``parity`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        factors = _factors(p)
        for batch in batches:
            n, digest, sig, parity = [], [], [], []
            for text in chain.from_iterable(parts(batch.column(1))):
                shingles = shingle_set(text, p.shingle_words)
                n.append(len(shingles))
                digest.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                sig.append(_signature(shingles, factors).tobytes() if len(shingles) else None)
                parity.append(_parities(shingles).tobytes() if len(shingles) else None)
            columns = [pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (digest, sig, parity))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "digest", "sig", "parity"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n long, digest binary, sig binary, parity binary")


def _leaves(reps: DataFrame, p: Params) -> DataFrame:
    """``node``, ``rep`` for the last level of all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes = _tree_leaves(_matrix(batch.column(1), p.coordinates), p)
                rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), nodes.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), pa.array(rep, pa.int64())], names=["node", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "node long, rep long")


def _allowed(rows: DataFrame, p: Params) -> DataFrame:
    """``a``, ``b`` of the pairs (with ``n`` and ``parity`` of both) that sizes and parities allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(_may_link(n_a, n_b, _bits(batch.column(4)), _bits(batch.column(5)), p)))

    near = rows.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * p.percent)
    return near.select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(run, "a long, b long")


def _candidates(group: pa.RecordBatch, p: Params) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each probe of a group: its row, the rows of likely partners that it first meets here, and all rows' parts.

    The parts may be changed meanwhile; rows of the probe's own part are left out.
    """
    comp, n, probe = (group.column(c).to_numpy(zero_copy_only=False).copy() for c in ("component", "n", "probe"))
    sig, parity = _matrix(group.column("sig"), p.coordinates), _bits(group.column("parity"))
    node, leaves = np.int64(group.column("node")[0].as_py()).view(np.uint64), _tree_leaves(sig, p)
    for i in np.flatnonzero(probe):
        j = np.flatnonzero((comp != comp[i]) & (np.minimum(n[i], n) * 100 >= np.maximum(n[i], n) * p.percent))
        j = j[_may_link(n[i], n[j], parity[i], parity[j], p)]
        if len(j):
            first = (leaves[j] == leaves[i]).argmax(axis=1)
            yield i, j[leaves[i][first] == node], comp


def _grouped(rows: DataFrame, solve: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``solve`` over all groups of ``node``, ``part``, ``block``, one group held at a time."""
    keys = ["node", "part", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def solved() -> pa.RecordBatch:
            return solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

        for batch in batches:
            at = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(at)] if len(at) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if held and tuple(at[lo]) != key:
                    yield solved()
                    held = []
                key = tuple(at[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield solved()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _involved(dealt: DataFrame, p: Params) -> DataFrame:
    """Those rows of ``dealt`` that belong to a likely pair."""

    def solve(group: pa.RecordBatch) -> pa.RecordBatch:
        mask = np.zeros(group.num_rows, dtype=bool)
        for i, j, _ in _candidates(group, p):
            mask[j] = True
            mask[i] |= len(j) > 0
        return group.filter(pa.array(mask))

    return _grouped(dealt, solve, ", ".join(f"{c} {t}" for c, t in dealt.dtypes))


def _links_across(involved: DataFrame, full: DataFrame, p: Params) -> DataFrame:
    """``a``, ``b``: links between parts of a node, enough to join what belongs together."""

    def solve(group: pa.RecordBatch) -> pa.RecordBatch:
        rep, sets = group.column("rep").to_numpy(zero_copy_only=False), [np.frombuffer(x.as_py(), dtype=np.uint64) for x in group.column("shingles")]
        found: list[tuple[int, int]] = []
        for i, near, comp in _candidates(group, p):
            for j in near:
                if comp[j] != comp[i]:
                    x, y = sets[i], sets[j]
                    common = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
                    if 100 * common >= p.percent * (len(x) + len(y) - common):
                        found.append((rep[i], rep[j]))
                        comp[comp == comp[j]] = comp[i]
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    rows = involved.join(full.select(F.col("id").alias("rep"), "shingles").hint("merge"), "rep")
    return materialize(_grouped(rows, solve, "a long, b long"), "links")


def _open_nodes(members: DataFrame, parts: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of nodes that the links leave apart, and each such node's figures."""
    # nodes of two are done: their only pair has been compared
    known = reps.select("rep", "n").join(parts, "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("component"))
    rows = members.where("size > 2").select("node", "rep").join(known, "rep")
    counts = rows.groupBy("node", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    nodes = counts.groupBy("node").agg(F.sum("c").alias("size"), F.sum("n").alias("shingles"), F.count("*").alias("components"), F.max(F.struct("c", "component", "n")).alias("major")).where("components > 1")
    minor = [(F.col("size") - F.col("major.c")).alias("minor"), (F.col("shingles") - F.col("major.n")).alias("minor_shingles")]
    return rows.select("node", "rep", "component"), nodes.select("node", "size", "shingles", F.col("major.component").alias("major"), *minor)


def _stars(members: DataFrame, p: Params) -> DataFrame:
    """``a`` < ``b``: the leaders of each node with its other members."""
    masks = [int(x) for x in np.random.default_rng(p.seed).integers(0, 1 << 40, p.leaders)]
    # a mask gives an order of ids, and can be taken off again; small nodes have the first order alone
    led = [F.min(F.when(F.col("size") > p.led_from, F.col("rep").bitwiseXOR(F.lit(m)))).bitwiseXOR(F.lit(m)) for m in masks]
    chosen = members.groupBy("node").agg(F.count("*").alias("size"), F.array(F.min("rep"), *led).alias("leaders"))
    leaders = materialize(chosen.select("node", "size", F.array_distinct(F.filter("leaders", lambda x: x.isNotNull())).alias("leaders")), "leaders")
    pairs = looked_up(members.select("node", "rep"), leaders, ["node"], counted="size").select("rep", F.explode("leaders").alias("leader")).where("rep <> leader")
    return pairs.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def _dealt(rows: DataFrame, nodes: DataFrame, reps: DataFrame, p: Params) -> DataFrame:
    """Rows of open nodes by ``node``, ``part`` of its minor members, ``block`` of all."""
    groups = lambda members, shingles: F.ceil(F.greatest(F.col(members) / p.node_limit, F.col(shingles) / p.node_shingles)).cast("int")
    sized = nodes.select("node", "major", groups("minor", "minor_shingles").alias("parts"), groups("size", "shingles").alias("blocks"))
    full = rows.join(sized, "node").join(reps.select("rep", "n", "sig", "parity"), "rep").withColumn("minor", F.col("component") != F.col("major"))
    h = F.xxhash64("rep", F.lit(p.seed + 1))
    own = F.pmod(h, F.col("blocks")).cast("int")
    as_member = full.withColumn("block", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    part = F.pmod(F.shiftrightunsigned(h, 20), F.col("parts")).cast("int")
    as_member = as_member.withColumn("probe", F.col("minor") & (part == F.col("part")))
    elsewhere = full.where("minor and blocks > 1").withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("block") != own)
    columns = ["node", "part", "block", "rep", "component", "n", "probe", "sig", "parity"]
    return as_member.select(*columns).unionByName(elsewhere.withColumn("probe", F.lit(True)).select(*columns))


def _sets(ids: DataFrame, docs: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """``id`` and the full set of every text with one of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, p.shingle_words).tobytes() for t in chain.from_iterable(parts(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(materialize(ids, "ids"), "id", "left_semi")
    return materialize(texts.mapInArrow(run, "id long, shingles binary"), "sets")


def _confirmed(pairs: DataFrame, full: DataFrame, p: Params) -> DataFrame:
    """Of ``a``, ``b``, those whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(chain.from_iterable(parts(batch.column(2))), chain.from_iterable(parts(batch.column(3)))):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= p.percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # sets are large, in memory much more so than in their files, and are never broadcast
    x, y = (full.select(F.col("id").alias(c), F.col("shingles").alias(s)).hint("merge") for c, s in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _parts(links: DataFrame) -> DataFrame:
    """``rep``, ``component``: connected reps with the smallest they are seen to reach; not always the component's."""
    near = links.select(F.col("a").alias("rep"), F.col("b").alias("m")).union(links.select("b", "a"))
    least = materialize(near.groupBy("rep").agg(F.min("m").alias("m")).select("rep", F.least("rep", "m").alias("m")), "parts")
    for _ in range(2):
        further = least.select(F.col("rep").alias("m"), F.col("m").alias("further"))
        least = materialize(looked_up(least, further, ["m"]).select("rep", F.least("m", "further").alias("m")), "parts")
    return least.withColumnRenamed("m", "component")


def near_duplicates(docs: DataFrame, params: Params | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``."""
    p = params or Params()
    p = replace(p, depth=p.depth or 3 + max(0, math.ceil(math.log(max(1, docs.count()) / p.docs_at_three) / math.log(20))))
    with scratch(docs.sparkSession):
        rows = materialize(sketch(bounded_batches(docs), p, id_col=id_col, text_col=text_col), "sketches")
        reps = materialize(
            rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "sig", "parity")).alias("r")).select("digest", F.col("r.doc_id").alias("rep"), "r.n", "r.sig", "r.parity"),
            "distinct-sets",
        )
        leaves = materialize(_leaves(reps, p), "leaves")
        sizes = materialize(leaves.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        members = materialize(looked_up(leaves, sizes, ["node"], counted="size").where("size is not null"), "nodes")

        a, b = (reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}")) for x in ("a", "b"))
        stars = materialize(_stars(members, p), "stars")
        likely = materialize(_allowed(looked_up(stars, a, ["a"]).join(b, "b"), p), "pairs")
        full = _sets(_ends(likely), docs, p, id_col, text_col)
        links = _confirmed(likely, full, p)

        rows_left, nodes = _open_nodes(members, _parts(links), reps)
        involved = materialize(_involved(_dealt(rows_left, materialize(nodes, "open-nodes"), reps, p), p), "involved")
        if not involved.isEmpty():
            missing = involved.select(F.col("rep").alias("id")).distinct().join(full.select("id").distinct(), "id", "left_anti")
            links = links.unionByName(_links_across(involved, full.unionByName(_sets(missing, docs, p, id_col, text_col)), p))
        labels = connected_components(links)

        by_set = materialize(reps.select("digest", "rep").join(labels.withColumnRenamed("vertex", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("c")), "labels", keep=True)
        known = materialize(rows.select("doc_id", "n", "digest"), "known", keep=True)
    # rows without shingles share a digest that is no set's
    linked = looked_up(known, by_set, ["digest"])
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))
