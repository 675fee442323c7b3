"""Near duplicates, components, mixing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemart.llm import components, mixing, near_duplicates
from tidemart.llm.common import looked_up, materialize, scratch
from tidemart.llm.near_duplicates import Params, shingle_set


def brute_force(rows, words):
    """Component of each row by comparing all distinct sets."""
    sets = [frozenset(shingle_set(t, words).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_set = {}
    for i, s in enumerate(sets):
        if s:
            parent[find(i)] = find(by_set.setdefault(s, i))
    distinct = list(by_set)
    for x in range(len(distinct)):
        for y in range(x):
            a, b = distinct[x], distinct[y]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(by_set[a])] = find(by_set[b])
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def synthetic():
    """Chains of near copies, one large group, and documents that share much but not enough."""
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    texts = [" ".join(rng.choice(vocabulary, 80)) for _ in range(150)]
    for k in range(60):
        words = texts[k].split()
        for step in range(3):
            words[rng.integers(80)] = f"e{k}-{step}"
            texts.append(" ".join(words))
    base = texts[0].split()
    for k in range(300):
        words = list(base)
        for _ in range(rng.integers(1, 5)):
            words[rng.integers(80)] = f"h{k}"
        texts.append(" ".join(words))
    for k in range(100):
        texts.append(" ".join([*base[:50], *rng.choice(vocabulary, 30)]))
    texts += texts[:40] + ["one", "One", "two words", "two  WORDS", ""]
    order = rng.permutation(len(texts))
    return [(int(i), texts[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize(("words", "limit"), [(2, 2048), (2, 16), (5, 16)])
def test_equals_brute_force(spark, words, limit):
    rows = synthetic()
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Params(shingle_words=words, node_limit=limit)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(rows, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_given_documents_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = near_duplicates.near_duplicates(docs, Params(shingle_words=2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force([(r.doc_id, r.text) for r in docs.collect()], 2)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (None, "a"), (6, "x y"), (6, "x y"), (7, "   "), (8, "long " * 200_000), (9, "Long " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("rep", F.lit(0))
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(df, Params(shingle_words=2)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 8, False), (None, 1, None, False)]
    assert near_duplicates.near_duplicates(df.where("false")).isEmpty()


def test_links_whose_signatures_agree_in_less(spark):
    p = Params(shingle_words=1)
    rng, factors, rows = np.random.default_rng(11), near_duplicates._factors(p), []
    while len(rows) < 12:  # pairs at 0.8 whose signatures agree in less than 0.64, of which there is one in 900
        words = rng.integers(0, 1 << 40, 100)
        a, b = (" ".join(f"w{w}" for w in x) for x in (words[:90], words[10:]))
        x, y = shingle_set(a, 1), shingle_set(b, 1)
        if (near_duplicates._signature(x, factors) == near_duplicates._signature(y, factors)).mean() < 0.64:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i in range(len(rows))}


def test_parities_leave_no_link_out():
    rng = np.random.default_rng(3)
    for percent in (50, 60, 80, 95):
        p = Params(percent=percent)
        for size in (1, 5, 90, 3000):
            for share in (0.3, 0.9, 1.0):
                pool = np.unique(rng.integers(0, 1 << 63, size * 2, dtype=np.uint64))
                a, b = pool[:size], pool[size - int(size * share) :][:size]
                common = len(np.intersect1d(a, b))
                linked = 100 * common >= percent * (len(a) + len(b) - common)
                bits = [near_duplicates._parities(x).view("<u8")[None, :] for x in (a, b)]
                may = near_duplicates._may_link(np.array([len(a)]), np.array([len(b)]), *bits, p)[0]
                assert may or not linked
                assert not may or not (percent >= 80 and size == 90 and share == 0.3)


def test_more_levels_for_more_documents():
    for depth in (2, 3, 5):
        p = Params(depth=depth)
        assert p.coordinates == 5 * (2 ** (depth + 1) - 2)
        sig = np.random.default_rng(0).integers(0, 1 << 32, (10, p.coordinates), dtype=np.uint32)
        sig[1] = sig[0]
        leaves = near_duplicates._tree_leaves(sig, p)
        assert leaves.shape == (10, 5 * 2**depth) and (leaves[0] == leaves[1]).all() and not (leaves[0] == leaves[2]).any()


def test_no_link_at_the_limit_is_lost(spark):
    rng, rows = np.random.default_rng(21), []
    for k in range(20_000):  # 80 of 100 words in common
        words = [f"w{w}" for w in rng.integers(0, 1 << 40, 100)]
        rows += [(2 * k, " ".join(words[:90])), (2 * k + 1, " ".join(words[10:]))]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Params(shingle_words=1))
    assert got.where("component_id <> doc_id - doc_id % 2").count() == 0


def test_groups_are_bounded_in_shingles(spark):
    rows = [r for r in synthetic() if len(r[1].split()) > 60]
    p = Params(shingle_words=2, node_shingles=400)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(rows, 2)


def test_hot_keys_are_looked_up(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 1, None).otherwise(F.col("id")).alias("k"), "id")
    facts = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = {tuple(r) for r in looked_up(rows, facts, ["k"]).collect()}
    assert got == {tuple(r) for r in rows.join(facts, "k", "left").collect()} and len(got) == 9000


def test_scratch_tables_go(spark):
    with scratch(spark):
        gone, kept = materialize(spark.range(3), "gone"), materialize(spark.range(4), "kept", keep=True)
        assert gone.count() == 3
    assert kept.count() == 4
    with pytest.raises(Exception, match="FAILED_READ_FILE|does not exist|PATH_NOT_FOUND"):
        gone.selectExpr("sum(id)").collect()


def test_stage_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline

    same, other = "some words that are the same in all of these", "other words that are only found in one of these"
    rows = [(5, same, "a"), (5, other, "a"), (5, same, "b"), (9, same, "c"), (2, "one more text that nothing else is like", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, own string").withColumn("row", F.lit("clash")).withColumn("given", F.lit(1))
    kept = [corpus_pipeline.drop_near_duplicates(spark, d, "") for d in (df, df.orderBy(F.desc("own")), df.where("false"))]
    found = [sorted(map(tuple, k.select("doc_id", "text").collect())) for k in kept]
    assert found[0] == found[1] and sorted(t for _, t in found[0]) == sorted([same, other, rows[4][1]]) and found[2] == []
    assert kept[0].columns == df.columns


def test_stage_takes_rows_without_ids(spark):
    import corpus_pipeline

    same, other, top = "some words that are the same in all of these", "other words that are only found in two of these", (1 << 63) - 1
    for ids in ((5, 2), (top, 2), (None, None)):  # room above, only below, no ids at all
        rows = [(ids[0], same), (None, same), (None, same), (None, other), (None, other), (ids[1], "one more text that nothing else is like"), (None, ""), (None, None)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = corpus_pipeline.drop_near_duplicates(spark, df, "")
        assert got.columns == df.columns
        assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(ids[0] or 0, same), (0, other), (ids[1] or 0, rows[5][1]), (0, ""), (0, "")])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 100), (5, 4), (5, 4)]
    got = {r.vertex: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 200: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


# mixing


def test_targets_by_resharing(spark):
    for sizes, share in (([100, 1000, 50, 0, 700], 1.5), ([5, 5000, 30, 40, 1], 1.5), ([100, 100, 100, 100, 100], 3.0), ([1 << k for k in range(5)], 0.5)):
        weights = [5.0, 2.0, 1.0, 5.0, 2.0]
        targets, free, left = [0.0] * 5, {i for i in range(5) if sizes[i]}, min(share, 2) * sum(sizes)
        while free and left > 1e-9:  # as it is told: share out by weight, cap, share the excess again
            given = {i: targets[i] + left * weights[i] / sum(weights[j] for j in free) for i in free}
            left = sum(max(0, given[i] - 2 * sizes[i]) for i in free)
            for i in free:
                targets[i] = min(given[i], 2 * sizes[i])
            free = {i for i in free if targets[i] < 2 * sizes[i]}
        df = spark.createDataFrame(list(zip(range(5), sizes, weights)), "i int, size long, weight double")
        assert np.allclose([r.target for r in mixing.with_targets(df, share, 2.0).orderBy("i").collect()], targets)
    none = spark.createDataFrame([(0, 0, 1.0)], "i int, size long, weight double")
    assert mixing.with_targets(none, 1.5, 2.0).first().target == 0 and mixing.with_targets(none.where("false"), 1.5, 2.0).isEmpty()


def test_split_quotas_are_exact():
    out = mixing.split_quotas([100, 7, 0, 1000], 6, np.random.default_rng(1))
    assert out.sum(axis=0).tolist() == [100, 7, 0, 1000] and abs(out.sum(axis=1) - 1107 / 6).max() <= 3
    assert (out == mixing.split_quotas([100, 7, 0, 1000], 6, np.random.default_rng(1))).all()


def test_draws_are_as_of_a_plain_dealer():
    """Blocks shuffled and dealt by hand have the same mean and spread in every shard."""
    rng, quotas, shards, n = np.random.default_rng(3), np.array([40, 25, 3, 60]), 4, 4000
    deck = np.repeat(np.arange(4), quotas)
    plain, tree = np.zeros((n, 4, shards)), np.zeros((n, 4, shards))
    for k in range(n):
        dealt = rng.permutation(deck).reshape(shards, -1)
        plain[k] = [[(hand == s).sum() for hand in dealt] for s in range(4)]
        slots = mixing.split_quotas([65, 63], shards, rng)  # two groups of two sources
        tree[k] = [*mixing.deal(quotas[:2], slots[:, 0], rng), *mixing.deal(quotas[2:], slots[:, 1], rng)]
    assert (tree.sum(axis=2) == quotas).all() and (tree.sum(axis=1) == 32).all()
    assert np.allclose(plain.mean(axis=0), tree.mean(axis=0), atol=0.25) and np.allclose(plain.std(axis=0), tree.std(axis=0), rtol=0.08)


def test_takes_are_what_the_shards_draw(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    blocked, decided = mixing.plan_for(docs, shards=7, block_docs=3)
    rows, dealt, chosen = blocked.collect(), decided.dealt.collect(), {(r.key, r.h) for r in decided.chosen.collect()}
    held = {}
    for d in dealt:
        assert 0 <= d.shard < 7
        held.setdefault((d.key, d.block), []).append(d)
    assert all(len({d["round"] for d in ds}) == len(ds) for ds in held.values())  # a block once a round, in one shard
    sizes = np.bincount([d.shard for d in dealt], minlength=7)
    assert sizes.max() - sizes.min() <= 3
    expected = sorted((r.doc_id, r.size * sum(not d["last"] or (r.key, r.h) in chosen for d in held.get((r.key, r.block), []))) for r in rows)
    assert sorted((r.doc_id, r.taken) for r in mixing.report(blocked, decided).collect()) == expected


def test_last_blocks_by_strides(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = [(k, int(b), int(w)) for k in "abc" for b, w in enumerate(rng.integers(0, 50, 100)) if w]
    rest = {"a": 700.0, "b": 0.0, "c": 1999.5}
    expected = {}
    for k, r in rest.items():
        upto = 0
        for key, b, w in words:
            if key == k and k not in expected and upto + w > r:
                expected[k] = (b, r - upto)
            upto += w if key == k else 0
    for stride in (7, 1 << 16):
        monkeypatch.setattr(mixing, "STRIDE", stride)
        got = mixing.last_blocks(spark.createDataFrame(words, "key string, block long, words long"), spark.createDataFrame(list(rest.items()), "key string, rest double"))
        assert {r.key: (r.cut, r.room) for r in got.collect()} == expected


def test_fitting_reaches_the_nearest_sum():
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes, room = [int(x) for x in rng.integers(0, 60, 9)], float(rng.integers(0, 200)) + 0.5
        best = min(abs(room - sum(s for k, s in enumerate(sizes) if m >> k & 1)) for m in range(512))
        take = mixing.fitting(sizes, room)
        assert abs(room - sum(s for s, t in zip(sizes, take) if t)) == best


def test_mix_meets_targets(spark, folder):
    from tidemart.llm.queries import QUERIES

    got = QUERIES["op2_source_mix"](spark, folder).toPandas()
    again = QUERIES["op2_source_mix"](spark, folder).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    texts = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all(r.size == len(texts[r.doc_id][1].encode().split()) for r in got.itertuples())
    assert (got["taken"] <= 2 * got["size"]).all()
    for _, g in got.groupby("source"):
        assert g["source_size"].iloc[0] == g["size"].sum() and abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.02 * g["target"].iloc[0]
    assert abs(got.groupby("source")["target"].first().sum() - 1.5 * got["size"].sum()) < 1e-6


def test_mix_odd_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, None, "s"), (3, "", None), (4, "c d e", None), (None, "f", "t"), (5, "g " * 100_000, "u"), (6, "h", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("shard", F.lit("clash"))
    for name in ("key", "h", "block", "row", "last", "chosen", "blocks"):
        df = df.withColumn(name, F.lit("clash"))
    blocked, decided = mixing.plan_for(df)
    got = mixing.report(blocked, decided).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    targets = {r.source: (r.source_size, r.target) for r in got}
    assert targets["s"][0] == 4 and targets[None][0] == 3 and all(t <= 2 * s for s, t in targets.values())
    mixed = mixing.mix(df, shards=2)
    assert sorted(mixed.columns) == sorted([*df.columns, "shard_order"]) and {r.key for r in mixed.collect()} == {"clash"}
    drawn = mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    taken = {r.doc_id: r.taken // r.size * (2 if r.doc_id == 1 else 1) for r in got if r.size and r.taken}
    assert {r.doc_id: r.n for r in drawn if r.doc_id != 2 and r.doc_id != 3} == taken
    none, plan = mixing.plan_for(df.where("false"))
    assert mixing.report(none, plan).isEmpty() and mixing.mix(df.where("false")).isEmpty()


def test_mix_of_one_row_repeated(spark):
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    other = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("d e").alias("text"), F.lit("t").alias("source"))
    got = mixing.plan_for(same.unionByName(other), share=0.5)
    by_source = mixing.report(*got).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 3 for r in by_source)
    assert got[0].groupBy("key", "block").count().agg(F.max("count")).first()[0] < 4 * mixing.BLOCK_DOCS


def test_crowded_rows_however_the_table_is_cut(spark):
    rows = [(1, "a b c", "s")] * 700 + [(i, "x " * (i % 9), "s" if i % 2 else "t") for i in range(2, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = lambda d: sorted((r.doc_id, r.size, r.taken) for r in mixing.report(*mixing.plan_for(d)).collect())
    assert taken(df.repartition(2)) == taken(df.repartition(7)) == taken(df.coalesce(1))
