"""Directly addressable codes, phrase collocations, and the prefix trie of conversations, against plain versions."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemart.llm import collocations, direct_codes, prefix_trie
from tidemart.llm.queries import ORACLE_SQL, QUERIES, WORD_BPE, tokenizer_path
from tidemart.session import shared_path

ODD = [
    (1, None, "en", "src0", 1), (2, "", None, None, None), (3, "   \n\t ", "en", "src0", 3), (None, "the cat and the dog", "en", "src0", 5), (None, None, "en", "src0", 5), (5, "x" * 300_000, "en", "src2", 9),
    (6, "the " * 40_000, "en", "src2", 9), (7, "the cat and the dog", "en", "src0", 5), (7, "the cat and the dog", "en", "src0", 5), (7, "a", "en", "src0", 5), (8, "El niño   日本 𝒳 \x1c q <|endoftext|>", "es", "src1", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"ids": F.lit("x"), "id": F.lit(1), "w1": F.lit(2), "n": F.lit(3)})


# directly addressable codes


@pytest.mark.parametrize("top", [0, 1, 255, 256, 65_535, 65_536, 1 << 31])
@pytest.mark.parametrize("n", [1, 7, 511, 512, 513, 5000])
def test_codes_and_random_access(top, n):
    rng = np.random.default_rng(top + n)
    ids = np.minimum((rng.pareto(0.4, n) * 50).astype(np.uint64), np.uint64(top))
    ids[-1] = top
    widths, *levels = direct_codes.encode_levels(ids)
    assert sum(widths) >= top.bit_length() and all(w % 8 == 0 for w in widths)
    body = direct_codes.framed([widths, np.array([4, 0], "<i8").tobytes(), bytes([2]), np.array([n // 2, n], "<i8").tobytes(), *levels])
    segment = direct_codes.Segment(body, n, 2)
    assert (segment.all() == ids).all() and segment.doc_ids.to_pylist() == [4, None]
    places = rng.integers(0, n, 300)
    assert (segment.at(places) == ids[places]).all() and len(segment.at(places[:0])) == 0
    with pytest.raises(ValueError):
        direct_codes.Segment(body[:-1], n, 2)
    with pytest.raises(ValueError):
        direct_codes.Segment(body, n + 1, 2)


def test_best_widths_are_best():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 256, 900), rng.integers(0, 1 << 30, 100)]).astype(np.uint64)
    cost = lambda widths: sum(len(direct_codes._chunks(ids[:1], w)) * 8 * n + n for w, n in zip(widths, [np.count_nonzero(ids >> np.uint64(s) > 0) if s else len(ids) for s in np.cumsum([0, *widths[:-1]]).tolist()]))
    options = [[8, 8, 8, 8], [8, 8, 16], [8, 16, 8], [16, 8, 8], [8, 24], [16, 16], [24, 8], [32]]
    assert cost(direct_codes.best_widths(ids)) == min(map(cost, options)) and direct_codes.best_widths(ids) == [8, 24]
    assert direct_codes.best_widths(np.zeros(3, np.uint64)) == [8]


def plain_tokens(rows):
    tokenizer = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    coded = [(i, [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]) for i, text in rows]
    return sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0))


def test_token_files_round_trip(spark, odd):
    path = shared_path(spark, "tokens")
    direct_codes.write(odd.repartition(3), path, tokenizer_path(WORD_BPE), segment_tokens=50)
    got = direct_codes.read(spark, path).orderBy("start").collect()
    plain = plain_tokens([(r[0], r[1]) for r in ODD])
    assert [r.doc_id for r in got] == [i for i, _ in plain]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(ids), crc(ids)) for i, ids in plain)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    # documents of one id may stand in any order: put the plain ones in the order read
    rest, tokens = list(plain), []
    for r in got:
        tokens += rest.pop(next(k for k, (i, ids) in enumerate(rest) if i == r.doc_id and crc(ids) == r.ids_crc32))[1]
    asked = [0, 1, len(tokens) - 1, len(tokens), -1, *random.Random(3).sample(range(len(tokens)), 200)]
    found = {r.position: r.token for r in direct_codes.tokens_at(spark, path, spark.createDataFrame([(i,) for i in [*asked, None, 5]], "position long")).collect()}
    assert found == {i: tokens[i] for i in [*asked, 5] if 0 <= i < len(tokens)}


def test_token_files_of_the_tables(spark, folder):
    got = QUERIES["op11_direct_codes"](spark, folder).orderBy("start").collect()
    plain = plain_tokens([tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()])
    starts = np.cumsum([0, *[len(ids) for _, ids in plain]]).tolist()
    assert [tuple(r) for r in got] == [(i, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (i, ids), s in zip(plain, starts)]


def test_no_tokens_and_damaged_files(spark, odd):
    path = shared_path(spark, "tokens")
    direct_codes.write(odd.where("false"), path, tokenizer_path(WORD_BPE))
    assert direct_codes.read(spark, path).isEmpty()
    with pytest.raises(ValueError):
        list(direct_codes._cut(b"DAC1 0 0 1 1 3\nabcX"))
    with pytest.raises(ValueError):
        list(direct_codes._cut(b"something else\n"))


# collocations


def same_phrases(spark, con, docs, params):
    docs.toPandas().pipe(lambda df: con.register("documents", df[["doc_id", "text", "lang"]]))
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = collocations.mine(docs, params).select(*columns).collect()
    sql = ORACLE_SQL["op12_collocations"].replace(">= 30", f">= {params.min_count}").replace("<= 2000", f"<= {params.top}")
    assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
    return got


def noise(spark, seed, docs=120):
    rng = random.Random(seed)
    words = ["The", "the", "CAT", "a", "b", "c", "É", "é", "x1", "日本", "q" * 50]
    sep = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\r\n", "\x1c", " "]
    rows = [(i, "".join(rng.choice(words[: rng.randrange(2, len(words))]) + rng.choice(sep) for _ in range(rng.randrange(0, 90))), rng.choice(["en", "de", None, "und"])) for i in range(docs)]
    return spark.createDataFrame([*rows, (1, None, "en"), (2, "", "xx"), (None, "the cat " * 3000, "de"), (3, ";;;", "yy")], "doc_id long, text string, lang string")


@pytest.mark.parametrize("max_phrases", [1_000_000, 40, 7])
def test_phrases_are_those_of_sql(spark, max_phrases):
    docs = noise(spark, 1).withColumns({"ids": F.lit(1), "word": F.lit("x"), "w1": F.lit(2), "n": F.lit(3), "_at": F.lit(4)})
    assert len(same_phrases(spark, duckdb.connect(), docs, collocations.Params(min_count=9, top=40, max_phrases=max_phrases))) > 40


def test_phrases_of_the_tables_and_of_nothing(spark, folder):
    con = duckdb.connect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert same_phrases(spark, con, docs, collocations.Params())
    assert collocations.mine(docs.where("false")).isEmpty() and collocations.mine(docs.withColumn("text", F.lit(None).cast("string"))).isEmpty()


def test_trie_knows_its_phrases_alone():
    rng = np.random.default_rng(3)
    known = {(w,) for w in range(1, 60)}
    for depth in (2, 3, 4):
        known |= {(*p, int(rng.integers(1, 60))) for p in list(known) if len(p) == depth - 1 for _ in range(int(rng.integers(0, 4)))}
    rows = np.array(sorted(p + (0,) * (4 - len(p)) for p in known))
    for low, high in ((0, len(rows)), (len(rows) // 3, len(rows) // 2)):
        trie = collocations.Trie(rows[low:high], whole=low == 0)
        text = rng.integers(0, 65, 4000)
        numbers = trie.numbers(text)
        states, got = trie.begin(numbers), set()
        for depth in range(1, 5):
            got |= {tuple(text[i : i + depth].tolist()) for i in np.flatnonzero(states) if trie.own[states[i]]}
            states = trie.advance(states, numbers, depth)
        own = {tuple(r[r > 0].tolist()) for r in rows[low:high]}
        plain = {t for k in range(1, 5) for i in range(len(text) - k + 1) if (t := tuple(text[i : i + k].tolist())) in own}
        assert got == plain and trie.size < 6 * (high - low) + 1000


def test_scores_are_exact(spark):
    big = 10**13
    counts = spark.createDataFrame([(1, 0, 0, 0, big), (2, 0, 0, 0, big - 1), (1, 2, 0, 0, big - 3)], "w1 long, w2 long, w3 long, w4 long, f long")
    row = collocations.scored(counts, collocations.Params()).first()
    assert (row.a, row.l, row.r, row.score) == (big - 3, big, big - 1, 2_000_000 * (big - 3) // (2 * big - 1))


# prefix trie


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    for turns in convs.values():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    strings = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        strings[c] = tuple([t[1:] for t in convs.get(c - c % 5, [])[:h]] + [t[1:] for t in turns[h:]])
    members, ends = {}, {}
    for c, s in strings.items():
        ends.setdefault(s, []).append(c)
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[c] for c in below) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[c] for c in below)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], digest))
    return sorted(out, key=str)


def found_trie(df, sample=16):
    return sorted(map(tuple, prefix_trie.trie(*prefix_trie.rebuilt(df), sample=sample).collect()), key=str)


def talk(seed):
    """Conversations that share a lot, and part in many places; some are equal, some have no turns left, turns may be null."""
    rng = random.Random(seed)
    rows = []
    for c in range(120):
        if rng.random() < 0.85:
            for turn in range(rng.choice([1, 3, 9, 14, 25])):
                rows.append((c, turn if turn else None, rng.choice(["u", "u", "u", None]), rng.choice(["", "a", "é"]) if rng.random() < 0.15 else "same" * (turn % 3)))
    return [*rows, (None, 0, "u", "x"), *[(500 + k, t, "u", "copy") for k in range(40) for t in range(12)]]


@pytest.mark.parametrize("seed,sample,long,chunk", [(1, 16, 1000, 1 << 16), (2, 2, 20, 7)])
def test_trie_is_the_plain_one(spark, monkeypatch, seed, sample, long, chunk):
    monkeypatch.setattr(prefix_trie, "LONG", long)
    monkeypatch.setattr(prefix_trie, "EDGE_BLOCK", 5)
    monkeypatch.setattr(prefix_trie, "CHUNK_CHARS", chunk)
    rows = talk(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"c": F.lit(1), "depth": F.lit(2), "e": F.lit(3), "t": F.lit("x"), "bytes": F.lit(4)})
    assert found_trie(df.repartition(5), sample) == plain_trie(rows)


def test_trie_of_the_tables_and_of_odd_ones(spark, folder):
    df = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, QUERIES["op13_prefix_trie"](spark, folder).collect()), key=str)
    assert got == plain_trie(rows)
    assert found_trie(df.where("false")) == [] and found_trie(df.select(F.lit(None).cast("long").alias("conv_id"), "turn", "role", "text")) == []
    one = [(3, 0, None, None)]  # its turn is not borrowed, as the first of its block is not there, and not its own
    assert found_trie(spark.createDataFrame(one, "conv_id long, turn long, role string, text string")) == plain_trie(one)


def test_two_fattest_numbers(spark):
    rows = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", prefix_trie.two_fattest("a", "b").alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)
