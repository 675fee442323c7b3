"""Phrases whose words keep together, mined from whole texts, per language.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line breaks, and pieces into words.
A candidate is a phrase of 2 to ``max_words`` words that occurs ``min_count`` times, overlaps included.

1. Words are counted; frequent ones are numbered over all languages, so a number tells its language.
   Texts are written again as arrays of these numbers, 0 for every break and every rare word: no
   candidate goes over either (the Apriori rule for single words).
2. Level by level, a double-array trie of the frequent phrases so far is broadcast. All positions of a
   block advance through it at once, one array operation a word.  Where a phrase of k - 1 words ends before a frequent
   word, and the phrase that begins one word later is frequent too, there is a phrase of k words that the
   Apriori rule lets pass; those that all tasks together saw often enough enter the trie of the next level.
3. Through the whole trie all positions advance once more; tasks ``bincount`` the accepting
   states at each depth, and the counts are summed: those of the candidates and of all their parts.
4. Each candidate has its worst cut's score; those that live inside a longer one go; the best of
   each language are reported.

A trie holds at most ``max_phrases`` phrases, a range of the sorted ones; with more of them there are
more tries, each with a pass of its own over the numbers, and likewise for the numbering of words.  So a broadcast is
bounded whatever the data.  Double arrays are small: a trie numbers only the words that it knows.

Edge cases: a null text is empty; a null language is ``und``; repeated rows count as often as they
appear; ties go by the order stated in ``mine``; an empty table gives an empty result; other columns
and ids are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from .common import ASCII_LOWER, bounded_batches, materialize, parts
from .common import held as remembered

_WORD = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+")
#: Words, and the ends of pieces.
_TOKEN = re.compile(rb"[.,;:!?\x0A-\x0D]+|[^\x20\x09.,;:!?\x0A-\x0D]+")
LANGUAGE_UNKNOWN = "und"

#: A task hands on its counts of words when it holds so many words, or has read so many bytes.
FLUSH_WORDS, FLUSH_BYTES = 150_000, 64 << 20
#: States whose counts are added up together.
STATES = 1 << 15
#: Places that are looked at for a node of several children (fewer for very many) before the double array grows.
PLACES = 1024


@dataclass(frozen=True)
class Params:
    min_count: int = 30
    max_words: int = 4
    #: A candidate goes if a longer one around it has so many percent of its count.
    inside_percent: int = 80
    top: int = 2000
    scale: int = 2_000_000
    max_phrases: int = 1_000_000


def _lowered(text: str | None) -> bytes:
    return (text or "").encode().translate(ASCII_LOWER)


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``n`` of every word; a row without word has the language's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        totals: Counter = Counter()
        seen = 0

        def emit() -> pa.RecordBatch:
            nonlocal seen
            rows = [(lang, word.decode(), n) for lang, c in counts.items() for word, n in c.items()] + [(lang, None, n) for lang, n in totals.items()]
            counts.clear(), totals.clear()
            seen = 0
            langs, words, ns = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for langs, texts in zip(parts(batch.column(0), 64), parts(batch.column(1), 64)):
                for lang, text in zip(langs, texts):
                    raw = _lowered(text)
                    words = _WORD.findall(raw)
                    counts.setdefault(lang, Counter()).update(words)
                    totals[lang] += len(words)
                    seen += len(raw)
                if seen > FLUSH_BYTES or sum(map(len, counts.values())) > FLUSH_WORDS:
                    yield emit()
        yield emit()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _numbered(docs: DataFrame, vocabulary: DataFrame, shards: int, kind: str) -> DataFrame:
    """``ids`` of texts: numbers of frequent words, 0 for anything else between them.

    The vocabulary is broadcast in ``shards`` parts, each filled in by a pass of its own; the last one forgets the texts
    and puts documents behind each other.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("ids", F.lit(None).cast("binary"))
    for shard in range(shards):
        own = vocabulary.where(F.pmod(F.xxhash64("lang", "word"), F.lit(shards)) == shard).select("lang", "word", "id").toArrow()  # about a shards'th
        shared, key, last = spark.sparkContext.broadcast(own), uuid.uuid4().hex, shard == shards - 1

        def load(shared=shared) -> dict[str, dict[bytes, int]]:
            out: dict[str, dict[bytes, int]] = {}
            for batch in shared.value.to_batches(max_chunksize=100_000):
                for lang, word, number in zip(*(c.to_pylist() for c in batch.columns)):
                    out.setdefault(lang, {})[word.encode()] = number
            return out

        def run(batches: Iterator[pa.RecordBatch], load=load, key=key, last=last) -> Iterator[pa.RecordBatch]:
            numbers = remembered(("collocations", key), load)
            for batch in batches:
                for langs, texts, before in zip(*(parts(batch.column(k), 64) for k in range(3))):
                    out = []
                    for lang, text, earlier in zip(langs, texts, before):
                        tokens = _TOKEN.findall(_lowered(text))
                        ids = np.fromiter(map(numbers.get(lang, {}).get, tokens, repeat(0)), kind, len(tokens))
                        out.append(ids if earlier is None else np.maximum(ids, np.frombuffer(earlier, kind)))
                    if last:
                        line = np.concatenate([x for ids in out for x in (ids, np.zeros(1, kind))])
                        line = line[(line > 0) | np.append(line[1:] > 0, False)]  # one break is as good as many
                        yield pa.RecordBatch.from_arrays([pa.array([line.tobytes()], pa.binary())], names=["ids"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string()), pa.array([i.tobytes() for i in out], pa.binary())], names=["lang", "text", "ids"])

        rows = bounded_batches(rows).mapInArrow(run, "ids binary" if last else "lang string, text string, ids binary")
        rows = materialize(rows, "numbers", compression="zstd")
        shared.destroy()
    return rows


class Trie:
    """A double array over phrases: state ``s`` goes on with digit ``d`` to ``base[s] + d`` if ``check`` there is ``s``.

    ``phrases`` has a row for each, words from the left, 0 where there is none, sorted.  Of a range of a table in which every
    phrase has its prefixes, only the first row's prefixes can be missing: these are guests, known but not counted.  ``words`` are
    the words known here: the trie's own number of one is its place, from 1.  A word is two digits of its number, so that the
    children of a state lie close together and the arrays stay dense.
    """

    def __init__(self, phrases: np.ndarray, whole: bool = True):
        first = phrases[0]
        ahead = [np.where(np.arange(len(first)) < k, first, 0) for k in range(1, int((first > 0).sum()))]
        phrases = np.stack([*ahead, *phrases])
        self.words = np.unique(phrases[phrases > 0])
        own = np.where(phrases > 0, np.searchsorted(self.words, phrases) + 1, 0)
        self.radix = math.isqrt(len(self.words)) + 1
        self.size = 1
        self.base, self.check = np.zeros(1, np.int64), np.full(1, -1, np.int64)
        length, state = (own > 0).sum(axis=1), np.zeros(len(own), np.int64)
        for depth in range(own.shape[1]):
            here = np.flatnonzero(length > depth)
            if not len(here):
                break
            for digit in self._digits(own[here, depth]):
                # all rows with one prefix have one state; the children of each are placed together
                codes, place = np.unique(state[here] * (self.radix + 1) + digit, return_inverse=True)
                state[here] = self._placed(*np.divmod(codes, self.radix + 1))[place]
        self.own = np.zeros(self.size, bool)
        self.own[state[len(ahead) :]] = True
        #: first words of which other ranges may have phrases
        self.shared = np.zeros(len(self.words) + 1, bool)
        self.shared[own[[0, -1], 0]] = not whole
        self.base, self.check = self.base.astype(np.int32), self.check.astype(np.int32)

    def _digits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return numbers // self.radix + 1, numbers % self.radix + 1

    def _grow(self, size: int) -> None:
        if size > self.size:
            more, self.size = size - self.size, size
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64))

    def _placed(self, parents: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """Slots of (state, digit) pairs, sorted; sets the bases of the states.

        States of most children come first, each where all of them fit, looked for from the lowest free slots; those of
        one child fill what is left.
        """
        slots = np.empty(len(parents), np.int64)
        starts = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        sizes = np.diff(np.append(starts, len(parents)))
        free, left = np.zeros(0, np.int64), 0
        for at in np.argsort(-sizes, kind="stable"):
            n, start = int(sizes[at]), int(starts[at])
            if n == 1:
                break
            spread = digits[start : start + n] - digits[start]
            if not left:
                low = max(1, self.size - (1 << 16))  # what is free before that has been looked at often enough
                self._grow(self.size + self.radix + 1)
                free, left = low + np.flatnonzero(self.check[low:] < 0)[:PLACES], PLACES // 16
            left -= 1
            fits = free[free + spread[-1] < self.size]
            fits = fits[(self.check[fits[:, None] + spread] < 0).all(axis=1)] if len(fits) else fits
            if not len(fits):
                fits, left = np.array([self.size]), 0
                self._grow(self.size + int(spread[-1]) + 1)
            place = int(fits[0])
            self.base[parents[start]] = place - digits[start]
            self.check[place + spread] = parents[start]
            slots[start : start + n] = place + spread
        single = starts[sizes == 1]
        free = np.flatnonzero(self.check[1:] < 0) + 1
        if len(free) < len(single):
            self._grow(self.size + len(single) - len(free))
            free = np.flatnonzero(self.check[1:] < 0) + 1
        slots[single] = free[: len(single)]
        self.base[parents[single]] = slots[single] - digits[single]
        self.check[slots[single]] = parents[single]
        return slots

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        """The trie's numbers of word ids, 0 for words that it doesn't know."""
        if self.words[-1] == len(self.words):  # all words from the first are known
            return np.where(ids <= len(self.words), ids, 0).astype(np.int32)
        at = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        return np.where(self.words[at] == ids, at + 1, 0).astype(np.int32)

    def _go(self, states: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """States after one word more, 0 where there is none."""
        good = True
        for digit in self._digits(numbers):
            to = self.base[states] + digit.astype(np.int32)
            to = np.where((to > 0) & (to < self.size), to, 0)
            good = good & (self.check[to] == states)
            states = np.where(good, to, 0)
        return states

    def begin(self, numbers: np.ndarray) -> np.ndarray:
        """States after the word at each position; 0 is no state."""
        out = np.zeros(len(numbers), np.int32)
        live = np.flatnonzero(numbers)
        out[live] = self._go(out[live], numbers[live])
        return out

    def advance(self, states: np.ndarray, numbers: np.ndarray, depth: int) -> np.ndarray:
        """States of all positions after the word ``depth`` places on."""
        out = np.zeros(len(states), np.int32)
        live = np.flatnonzero(states[: max(0, len(states) - depth)])
        live = live[numbers[live + depth] > 0]
        out[live] = self._go(states[live], numbers[live + depth])
        return out

    def last_words(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last word (an id, 0 at the root) of each state's phrase, and the state of the phrase without it."""
        middle = np.where(states > 0, self.check[states], 0)
        before = np.where(middle > 0, self.check[middle], 0)
        number = (middle - self.base[before] - 1) * self.radix + states - self.base[middle] - 1
        return np.where(states > 0, self.words[np.where(states > 0, number, 1) - 1], 0), before


def _tries(phrases: DataFrame, width: int, max_phrases: int) -> Iterator[Trie]:
    """Tries of at most ``max_phrases`` phrases of their own, each a range of the sorted phrases."""
    words = [f"w{k + 1}" for k in range(width)]
    total = phrases.count()
    placed = materialize(global_row_number(phrases, [F.asc(w) for w in words], "_at"), "ordered")
    for low in range(0, total, max_phrases):
        columns = placed.where(f"_at > {low} and _at <= {low + max_phrases}").orderBy("_at").select(*words).toArrow()
        yield Trie(np.stack([c.to_numpy().astype(np.int64) for c in columns.columns], axis=1), whole=total <= max_phrases)


def _shared(corpus: DataFrame, trie: Trie):
    """The broadcast, and how a task gets what is in it."""
    shared, key = corpus.sparkSession.sparkContext.broadcast(trie), uuid.uuid4().hex
    return shared, lambda: remembered(("trie", key), lambda: shared.value)


def _lines(batch: pa.RecordBatch, kind: str, least: int = 1 << 18) -> Iterator[np.ndarray]:
    """The rows of a batch, some of them together."""
    some, n = [], 0
    for value in batch.column(0):
        some += [np.frombuffer(value.as_py(), kind).astype(np.int64), np.zeros(1, np.int64)]
        n += len(some[-2])
        if n >= least:
            yield np.concatenate(some)
            some, n = [], 0
    if some:
        yield np.concatenate(some)


def _grown(corpus: DataFrame, trie: Trie, length: int, kind: str, min_count: int) -> DataFrame:
    """``w1`` to ``w{length}``, ``n``: phrases that may be frequent, as their parts in ``trie`` are, and were seen ``min_count`` times."""
    shared, get = _shared(corpus, trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = get()
        for batch in batches:
            for ids in _lines(batch, kind):
                numbers = trie.numbers(ids)
                states = first = trie.begin(numbers)
                for depth in range(1, length - 1):
                    states = trie.advance(states, numbers, depth)
                live = np.flatnonzero(states[: max(0, len(ids) - length + 1)])
                live = live[trie.own[states[live]] & (ids[live + length - 1] > 0)]
                live = live[(first[live + 1] == 0) | trie.shared[numbers[live + 1]] | (states[live + 1] > 0)]  # the other part may be in another trie, or is frequent
                _, at, n = np.unique(states[live].astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids[live + length - 1], return_index=True, return_counts=True)
                columns = [pa.array(ids[live[at] + k]) for k in range(length)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], names=[*(f"w{k + 1}" for k in range(length)), "n"])

    words = [f"w{k + 1}" for k in range(length)]
    seen = bounded_batches(corpus).mapInArrow(run, ", ".join(f"{w} long" for w in words) + ", n long").groupBy(*words).agg(F.sum("n").alias("n"))
    out = materialize(seen.where(F.col("n") >= min_count), "phrases")
    shared.destroy()
    return out


def _counted(corpus: DataFrame, trie: Trie, width: int, kind: str) -> DataFrame:
    """``w1`` to ``w{width}``, ``f``: how often every phrase of ``trie`` occurs.

    A task hands on its counts as blocks of neighbouring states, and blocks are added up: a row for each block that a
    task has seen anything of, whatever the number of phrases.
    """
    shared, get = _shared(corpus, trie)
    words = [f"w{k + 1}" for k in range(width)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = get()
        counts = np.zeros(trie.size, np.int64)
        for batch in batches:
            for ids in _lines(batch, kind):
                numbers = trie.numbers(ids)
                states = trie.begin(numbers)
                for depth in range(1, width + 1):
                    counts += np.bincount(states, minlength=trie.size)
                    states = trie.advance(states, numbers, depth)
        counts[~trie.own] = 0
        for block, at in enumerate(range(0, trie.size, STATES)):
            some = counts[at : at + STATES]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = get()

        def emit(block: int, counts: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(counts)
            state, columns = at + block * STATES, np.zeros((width, len(at)), np.int64)
            while state.any():  # from a phrase's last word to its first
                word, before = trie.last_words(state)
                columns = np.where(state > 0, np.roll(columns, 1, axis=0), columns)
                columns[0] = np.where(state > 0, word, columns[0])
                state = before
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(counts[at])], names=[*words, "f"])

        held, total = None, np.zeros(0, np.int64)
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                some = np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
                if block != held and held is not None:
                    yield emit(held, total)
                total = total + some if block == held else some
                held = block
        if held is not None:
            yield emit(held, total)

    blocks = bounded_batches(corpus).mapInArrow(count, "block long, counts binary").repartition("block").sortWithinPartitions("block")
    out = materialize(blocks.mapInArrow(add, ", ".join(f"{w} long" for w in words) + ", f long"), "counts")
    shared.destroy()
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _part(words: list[str], start: Column | int, length: Column | int, names: list[str]) -> list[Column]:
    """The ``length`` words from place ``start`` (from 1), 0 behind them, as columns called ``names``."""
    all_words = F.array(*map(F.col, words), *[F.lit(0).cast("long") for _ in words])
    n = length if isinstance(length, Column) else F.lit(length)
    s = start if isinstance(start, Column) else F.lit(start)
    return [F.when(F.lit(k) < n, F.element_at(all_words, (s + k).cast("int"))).otherwise(F.lit(0).cast("long")).alias(name) for k, name in enumerate(names)]


def scored(counts: DataFrame, params: Params) -> DataFrame:
    """Candidates with ``a``, ``l``, ``r`` and ``score``, without those that live inside longer ones."""
    width = params.max_words
    words = [f"w{k + 1}" for k in range(width)]
    size = sum((F.col(w) > 0).cast("int") for w in words)
    candidates = counts.where("w2 > 0").withColumn("_size", size).withColumnRenamed("f", "a")
    left, right = [f"l{k}" for k in range(width)], [f"r{k}" for k in range(width)]
    cuts = candidates.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_size") - 1)))
    cuts = cuts.select(*words, "a", "_k", *_part(words, 1, F.col("_k"), left), *_part(words, F.col("_k") + 1, F.lit(width) - F.col("_k"), right))
    named = lambda names, value: counts.select(*[F.col(w).alias(n) for w, n in zip(words, names)], F.col("f").alias(value))
    joined = cuts.join(named(left, "l"), left).join(named(right, "r"), right)
    wide = "decimal(19,0)"
    score = F.expr(f"(cast({params.scale} as {wide}) * cast(a as {wide})) div (cast(l as {wide}) + cast(r as {wide}))")
    worst = joined.withColumn("_score", score.cast("long")).groupBy(*words).agg(F.min(F.struct("_score", "_k", "l", "r")).alias("_w"), F.first("a").alias("a"))
    spans = [(n, s) for n in range(2, width) for s in range(1, width - n + 2)]
    inner = [F.when((F.col("_size") > n) & (F.lit(s + n - 1) <= F.col("_size")), F.struct(*_part(words, s, n, words))) for n, s in spans]
    around = candidates.where("w3 > 0").select("a", F.explode(F.array_compact(F.array(*inner))).alias("_s")) if inner else None
    kept = worst
    if around is not None:
        longest = around.groupBy(*[F.col(f"_s.{w}").alias(w) for w in words]).agg(F.max("a").alias("_longer"))
        kept = worst.join(longest, words, "left").where(f"_longer is null or 100 * cast(_longer as decimal(20,0)) < {params.inside_percent} * cast(a as decimal(20,0))")
    return kept.select(*words, "a", F.col("_w.l").alias("l"), F.col("_w.r").alias("r"), F.col("_w._score").alias("score"))


def mine(docs: DataFrame, params: Params = Params(), *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top`` phrases of each language by score, count (descending) and phrase (ascending, UTF-8 bytes).

    Columns: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.
    """
    docs = bounded_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit(LANGUAGE_UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    width, words = params.max_words, [f"w{k + 1}" for k in range(params.max_words)]
    counts = materialize(word_counts(docs).where(F.col("word").isNull() | (F.col("n") >= params.min_count)), "words")
    vocabulary = materialize(global_row_number(counts.where("word is not null"), [F.asc("lang"), F.asc("word")], "id"), "vocabulary")
    size = vocabulary.count()
    kind = "<i4" if size < 1 << 31 else "<i8"
    corpus = _numbered(docs, vocabulary, max(1, math.ceil(size / params.max_phrases)), kind)

    padded = lambda df: df.select(*[F.col(w) if w in df.columns else F.lit(0).cast("long").alias(w) for w in words])
    known = padded(vocabulary.select(F.col("id").alias("w1")))
    for length in range(2, width + 1):
        grown = [_grown(corpus, trie, length, kind, params.min_count) for trie in _tries(known, width, params.max_phrases)]
        if not grown:
            break
        known = known.unionByName(padded(_union(grown)))
    summed = [_counted(corpus, trie, width, kind) for trie in _tries(known, width, params.max_phrases)]
    empty = docs.sparkSession.createDataFrame([], ", ".join(f"{w} long" for w in words) + ", f long")
    found = scored(_union(summed) if summed else empty, params)

    of_lang = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = found.join(vocabulary.select(F.col("id").alias("w1"), "lang"), "w1").withColumn("_rank", F.rank().over(of_lang)).where(F.col("_rank") <= params.top)
    best = materialize(best.drop("_rank"), "best")
    for w in words:
        best = best.join(vocabulary.select(F.col("id").alias(w), F.col("word").alias(f"_{w}")), w, "left")
    best = best.join(counts.where("word is null").select("lang", F.col("n")), "lang")
    best = best.withColumn("phrase", F.concat_ws(" ", *[f"_{w}" for w in words]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= params.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
