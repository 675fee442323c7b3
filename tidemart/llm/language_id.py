"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is fitted on a bounded sample of labelled documents (whole texts, up
to ``max_docs_per_language`` in expectation for each language, chosen by a hash
of the id).  What reaches the driver is one count for each language and hash
bucket, so its size is fixed by ``buckets`` and the number of languages.  The
matrix of log-probabilities is broadcast; scoring runs over Arrow batches, in
numpy, in slices of bounded length, over whole texts.

Edge cases: a null text, or one without any letter, gives ``und`` with score 0;
equal scores give the language that sorts first; a repeated row is scored as
often as it appears; an empty table gives an empty result; with no labelled
rows at all every document is ``und``; columns of the input that are called like
an output column are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, let_go, parts, without

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
MAX_DOCS_PER_LANGUAGE = 2000
MAX_LANGUAGES = 512
SLICE = 1 << 17

_WORD = re.compile(r"[^\W\d_]")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's category L; some numbers count as parts of words too."""
    return any(m[0].isalpha() for m in _WORD.finditer(text))


@dataclass(frozen=True)
class LanguageModel:
    """Languages in code-point order, log priors, and log-probabilities by bucket and language.

    The last row is for what is no n-gram, all zeros.
    """

    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.log_prob) - 1


def _slices(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of whole texts in buffers of bounded length.

    Yields the code points, and for each slice its text's index, its start in
    the buffer and how many n-gram starts it owns; the few code points beyond
    those belong to the slice only as the ends of its last n-grams.
    """
    longest = max(ORDERS)
    parts, owner, own, size = [], [], [], 0
    for i, text in enumerate(texts):
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
        for at in range(0, len(codes), SLICE):
            part = codes[at : at + SLICE + longest - 1]
            parts.append(part)
            owner.append(i)
            own.append(min(SLICE, len(codes) - at))
            size += len(part)
            if size >= SLICE:
                yield _buffer(parts, owner, own)
                parts, owner, own, size = [], [], [], 0
    if parts:
        yield _buffer(parts, owner, own)


def _buffer(parts: list[np.ndarray], owner: list[int], own: list[int]) -> tuple:
    starts = np.cumsum([0, *map(len, parts[:-1])])
    return np.concatenate(parts), np.array(owner), starts, np.array(own)


def _hashed(codes: np.ndarray, starts: np.ndarray, own: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """The bucket of the n-gram that starts at each position, for each order; ``buckets`` where there is none."""
    lengths = np.diff(np.append(starts, len(codes)))
    at = np.arange(len(codes)) - np.repeat(starts, lengths)
    left = np.repeat(lengths, lengths) - at
    owned = at < np.repeat(own, lengths)
    mixed = np.zeros(len(codes), dtype=np.uint32)
    for n in ORDERS:
        shifted = np.zeros(len(codes), dtype=np.uint32)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        mixed = (mixed ^ (shifted + np.uint32(n))) * _MIX[n - 1]
        mixed ^= mixed >> np.uint32(15)
        yield np.where(owned & (left >= n), mixed & np.uint32(buckets - 1), np.uint32(buckets)).astype(np.int64)


def fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    buckets: int = BUCKETS,
    max_docs_per_language: int = MAX_DOCS_PER_LANGUAGE,
    smoothing: float = 0.1,
) -> LanguageModel:
    """Learn from the rows of ``docs`` whose text and language are both given."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    known = rows.where("t is not null and l is not null")
    totals = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(sorted(totals))
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros((buckets + 1, 0)))
    share = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, max_docs_per_language / totals[l]))])
    sample = known.where(F.pmod(F.xxhash64("i", F.lit(17)), F.lit(1_000_000)) < share[F.col("l")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), buckets + 1), dtype=np.int64)
        place = {l: k for k, l in enumerate(languages)}
        for batch in batches:
            of = np.array([place[l] for l in batch.column("l").to_pylist()], dtype=np.int64)
            for codes, owner, starts, own in _slices(batch.column("t").to_pylist()):
                row = np.repeat(of[owner], np.diff(np.append(starts, len(codes)))) * (buckets + 1)
                for bucket in _hashed(codes, starts, own, buckets):
                    counts += np.bincount(row + bucket, minlength=counts.size).reshape(counts.shape)
        lang, bucket = np.nonzero(counts[:, :buckets])
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(counts[lang, bucket])], names=["lang", "bucket", "n"])

    found = bounded_batches(sample).mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((buckets, len(languages)))
    counts[found["bucket"].to_numpy(dtype=np.int64), found["lang"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    counts += smoothing
    prior = np.array([totals[l] for l in languages], dtype=np.float64)
    return LanguageModel(languages, np.log(prior / prior.sum()), np.vstack([np.log(counts / counts.sum(axis=0)), np.zeros(len(languages))]))


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], list[float]]:
    """Language and posterior probability of each whole text."""
    use = [i for i, t in enumerate(texts) if model.languages and t is not None and has_letter(t)]
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not use:
        return langs, scores
    total = np.tile(model.log_prior, (len(use), 1))
    for codes, owner, starts, own in _slices([texts[i] for i in use]):
        gathered = None
        for bucket in _hashed(codes, starts, own, model.buckets):
            gathered = model.log_prob[bucket] if gathered is None else gathered + model.log_prob[bucket]
        np.add.at(total, owner, np.add.reduceat(gathered, starts, axis=0))
    best = total.argmax(axis=1)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    for i, k, p in zip(use, best, odds.max(axis=1) / odds.sum(axis=1)):
        langs[i], scores[i] = model.languages[k], float(p)
    return langs, scores


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only ``text_col`` is looked at."""
    kept = without(docs, ["lang_pred", "score"])
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            langs, scores = [], []
            for texts in parts(batch.column(at)):
                found = score_texts(texts, shared.value)
                langs += found[0]
                scores += found[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return bounded_batches(kept).mapInArrow(predict, schema)
