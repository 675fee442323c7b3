"""Token counts of a unigram vocabulary without making tokens.

A text's spaces become the word mark, one is put in front unless it begins with
one, and each mark begins a chunk; without ``split_marks`` only a mark that follows no
other does, so that pieces of several marks are found too (and a text is one chunk if
a piece of the vocabulary goes over such a place, or it has no mark alone).  In a chunk an Aho-Corasick automaton lists
every vocabulary piece by where it ends; dynamic programming carries the best
score and its number of pieces to each end.  Ties are the tokenizer's: only a
strictly better score replaces an earlier one, and pieces come longest first.  A
character that no piece of one character covers may stand alone as unknown, with
the least score of the vocabulary less ``UNKNOWN_PENALTY``; it counts as its
UTF-8 bytes with byte fallback, else runs of unknown characters count as one.

Chunks repeat, so a worker remembers a bounded number of recent counts.  The
vocabulary is broadcast (its size is checked).

Edge cases: a null or empty text counts 0; texts of any length are counted
whole; repeated rows are each counted; null ids stay null; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held, parts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_CHUNKS = 300_000
MAX_PIECES = 2_000_000
_RUNS = re.compile(" +[^ ]*")


def sentencepiece_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class UnigramCounter:
    """Counts pieces of the best segmentation."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]], byte_fallback: bool, cache_chunks: int = CACHE_CHUNKS, split_marks: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary:
            self.automaton.make_automaton()
        self.singles = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.cache_chunks = cache_chunks
        self.split_marks = split_marks
        self.whole = not split_marks and (MARK not in self.singles or any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in vocabulary))
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count_chunk(self, chunk: str) -> int:
        n = len(chunk)
        best, pieces = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        matches = self.automaton.iter(chunk) if self.singles else ()
        if self.singles.issuperset(chunk):
            for last, (length, score) in matches:
                total = best[last + 1 - length] + score
                if total > best[last + 1]:
                    best[last + 1], pieces[last + 1] = total, pieces[last + 1 - length] + 1
            return pieces[n]
        unknown_end = [False] * (n + 1)
        matches, ahead = iter(matches), None
        for end in range(1, n + 1):
            ahead = ahead or next(matches, None)
            while ahead and ahead[0] + 1 == end:
                length, score = ahead[1]
                total = best[end - length] + score
                if total > best[end]:
                    best[end], pieces[end], unknown_end[end] = total, pieces[end - length] + 1, False
                ahead = next(matches, None)
            char = chunk[end - 1]
            if char not in self.singles and best[end - 1] + self.unknown > best[end]:
                more = len(char.encode("utf-8", "replace")) if self.byte_fallback else 0 if unknown_end[end - 1] else 1
                best[end], pieces[end], unknown_end[end] = best[end - 1] + self.unknown, pieces[end - 1] + more, True
        return pieces[n]

    def _learn(self, chunks: set[str]) -> None:
        if len(self.new) > self.cache_chunks:
            self.old, self.new = self.new, {}
        missing = chunks.difference(self.new)
        known = missing.intersection(self.old)
        self.new.update(zip(known, map(self.old.__getitem__, known)))
        count = self.count_chunk
        self.new.update((c, count(MARK + c.replace(" ", MARK))) for c in missing - known)

    def _chunks(self, text: str) -> list[str]:
        """Chunks of a text without their first mark."""
        text = text.replace(MARK, " ")
        if self.split_marks or not (self.whole or "  " in text):
            chunks = text.split(" ")
            return chunks[1:] if chunks[0] == "" else chunks
        if self.whole:
            return [text.removeprefix(" ")] if text else []
        return [run[1:] for run in _RUNS.findall(text if text[0] == " " else f" {text}")]

    def count(self, texts: list[str | None], rows: int = 400) -> list[int]:
        """Tokens of each whole text."""
        out = []
        for at in range(0, len(texts), rows):
            cut = []
            for text in texts[at : at + rows]:
                cut.append(self._chunks(text or ""))
            self._learn(set().union(*cut))
            out += [sum(map(self.new.__getitem__, chunks)) for chunks in cut]
        return out


def count_tokens(docs: DataFrame, vocabulary: Sequence[tuple[str, float]], *, byte_fallback: bool = True, split_marks: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` for every row."""
    if len(vocabulary) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    shared = docs.sparkSession.sparkContext.broadcast((list(vocabulary), byte_fallback))
    key = hash((tuple(vocabulary), byte_fallback, split_marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(("pieces", key), lambda: UnigramCounter(*shared.value, split_marks=split_marks))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for texts in parts(batch.column(1), 400) for n in counter.count(texts)], pa.int64())], names=["doc_id", "n_tokens"])

    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long")
