"""Cost-balanced packing of documents into token sequences.

A document's cost is ``linear * n + quadratic * n ** 2`` for ``n`` tokens (each
document attends to itself only).  Documents are gathered, as Spark reads them,
into packs of a bounded number of tokens; inside a pack they are taken in
descending order of cost and each goes to the sequence of lowest cost that still
has room.  Documents above the capacity are first cut at it; where no sequence
has room left for a whole piece, the piece is cut at the roomiest one.  A pack's
capacity is exactly its number of tokens, so no sequence is padded: all are of
full length, but for the last pack of a partition, whose rest fills sequences
with a power of two of tokens each, which need no padding either (at most as many
as the capacity has bits, for each partition that is read).

No shuffle takes place and no more than one pack is held.  Sequence ids carry
the partition's number, so they never clash; a lost task is simply run again.

Edge cases: a null or empty text holds the end id only; repeated rows are packed
as often as they appear, each as a document of its own; equal costs keep the
order of reading; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, parts
from .common import held as remembered
from .tokens import CACHE_WORDS, WordEncoder

CAPACITY = 4096
PACK_SEQUENCES = 256
MAX_TOKENIZER_BYTES = 64 << 20

#: ``document`` numbers the rows that were packed, so that pieces of repeated rows can be told apart.
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, document long"


def room_of(tokens: int, capacity: int, last: bool) -> list[int]:
    """Lengths of the sequences for ``tokens`` tokens: full ones, then (in a last pack) powers of two."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + ([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1] if last else [])


def assign(lengths: list[int], rooms: list[int], linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of these lengths; ``sum(lengths) >= sum(rooms)``."""
    longest = max(rooms, default=0)
    pieces = [(d, at, min(longest, n - at)) for d, n in enumerate(lengths) for at in range(0, n, longest or 1)]
    pieces.sort(key=lambda p: (-p[2], p[0], p[1]))
    room, cost, used = np.array(rooms), np.zeros(len(rooms)), np.zeros(len(rooms), dtype=np.int64)
    out = []
    queue = list(reversed(pieces))
    while queue:
        doc, start, n = queue.pop()
        fits = room >= n
        if fits.any():
            k = int(np.where(fits, cost, np.inf).argmin())
        else:
            k = int(room.argmax())
            queue.append((doc, start + int(room[k]), n - int(room[k])))
            n = int(room[k])
        out.append((doc, start, n, k, int(used[k])))
        room[k] -= n
        used[k] += n
        cost[k] += linear * n + quadratic * n * n
    return out


def _merged(pieces: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Neighbouring pieces of one document in one sequence as one."""
    out: list[tuple[int, int, int, int, int]] = []
    for doc, start, n, k, offset in sorted(pieces):
        if out and (p := out[-1])[0] == doc and p[3] == k and p[1] + p[2] == start and p[4] + p[2] == offset:
            out[-1] = (doc, p[1], p[2] + n, k, p[4])
        else:
            out.append((doc, start, n, k, offset))
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    capacity: int = CAPACITY,
    pack_sequences: int = PACK_SEQUENCES,
    linear: float = 1.0,
    quadratic: float = 1.0 / CAPACITY,
    with_ids: bool = False,
    cache_words: int = CACHE_WORDS,
) -> DataFrame:
    """One row for each piece: see ``PIECES``; ``with_ids`` adds the piece's ids as ``ids array<int>``.

    ``cache_words``: how many words' ids a worker remembers, twice; more take memory, fewer take time.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    if len(tokenizer) > MAX_TOKENIZER_BYTES:
        raise ValueError("the tokenizer's file is too large to broadcast")
    shared, key = docs.sparkSession.sparkContext.broadcast(tokenizer), hash(tokenizer)
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(("words", key, cache_words), lambda: WordEncoder(shared.value, cache_words))
        kind, width = encoder.kind, encoder.width
        end = np.array([end_id], dtype=kind).tobytes()
        sequence = number = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, int, int, bytes, int]] = []  # id, ids before, ids of the document, ids, number
        tokens = 0

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal sequence, held, tokens
            rooms = room_of(tokens, capacity, last)
            rest = tokens - sum(rooms)
            keep = []
            while rest:  # goes to the next pack
                doc, before, total, ids, own = held.pop()
                n = len(ids) // width
                cut = max(0, n - rest)
                keep.append((doc, before + cut, total, ids[cut * width :], own))
                if cut:
                    held.append((doc, before, total, ids[: cut * width], own))
                rest -= n - cut
            cols: list[list] = [[] for _ in range(9 if with_ids else 8)]
            for d, start, n, k, offset in _merged(assign([len(h[3]) // width for h in held], rooms, linear, quadratic)):
                doc, before, total, ids, own = held[d]
                piece = np.frombuffer(ids, dtype=kind)[start : start + n]
                row = [doc, before + start, n, zlib.crc32(piece.astype("<u4").tobytes()), total, sequence + k, offset, own]
                for col, value in zip(cols, [*row, piece.astype(np.int32)] if with_ids else row):
                    col.append(value)
            sequence += len(rooms)
            held = keep[::-1]
            tokens = sum(len(h[3]) // width for h in held)
            arrays = [pa.array(c, pa.int64()) for c in cols[:8]] + ([pa.array(cols[8], pa.list_(pa.int32()))] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "document", "ids"][: len(arrays)])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, texts in zip(range(0, len(names), 400), parts(batch.column(1), 400)):
                for doc, ids in zip(names[at : at + 400], encoder.encode([t or "" for t in texts])):
                    ids += end
                    held.append((doc, 0, len(ids) // width, ids, number))
                    number += 1
                    tokens += len(ids) // width
                    if tokens >= capacity * pack_sequences:
                        yield emit(last=False)
        if tokens:
            yield emit(last=True)

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)

