"""Token ids as directly addressable codes: a binary corpus with random access to any token.

An id is split into chunks, low bits first.  Level 0 holds the first chunk of every id, level 1 the
second chunk of those that have one, and so on; the continuation bitmap of a level says which of
its ids go on, and its rank directory (ones before each block of ``RANK_BITS`` bits) says where.  So
the id at a place is found with one rank a level, and nothing around it is decoded.  The widths of the
chunks are those that take least space for the segment's own ids, in multiples of 8 bits.

Files.  Documents in ascending order of id (null first, then by their ids) are cut into segments of
about ``SEGMENT_TOKENS`` tokens, never inside a document.  A segment is a line of ASCII,
``DAC1 range before tokens docs bytes``, where ``before`` counts the tokens of its range of documents before
it, then ``bytes`` bytes and a line feed.  A file below ``segments`` holds at most ``SEGMENTS_A_FILE`` segments of one range, and
``index``, written last, has the tokens before each range (a Parquet row each).  The bytes are arrays, each behind its
size as an unsigned 32-bit integer:

    widths of the levels (8 bits each) | document ids (64 bits) | which of them are null (bits)
    | ends of documents (64 bits, relative) | for each level: chunks, bitmap, directory (32 bits)

All numbers are little-endian.  Spark's own sinks and sources write and read the files, so any file
system will do.  Encoding is done once: its result is written, dealt by ranges of id (rows
of one id are told apart by their tokens, equal ones by a number, so that none of them makes a hot range) and sorted.

Edge cases: a null or empty text is the end id alone; a null id comes first; repeated rows are
documents of their own; an empty table gives no segments and an empty result; other columns are
ignored; a damaged segment raises ValueError; positions outside the corpus have no row in ``tokens_at``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, parts
from .common import held as remembered
from .packing import MAX_TOKENIZER_BYTES
from .tokens import CACHE_WORDS, WordEncoder

#: Fixed values of the format.
MAGIC = "DAC1"
RANK_BITS = 512

SEGMENT_TOKENS = 1 << 20
SEGMENTS_A_FILE = 16
#: Requests for single tokens that one copy of a segment answers.
REQUESTS_A_COPY = 1_000_000
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def best_widths(ids: np.ndarray) -> list[int]:
    """Widths of the chunks, first level first, that take the least bits, bitmaps included."""
    top = int(ids.max()) if len(ids) else 0
    size = max(1, -(-top.bit_length() // 8))
    #: ids that need more than k bytes
    longer = [len(ids)] + [int(np.count_nonzero(ids >> np.uint64(8 * k))) for k in range(1, size)]
    best: list[tuple[int, list[int]]] = [(0, [])] * (size + 1)
    for at in range(size - 1, -1, -1):
        best[at] = min((longer[at] * (8 * (to - at) + 1) + best[to][0], [8 * (to - at), *best[to][1]]) for to in range(at + 1, size + 1))
    return best[0][1]


def _chunks(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : width // 8].tobytes()


def encode_levels(ids: np.ndarray) -> list[bytes]:
    """Widths, then chunks, bitmap and directory of every level."""
    left = ids.astype(np.uint64)
    widths = best_widths(left)
    out = [bytes(widths)]
    for level, width in enumerate(widths):
        rest = left >> np.uint64(width) if width < 64 else np.zeros_like(left)
        goes_on = rest > 0
        bits = np.packbits(goes_on, bitorder="little")
        blocks = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), RANK_BITS // 8), dtype=np.uint64) if len(bits) else np.zeros(0, np.uint64)
        out += [_chunks(left, width), bits.tobytes(), np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4").tobytes() if len(blocks) else b""]
        left = rest[goes_on]
    return out


def framed(arrays: Sequence[bytes]) -> bytes:
    return b"".join(len(a).to_bytes(4, "little") + a for a in arrays)


class Segment:
    """A segment's documents, and its tokens by place."""

    def __init__(self, body: bytes, tokens: int, docs: int):
        arrays, at = [], 0
        while at < len(body):
            n = int.from_bytes(body[at : at + 4], "little")
            arrays.append(memoryview(body)[at + 4 : at + 4 + n])
            at += 4 + n
        if at != len(body) or len(arrays) < 4 or len(arrays) != 4 + 3 * len(arrays[0]):
            raise ValueError("a segment's arrays don't fill it")
        self.n, self.widths = tokens, [int(w) for w in arrays[0]]
        null = np.unpackbits(np.frombuffer(arrays[2], np.uint8), count=docs, bitorder="little").astype(bool)
        self.doc_ids = pa.array(np.frombuffer(arrays[1], "<i8"), mask=null)
        self.ends = np.frombuffer(arrays[3], "<i8")
        if len(self.doc_ids) != docs or len(self.ends) != docs or (docs and self.ends[-1] != tokens):
            raise ValueError("a segment holds other documents than it states")
        self.levels = [(np.frombuffer(c, np.uint8).reshape(-1, w // 8), np.frombuffer(b, np.uint8), np.frombuffer(d, "<u4")) for w, c, b, d in zip(self.widths, arrays[4::3], arrays[5::3], arrays[6::3])]

    @staticmethod
    def _value(chunks: np.ndarray) -> np.ndarray:
        out = chunks[:, 0].astype(np.uint64)
        for k in range(1, chunks.shape[1]):
            out |= chunks[:, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places, each by a rank a level."""
        places = np.asarray(places, dtype=np.int64)
        out, who, shift = np.zeros(len(places), np.uint64), np.arange(len(places)), 0
        for width, (chunks, bits, directory) in zip(self.widths, self.levels):
            out[who] |= self._value(chunks[places]) << np.uint64(shift)
            on = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            who, places, shift = who[on], places[on], shift + width
            if not len(who):
                break
            byte, block = places >> 3, places // RANK_BITS
            inside = block[:, None] * (RANK_BITS // 8) + np.arange(RANK_BITS // 8)
            ones = np.where(inside < byte[:, None], np.bitwise_count(bits[np.minimum(inside, len(bits) - 1)]), 0).sum(axis=1, dtype=np.int64)
            partial = np.bitwise_count(bits[byte] & ((1 << (places & 7)) - 1).astype(np.uint8))
            places = directory[block].astype(np.int64) + ones + partial
        return out

    def all(self) -> np.ndarray:
        """All ids in their order."""
        out, who, shift, n = np.zeros(self.n, np.uint64), slice(None), 0, self.n
        for width, (chunks, bits, _) in zip(self.widths, self.levels):
            if len(chunks) != n:
                raise ValueError("a level holds other ids than the one before says")
            out[who] |= self._value(chunks) << np.uint64(shift)
            on = np.flatnonzero(np.unpackbits(bits, count=n, bitorder="little"))
            who, shift, n = on if isinstance(who, slice) else who[on], shift + width, len(on)
        return out


def encoded(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, cache_words: int = CACHE_WORDS) -> DataFrame:
    """``doc_id``, ``ids`` (unsigned little-endian integers of ``width`` bytes, the end id last, as Zstandard frames), ``row`` of every document."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    if len(tokenizer) > MAX_TOKENIZER_BYTES:
        raise ValueError("the tokenizer's file is too large to broadcast")
    shared, key = docs.sparkSession.sparkContext.broadcast(tokenizer), hash(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(("words", key, cache_words), lambda: WordEncoder(shared.value, cache_words))
        squeeze = zstandard.ZstdCompressor(level=1).compress
        end, row = np.array([end_id], dtype=encoder.kind).tobytes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for names, texts in zip(parts(batch.column(0), 400), parts(batch.column(1), 400)):
                ids = [squeeze(i + end) for i in encoder.encode([t or "" for t in texts])]
                columns = [pa.array(names, pa.int64()), pa.array(ids, pa.binary()), pa.array([encoder.width] * len(ids), pa.int32()), pa.array(range(row, row + len(ids)), pa.int64())]
                row += len(ids)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "width", "row"])

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, width int, row long")


def _segments(rows: DataFrame, segment_tokens: int) -> DataFrame:
    """Segments of sorted documents; a partition is a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, before = TaskContext.get().partitionId(), 0
        loosen = zstandard.ZstdDecompressor().decompress
        names: list[int | None] = []
        held: list[np.ndarray] = []
        tokens = 0

        def emit() -> pa.RecordBatch:
            nonlocal names, held, tokens, before
            ends = np.cumsum([len(h) for h in held]).astype("<i8")
            widths, *levels = encode_levels(np.concatenate(held))
            null = np.packbits([n is None for n in names], bitorder="little").tobytes()
            body = framed([widths, np.array([n or 0 for n in names], "<i8").tobytes(), null, ends.tobytes(), *levels])
            head = f"{MAGIC} {piece} {before} {tokens} {len(names)} {len(body)}\n".encode()
            names, held, before, tokens = [], [], before + tokens, 0
            return pa.RecordBatch.from_arrays([pa.array([head + body], pa.binary())], names=["segment"])

        for batch in batches:
            for name, ids, width in zip(*(c.to_pylist() for c in batch.columns)):
                names.append(name)
                held.append(np.frombuffer(loosen(ids), f"<u{width}"))
                tokens += len(held[-1])
                if tokens >= segment_tokens:
                    yield emit()
        if names:
            yield emit()

    return rows.mapInArrow(run, "segment binary")


def write(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode all documents and write their segments below ``path``."""
    rows = materialize(encoded(docs, tokenizer_path, id_col=id_col, text_col=text_col, end_id=end_id), "ids", compression="none")
    order = [F.asc_nulls_first("doc_id"), F.asc("_h"), F.asc("row")]
    dealt = rows.withColumn("_h", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order)
    segments = _segments(dealt.select("doc_id", "ids", "width"), segment_tokens)
    # the text sink writes a row's bytes as they are, and a line feed
    segments.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", SEGMENTS_A_FILE).option("compression", "none").text(f"{path}/segments")
    sizes = _parsed(docs.sparkSession, path).groupBy("piece").agg(F.sum("tokens").alias("_n"))  # a row for each partition of the shuffle
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.select("piece", earlier.alias("first")).write.parquet(f"{path}/index")


def _cut(content: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Range, tokens before, tokens, documents and the bytes of each segment in a file."""
    at = 0
    while at < len(content):
        end = content.find(b"\n", at, at + 160)
        head = content[at:end].split() if end >= 0 else []
        if len(head) != 6 or head[0] != MAGIC.encode():
            raise ValueError("no segment begins where one should")
        *numbers, size = map(int, head[1:])
        if content[end + 1 + size : end + 2 + size] != b"\n":
            raise ValueError("a segment doesn't end where it should")
        yield *numbers, content[end + 1 : end + 1 + size]
        at = end + 2 + size


def _files(spark: SparkSession, path: str) -> DataFrame:
    return bounded_batches(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/segments")).select("content")


def _parsed(spark: SparkSession, path: str, with_body: bool = False) -> DataFrame:
    """``piece``, ``before``, ``tokens``, ``docs`` (and ``body``) of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["piece", "before", "tokens", "docs", *["body"] * with_body]
        for batch in batches:
            for content in batch.column(0):
                for row in _cut(content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if k == 4 else pa.int64()) for k, v in enumerate(row[: len(names)])], names=names)

    return _files(spark, path).mapInArrow(run, "piece long, before long, tokens long, docs long" + ", body binary" * with_body)


def _placed(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """``rows`` of a ``piece`` with ``first``, the tokens before it; the index has a row for each range."""
    return rows.join(F.broadcast(spark.read.schema("piece long, first long").parquet(f"{path}/index")), "piece")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Of every document in the files below ``path``: see ``DOCUMENTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for piece, before, tokens, docs, body in _cut(content.as_py()):
                    segment = Segment(body, tokens, docs)
                    ids = segment.all().astype("<u4")
                    ends = segment.ends.tolist()
                    starts = [0, *ends[:-1]]
                    sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                    columns = [pa.array([piece] * docs, pa.int64()), segment.doc_ids, pa.array(np.array(starts, np.int64) + before), pa.array(np.diff([0, *ends])), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["piece", "doc_id", "start", "n_tokens", "ids_crc32"])

    found = _files(spark, path).mapInArrow(run, "piece long, " + DOCUMENTS)
    return _placed(spark, path, found).select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, column: str = "position") -> DataFrame:
    """``position``, ``token``: the id at each distinct position in the corpus, without decoding what is around it.

    Segments and the positions in them meet by blocks of ``SEGMENT_TOKENS`` positions; a segment that is asked for
    very often is copied once for each ``REQUESTS_A_COPY`` requests.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, first = None, 0
        for batch in batches:
            rows = batch.to_pydict()
            at = 0
            while at < batch.num_rows:
                if rows["position"][at] is None:
                    first, segment = rows["start"][at], Segment(rows["body"][at], rows["tokens"][at], rows["docs"][at])
                    at += 1
                    continue
                to = at
                while to < batch.num_rows and rows["position"][to] is not None:
                    to += 1
                wanted = np.array(rows["position"][at:to], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(wanted), pa.array(segment.at(wanted - first).astype(np.int64))], names=["position", "token"])
                at = to

    start = (F.col("first") + F.col("before")).alias("start")
    spans = _placed(spark, path, _parsed(spark, path)).select(start, "tokens")
    segments = _placed(spark, path, _parsed(spark, path, with_body=True)).select(start, "tokens", "docs", "body")
    block = lambda c: F.floor(c / F.lit(SEGMENT_TOKENS)).cast("long")
    spread = spans.withColumn("_block", F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.col("tokens") - 1))))
    asked = positions.select(F.col(column).cast("long").alias("position")).where("position is not null").distinct().withColumn("_block", block(F.col("position")))
    found = asked.join(spread, "_block").where("position >= start and position < start + tokens").select("start", "position")
    copies = found.groupBy("start").agg(F.ceil(F.count("*") / REQUESTS_A_COPY).cast("int").alias("_copies"))
    salted = found.join(copies, "start").select("start", F.pmod(F.xxhash64("position"), "_copies").cast("int").alias("_copy"), "position", F.lit(None).cast("long").alias("tokens"), F.lit(None).cast("long").alias("docs"), F.lit(None).cast("binary").alias("body"))
    bodies = segments.join(copies, "start").select("start", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"), F.lit(None).cast("long").alias("position"), "tokens", "docs", "body")
    dealt = bounded_batches(bodies.unionByName(salted)).repartition("start", "_copy").sortWithinPartitions("start", "_copy", F.asc_nulls_first("position"))
    return dealt.mapInArrow(answer, "position long, token long")
