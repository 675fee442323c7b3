"""WARC archives as chunked record tables.

Writing: every page becomes rows of record identifier and chunk number, each with
at most ``chunk_chars`` characters of the payload and, carried from row to row,
the size and digest of the payload so far; only the last row of a record tells
them whole.  Payloads equal to one of a smaller page id become ``revisit``
records.  Rows are dealt by record and sorted, and Spark's text sink writes them
to any file system that Spark can reach: one record a page, whose HTTP body has
the ``chunked`` transfer coding, a chunk for each row, so no record is ever put
together whole.

Reading: by Content-Length alone, as any reader does, so archives of other
writers can be read.  Spark's text source gives an archive's lines in order (a
gzipped file is never cut into splits); sizes and digests of payloads are carried
from line to line and checked against what the record states.

Edge cases: a null html is the empty payload; a null url leaves its header out; a
null page id is written as ``none`` and may be a revisit, but nothing refers to
it; record ids are those of pages with the number of the row, so none is there twice; rows repeated with one page id are records of their own, and equal ones are
all responses; control characters in a url are percent-encoded; an empty table
gives archives without records and an empty result; other columns are ignored.
A damaged record raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, looked_up, materialize, parts

#: Fixed values of the format.
VERSION = "WARC/1.1"
LINE = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = LINE.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked"]) + LINE * 2
HTTP_BODY_END = f"0{LINE * 2}"

CHUNK_CHARS = 64 * 1024
#: Rows of a worker are handed on when they hold so many characters.
FLUSH_CHARS = 4 << 20
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
CHUNKS = "record long, page_id long, url string, chunk int, data string, data_bytes long, bytes long, body_bytes long, digest string, whole boolean"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _b32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """``rows`` as Arrow, in the columns of ``schema``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    named = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(named)], names=[n for n, _ in named])


def chunk_table(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """A row for each chunk of each page: see ``CHUNKS``; sizes and digests are of all up to this chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for record, page, url, html in zip(*(chain.from_iterable(parts(c, 16)) for c in batch.columns)):
                html, digest, size, body = html or "", hashlib.sha1(), 0, len(HTTP_BODY_END)
                for k, at in enumerate(range(0, max(1, len(html)), chunk_chars)):
                    data = html[at : at + chunk_chars]
                    raw = data.encode()
                    digest.update(raw)
                    size += len(raw)
                    body += len(f"{len(raw):x}") + len(raw) + 2 * len(LINE) if raw else 0
                    out.append((record, page, None if k else url, k, data, len(raw), size, body, _b32(digest), at + chunk_chars >= len(html)))
                    held += len(data)
                    if held > FLUSH_CHARS:
                        yield _columns(out, CHUNKS)
                        out, held = [], 0
        yield _columns(out, CHUNKS)

    rows = bounded_batches(pages).select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(run, CHUNKS)


def _records(chunks: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """``record``, ``whole_body``, ``whole_digest``, ``refers_to`` and ``refers_record`` of every record."""
    whole = materialize(chunks.where("whole").select("record", "page_id", "bytes", "body_bytes", "digest"), "records")
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record"))
    again = whole.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest", "bytes").agg(F.min(named).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    refers = [F.when(revisits, F.col("first.page_id")).alias("refers_to"), F.when(revisits, F.col("first.record")).alias("refers_record")]
    return looked_up(whole, again, ["digest", "bytes"]).select("record", F.col("body_bytes").alias("whole_body"), F.col("digest").alias("whole_digest"), *refers)


def _head(record: int, page: int | None, url: str | None, body: int, digest: str, refers: int | None, refers_record: int | None, date: str) -> str:
    """All of a record before its payload, without the last line break."""
    name = lambda p, r: f"<urn:page:{'none' if p is None else p}:{r}>"
    http = HTTP if refers is None else HTTP.replace(f"Transfer-Encoding: chunked{LINE}", "")
    fields = {
        "WARC-Type": "response" if refers is None else "revisit",
        "WARC-Record-ID": name(page, record),
        "WARC-Refers-To": None if refers is None else name(refers, refers_record),
        "WARC-Profile": None if refers is None else PROFILE,
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Length": len(http) + (body if refers is None else 0),
    }
    return LINE.join([VERSION, *(f"{k}: {v}" for k, v in fields.items() if v is not None), "", http.removesuffix(LINE)])


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, chunk_chars: int = CHUNK_CHARS, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for every page to gzipped archives below ``path``."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for record, page, url, k, data, n, whole, body, digest, refers, refers_record in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    if k == 0:
                        out.append(_head(record, page, url, body, digest, refers, refers_record, date))
                    if refers is None and n:
                        out += [f"{n:x}", data]
                    if whole:  # two line breaks end a record, two more the body of a response
                        out += ["0", "", "", ""] if refers is None else ["", ""]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    chunks = materialize(chunk_table(pages, id_col=id_col, url_col=url_col, html_col=html_col, chunk_chars=chunk_chars), "chunks", compression="zstd")
    rows = chunks.repartition("record").join(_records(chunks, min_revisit_bytes), "record").where("refers_to is null or chunk = 0")
    rows = rows.select("record", "page_id", "url", "chunk", "data", "data_bytes", F.col("whole") | F.col("refers_to").isNotNull(), "whole_body", "whole_digest", "refers_to", "refers_record")
    rows.sortWithinPartitions("record", "chunk").mapInArrow(lines, "value string").write.option("lineSep", LINE).option("compression", "gzip").text(path)


class _Reader:
    """Takes an archive's lines in turn and keeps the rows of ``RECORDS`` of what is complete."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.headers: dict[str, str] = {}
        self.take, self.left = self._version, 0

    def end(self) -> None:
        if self.take != self._version:
            raise ValueError(f"the archive ends inside record {self.headers.get('warc-record-id')}")

    def _wrong(self, why: str) -> ValueError:
        return ValueError(f"record {self.headers.get('warc-record-id')}: {why}")

    def _version(self, line: bytes) -> None:
        if not line.startswith(b"WARC/"):
            raise self._wrong(f"followed by {line[:40]!r}")
        self.headers, self.take = {}, self._header

    def _header(self, line: bytes) -> None:
        if line:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            self.headers[name.strip().lower()] = value.strip()
            return
        self.left, self.size, self.digest = int(self.headers["content-length"]), 0, hashlib.sha1()
        self.take = self._block
        self.part = self._http_head if self.headers.get("content-type", "").startswith("application/http") else self._plain
        self.chunked = False

    def _block(self, line: bytes) -> None:
        """A line of the block: with its line break, unless the block ends before it."""
        broken = self.left > len(line)
        self.left -= len(line) + (len(LINE) if broken else 0)
        if self.left < 0:
            raise self._wrong("longer than stated")
        self.part(line, broken)
        if not broken:
            self._finish()
            self.take = self._blank

    def _blank(self, line: bytes) -> None:
        if line:
            raise self._wrong("longer than stated")
        self.take = self._version

    def _plain(self, line: bytes, broken: bool) -> None:
        for piece in (line, LINE.encode()) if broken else (line,):
            self.size += len(piece)
            self.digest.update(piece)

    def _http_head(self, line: bytes, broken: bool) -> None:
        name, _, value = line.lower().partition(b":")
        self.chunked |= name.strip() == b"transfer-encoding" and value.strip() == b"chunked"
        if not line:
            self.part = self._chunk_size if self.chunked else self._plain

    def _chunk_size(self, line: bytes, broken: bool) -> None:
        if line or broken:
            self.need = int(line.partition(b";")[0], 16)
            self.part = self._chunk_data if self.need else self._trailer

    def _chunk_data(self, line: bytes, broken: bool) -> None:
        inside = self.need > len(line)
        self._plain(line, inside)
        self.need -= len(line) + (len(LINE) if inside else 0)
        if self.need < 0:
            raise self._wrong("a chunk is longer than stated")
        if not inside:
            self.part = self._chunk_size

    def _trailer(self, line: bytes, broken: bool) -> None:
        pass

    def _finish(self) -> None:
        h, kind = self.headers, self.headers.get("warc-type")
        algorithm, _, value = h.get("warc-payload-digest", "").partition(":")
        stated = value.strip() if algorithm.lower() == "sha1" else ""
        if kind != "revisit" and stated and stated != _b32(self.digest):
            raise self._wrong("the payload isn't the one that was digested")
        page = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)(?::\d+)?>", h.get(name, ""))) else None
        self.rows.append((page("warc-record-id"), None if kind == "revisit" else self.size, stated or _b32(self.digest), kind, page("warc-refers-to")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Of every record in the gzipped archives below ``path``: see ``RECORDS``; sizes and digests are of the payloads as read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, archive = _Reader(), None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for name, line in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    if name != archive:
                        reader.end()
                        archive = name
                    reader.take(line)
            yield _columns(reader.rows, RECORDS)
            reader.rows = []
        reader.end()

    text = spark.read.option("lineSep", LINE).text(path).select("_metadata.file_path", F.col("value").cast("binary"))
    found = materialize(bounded_batches(text).mapInArrow(parse, RECORDS), "read")
    # a revisit has no payload of its own: its size is that of the record it refers to
    sizes = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("of_response"))
    return looked_up(found, sizes, ["payload_digest"]).select("page_id", F.coalesce("payload_bytes", "of_response").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
