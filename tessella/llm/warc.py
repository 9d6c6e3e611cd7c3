"""WARC archives through Spark's own text files, and their chunked record table.

Writing: a payload of more than `chunk` bytes becomes a segmented record, as
WARC/1.1 has it: a first segment and continuation records of at most `chunk`
bytes each. Every segment is one row of Spark's text writer, which ends it with
the last line feed of its trailer, so the files are plain gzipped WARC. Reading:
Spark's text reader streams lines to a parser, which hands out rows (record,
chunk number, bytes of the chunk, size and digest so far). The digest is carried
from segment to segment. Neither side builds a record in one piece: the writer
cuts segments from the payload's Arrow buffer without copying the whole, and
hands them on in batches bounded by bytes. Spark's readers and writers reach any
file system; Spark compresses a file as a whole, so there is no member per record.

Of records with equal payloads of at least `least` bytes, the one with the
smallest id is a response, the others are revisits that refer to it and carry no
payload, only its digest and length.

A null payload is empty. A null id is written as "null" and read back as null;
it is never referred to, so of equal payloads without any id all are responses.
Repeated ids with equal payloads are records of their
own; each revisit refers to the smallest id, and repeats of that id are responses
too. An empty table gives no records. Payloads may hold any text, WARC headers
and blank lines included, since lengths, not marks, end a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import materialise, shared_dir

CHUNK = 1 << 20
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINES = "value string"
FLUSH = 4 << 20  # bytes of segments that a batch of either side gathers
_CHUNKS = "id long, record_type string, refers_to long, chunk int, bytes long, size_so_far long, digest_so_far string, stated_digest string, stated_size long, last boolean, data binary"


def classified(pages: DataFrame, key: str, payload: str, least: int = 0, uri: str = "url") -> DataFrame:
    """pages with id, uri (null where pages have no such column), payload, digest (hex SHA-1), size and first, the response's id. Digests are compared, not payloads."""
    address = F.col(uri).cast("string") if uri in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(key).cast("long").alias("id"), address.alias("uri"), F.coalesce(payload, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload").cast("long"))
    # only short rows meet: the join's result is written, then joined to nothing else
    first = materialise(rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return rows.join(first, "digest", "left")


def _segments(data: memoryview, size: int) -> Iterator[bytes]:
    """Pieces of at most size bytes (4 at least) that end between characters; one empty piece of nothing."""
    at = 0
    while True:
        end = min(len(data), at + max(size, 4))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield bytes(data[at:end])
        at = end
        if at == len(data):
            return


def _name(id_: int | None, segment: int = 1) -> str:
    return f"<urn:page:{'null' if id_ is None else id_}{f':{segment}' if segment > 1 else ''}>"


def _records(id_: int | None, uri: str | None, data: memoryview, digest: str, first: int | None, size: int) -> Iterator[str]:
    """The text of each segment of a record, without its last line feed."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "") or _name(id_)[1:-1]
    about = f"WARC-Target-URI: {target}\r\n"
    stated = f"{about}WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}\r\nWARC-Payload-Length: {len(data)}\r\n"
    if first is not None and first != id_:
        yield _record("revisit", _name(id_), f"WARC-Refers-To: {_name(first)}\r\nWARC-Profile: {_PROFILE}\r\n{stated}", b"")
        return
    head, at = (_HTTP % len(data)).encode(), 0
    segmented = len(data) > size
    for i, piece in enumerate(_segments(data, size)):
        at += len(piece)
        more = f"WARC-Segment-Number: {i + 1}\r\n" if segmented else ""
        if i == 0:
            yield _record("response", _name(id_), stated + more, head + piece)
        else:
            total = f"WARC-Segment-Total-Length: {len(head) + len(data)}\r\n" if at == len(data) else ""
            yield _record("continuation", _name(id_, i + 1), f"{about}WARC-Segment-Origin-ID: {_name(id_)}\r\n{more}{total}", piece)


def _record(kind: str, name: str, more: str, block: bytes) -> str:
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return f"{head}{block.decode()}\r\n\r"


def write(rows: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Write classified rows as gzipped WARC files, one for each partition."""
    target = to_arrow_schema(StructType.fromDDL(_LINES))

    def run(batches):
        lines, held = [], 0
        for batch in batches:
            ids, uris, digests, firsts = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "uri", "digest", "first"))
            payloads = batch.column(batch.schema.get_field_index("payload"))
            for k in range(batch.num_rows):
                data = memoryview(payloads[k].as_buffer())
                for line in _records(ids[k].as_py(), uris[k].as_py(), data, digests[k].as_py(), firsts[k].as_py(), chunk):
                    lines.append(line)
                    held += len(line)
                    if held > FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], schema=target)
                        lines, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], schema=target)

    chosen = rows.select("id", "uri", "payload", "digest", "first")
    chosen.mapInArrow(run, _LINES).write.option("lineSep", "\n").option("compression", "gzip").text(path)


class Parser:
    """A WARC stream, fed by lines; gives a row of the chunk table for each segment."""

    def __init__(self, with_data: bool):
        self.with_data = with_data
        self.head: dict[str, str] | None = None
        self.origin: dict[str, str] = {}
        self.left = 0  # bytes of the block still to come
        self.reading = self.http = False

    def feed(self, line: bytes) -> Iterator[tuple]:
        """line ends with its line feed."""
        if self.reading:
            data = line[: self.left]
            self.left -= len(data)
            if self.http:
                self.http = data.strip() != b""
            else:
                self.sha.update(data)
                self.held += len(data)
                if self.with_data:
                    self.parts.append(data)
        else:
            text = line.rstrip(b"\r\n").decode()
            if self.head is None:
                if text.startswith("WARC/"):
                    self.head = {}
                elif text:
                    raise ValueError(f"not a record: {text[:60]!r}")
                return
            if text:
                name, _, value = text.partition(":")
                self.head[name.lower()] = value.strip()
                return
            self.begin()
        if self.left == 0:
            yield self.row()
            self.head, self.reading = None, False

    def begin(self) -> None:
        self.left = int(self.head["content-length"])
        self.reading, self.parts, self.held = True, [], 0
        if self.head["warc-type"] == "continuation":
            if self.head["warc-segment-origin-id"] != self.origin.get("warc-record-id"):
                raise ValueError("a continuation without its origin")
            self.chunk += 1
        else:
            self.origin, self.http = self.head, self.left > 0
            self.sha, self.size, self.chunk = hashlib.sha1(), 0, 0

    def row(self) -> tuple:
        h = self.origin
        self.size += self.held
        page = lambda name: int(h[name].split(":")[2].rstrip(">")) if name in h and "null" not in h[name] else None
        so_far = base64.b32encode(self.sha.digest()).decode()
        stated, length = h["warc-payload-digest"].removeprefix("sha1:"), int(h["warc-payload-length"])
        revisit = h["warc-type"] == "revisit"
        last = revisit or self.size >= length
        if last and not revisit and so_far != stated:
            raise ValueError(f"record {h['warc-record-id']}: digest {so_far}, stated {stated}")
        data = b"".join(self.parts) if self.with_data else None
        return (page("warc-record-id"), h["warc-type"], page("warc-refers-to"), self.chunk, self.held, self.size, so_far, stated, length, last, data)


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunked record table of the WARC files in path.

    One row for each (id, chunk): type, referred record, bytes, and size and
    digest of the payload up to and with this chunk; `last` marks the final one.
    """
    target = to_arrow_schema(StructType.fromDDL(_CHUNKS))

    def run(batches):
        parser, rows, held = Parser(with_data), [], 0
        for batch in batches:
            for line in batch.column(0).to_pylist():
                for row in parser.feed(line.encode() + b"\n"):
                    rows.append(row)
                    held += row[4] + 200
                    if held > FLUSH:
                        yield _batch(rows, target)
                        rows, held = [], 0
        if parser.head is not None:
            raise ValueError("an archive ends inside a record")
        yield _batch(rows, target)

    return spark.read.option("lineSep", "\n").text(path).mapInArrow(run, _CHUNKS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write pages as archives, read them back; per record page_id, payload_bytes, payload_digest, record_type, refers_to, n_chunks."""
    spark = pages.sparkSession
    path = shared_dir(spark)
    write(classified(pages, key, payload, least), path, chunk)
    last = read_chunks(spark, path, False).where("last")
    return last.select(
        F.col("id").alias(key), F.col("stated_size").alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to",
        (F.col("chunk") + 1).alias("n_chunks"),
    )
