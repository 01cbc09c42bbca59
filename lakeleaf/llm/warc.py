"""WARC records as a chunked table.

A record is rows of (archive, record_id, chunk_no, chunks, data, prefix_sha1), each with at most
``chunk_bytes`` of its payload; chunk 0 begins with the header block. Joined by (archive, record, chunk
number), ``data`` is a valid WARC/1.1 stream. ``prefix_sha1`` is the payload's digest up to and including the
chunk, so a reader checks every chunk as it goes and never holds a record: it keeps one hash state.

Of payloads that are equal and at least ``revisit_bytes`` long, the record with the largest page_id is a
response and the others are revisits that name it and carry no payload; shorter ones are all responses.

Defined cases: null html is an empty payload; a null page_id is written as id ``null`` and read back as null,
and counts as the smallest; rows that repeat a page_id are separate records of the same id; an empty table
makes no record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeleaf.llm.common import NULL_ID, real_id, written

CHUNK_BYTES = 256 << 10
END = b"\r\n\r\n"
SCHEMA = "archive int, record_id string, chunk_no int, chunks int, data binary, prefix_sha1 string"


def _header(page: int | None, number: str, url: str | None, digest: str, size: int, refers: int | None, kind: str) -> bytes:
    name = "null" if page is None else str(page)
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        f"WARC-Record-ID: <urn:page:{name}:{number}>".encode(),
        b"WARC-Date: 2024-01-01T00:00:00Z",
        b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"WARC-Payload-Length: " + str(size).encode(),
        b"Content-Type: text/html; charset=utf-8",
    ]
    if refers is not None:
        lines += [b"WARC-Refers-To: <urn:page:%d>" % refers, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(b"Content-Length: " + str(0 if kind == "revisit" else size).encode())
    return b"\r\n".join(lines) + END


def record_chunks(head: bytes, payload, chunk_bytes: int) -> Iterator[tuple[int, int, bytes, str]]:
    """(chunk_no, chunks, data, prefix digest) of one record; ``payload`` is any buffer and is not copied whole."""
    view, state = memoryview(payload), hashlib.sha1(usedforsecurity=False)
    n = max(1, -(-len(view) // chunk_bytes))
    for k in range(n):
        part = view[k * chunk_bytes : (k + 1) * chunk_bytes]
        state.update(part)
        yield k, n, b"".join((b"" if k else head, part, END if k == n - 1 else b"")), state.hexdigest()


def pages_with_targets(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """(_id, url, payload, sha1, refers): ``refers`` is the page_id to revisit, null for responses."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("_id"), "url", raw.alias("payload"))
    digests = rows.select("_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n")).where(F.col("n") >= revisit_bytes)
    groups = digests.groupBy("sha1").agg(F.max("_id").alias("top"), F.count("*").alias("k")).where("k > 1").select("sha1", "top")
    # a group of copies may be large: the skew join splits its rows, the group's own side is one row
    # written first, so that its size is known and payloads are only shuffled if it is not small
    revisits = written(digests.join(groups, "sha1").where("_id < top").select("_id", F.col("sha1").alias("copy_of"), F.col("top").alias("refers")).distinct(), "revisits")
    out = rows.withColumn("sha1", F.sha1("payload"))
    return out.join(revisits, (out._id == revisits._id) & (out.sha1 == revisits.copy_of), "left").select(out["_id"], "url", "payload", "sha1", "refers")


def chunk_table(pages: DataFrame, archives: int = 64, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = 1000) -> DataFrame:
    """The chunk rows of all records, in record order within each task."""

    def cut(batches):
        cols = ([], [], [], [], [], [])
        size, number, task = 0, 0, TaskContext.get().partitionId()
        for b in batches:
            ids, urls, payloads, digests, refers = b.columns
            for i in range(b.num_rows):
                page = ids[i].as_py()
                page = None if page == NULL_ID else page
                to = refers[i].as_py()
                body = payloads[i].as_buffer()
                total = body.size if body is not None else 0
                digest = digests[i].as_py()
                number += 1
                unique = f"{task}-{number}"
                head = _header(page, unique, urls[i].as_py(), digest, total, to, "response" if to is None else "revisit")
                name = f"{'null' if page is None else page}:{unique}"
                for k, n, data, prefix in record_chunks(head, b"" if to is not None or not total else body, chunk_bytes):
                    for c, x in zip(cols, (zlib.crc32(name.encode()) % archives, name, k, n, data, prefix)):
                        c.append(x)
                    size += len(data) + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names=NAMES)
                        cols, size = ([], [], [], [], [], []), 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names=NAMES)

    return pages_with_targets(pages, revisit_bytes).mapInArrow(cut, SCHEMA)


NAMES = ["archive", "record_id", "chunk_no", "chunks", "data", "prefix_sha1"]
TYPES = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
READ_SCHEMA = "_id long, record_type string, payload_digest string, payload_bytes long, refers long, read_digest string, read_bytes long, error string"


class RecordReader:
    """Reads one record chunk by chunk with constant memory."""

    def __init__(self, head: bytes, prefix: str | None = None):
        block, _, rest = head.partition(END)
        lines = block.decode("utf-8", "replace").split("\r\n")
        self.version = lines[0]
        self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.left = int(self.fields.get("content-length", "0"))
        self.state = hashlib.sha1(usedforsecurity=False)
        self.bytes, self.error = 0, None if self.version in ("WARC/1.0", "WARC/1.1") else "version"
        self.tail = b""
        self.feed(rest, prefix)

    def feed(self, data: bytes, prefix: str | None) -> None:
        body = data[: self.left]
        self.state.update(body)
        self.bytes += len(body)
        self.left -= len(body)
        self.tail += data[len(body) :]
        if prefix is not None and self.state.hexdigest() != prefix:
            self.error = self.error or "chunk digest"

    def row(self) -> tuple:
        f = self.fields
        digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
        error = self.error or ("truncated" if self.left else "terminator" if self.tail != END else None)
        kind = f.get("warc-type", "")
        if not error and kind == "response" and self.state.hexdigest() != digest:
            error = "payload digest"
        page = f.get("warc-record-id", "").removeprefix("<urn:page:").split(":")[0]
        refers = f.get("warc-refers-to", "").removeprefix("<urn:page:").rstrip(">")
        return (NULL_ID if page == "null" else int(page), kind, digest, int(f.get("warc-payload-length", 0)), int(refers) if refers else None, self.state.hexdigest(), self.bytes, error)


def read_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each record of a chunk table. Records of one chunk are read in place; others are brought together by record."""

    def read(batches):
        rows, now, reader = [], None, None

        def done():
            if reader is not None:
                rows.append(reader.row())

        for b in batches:
            for name, k, data, prefix in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                if name != now:
                    done()
                    now, reader = name, RecordReader(data.as_py(), prefix)
                else:
                    reader.feed(data.as_py(), prefix)
            if len(rows) > 5000:
                yield _rows(rows)
                rows = []
        done()
        if rows:
            yield _rows(rows)

    use = ["record_id", "chunk_no", "data", "prefix_sha1"]
    whole = chunks.where("chunks = 1").select(use)
    parts = chunks.where("chunks > 1").select(use).repartition(F.col("record_id")).sortWithinPartitions("record_id", "chunk_no")
    return whole.mapInArrow(read, READ_SCHEMA).unionByName(parts.mapInArrow(read, READ_SCHEMA))


def _rows(rows):
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in READ_SCHEMA.split(", ")])


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder and read them back: a row for each record.

    A revisit's payload length and digest are those of the record it names; a revisit without it is an error.
    """
    rows = written(read_chunks(written(chunk_table(pages, **options), "warc")), "warc_records")
    whole = rows.where("record_type = 'response'").groupBy(F.col("_id").alias("to"), F.col("read_digest").alias("d")).agg(F.max("read_bytes").alias("n"))
    revisits = rows.where("record_type = 'revisit'")
    found = revisits.join(whole, (F.col("refers") == F.col("to")) & (F.col("payload_digest") == F.col("d")), "left")
    own = rows.where("record_type <> 'revisit'").select("_id", "read_bytes", "read_digest", "record_type", "refers", "error")
    other = found.select("_id", F.col("n").alias("read_bytes"), F.col("d").alias("read_digest"), "record_type", "refers", F.coalesce("error", F.when(F.col("n").isNull(), "unresolved")).alias("error"))
    return own.unionByName(other).select(real_id().alias("page_id"), F.col("read_bytes").alias("payload_bytes"), F.col("read_digest").alias("payload_digest"), "record_type", F.col("refers").alias("refers_to"), "error")


def export_warc(chunks: DataFrame, archive: int, path: str) -> int:
    """Write one archive of a chunk table as a .warc file, chunk by chunk; returns its bytes."""
    size = 0
    ordered = chunks.where(F.col("archive") == archive).orderBy("record_id", "chunk_no").select("data")
    with open(path, "wb") as out:
        for row in ordered.toLocalIterator():
            size += out.write(row.data)
    return size


def read_warc_file(path: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows as ``read_chunks`` gives them, from a .warc file, holding at most one chunk."""
    with open(path, "rb") as f:
        while True:
            head = b""
            while line := f.readline(65536):
                head += line
                if head.endswith(END):
                    break
            if not head:
                return
            reader = RecordReader(head)
            while reader.left:
                data = f.read(min(chunk_bytes, reader.left))
                if not data:
                    break
                reader.feed(data, None)
            reader.feed(f.read(4), None)
            yield reader.row()
            if reader.row()[-1]:
                return


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
