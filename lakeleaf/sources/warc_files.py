"""WARC containers as rows, from Spark's binary file source (any file system), one container a row, or from their consecutive parts.

A container is scanned in order; the first bad record ends its scan with one row whose ``error`` says why. Plain
files and multi-member gzip are read; record offsets count in the uncompressed stream.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import tempfile
import zlib
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, offset long, length long, version string, type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, refers_uri string, status int, mime string, headers map<string,string>, block binary, payload_ok boolean, error string"
ENDS = b"\r\n\r\n"
#: Most rows and bytes of a batch that a scan makes; most bytes of a compressed container that wait in memory.
ROWS, PIECE, SPOOL = 256, 1 << 20, 4 << 20


class Unreadable(Exception):
    """A compressed container, of so many bytes, that can't be unpacked to its end."""


def header_fields(block: bytes) -> dict[str, str]:
    """Names in lower case, values trimmed; the last of equal names stays."""
    pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n") if ":" in line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class Feed:
    """The bytes of consecutive pieces, as far as they are read and not dropped yet."""

    def __init__(self, pieces):
        self.pieces, self.held = iter(pieces), bytearray()

    def grows(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.held += piece
        return piece is not None

    def reaches(self, size: int) -> bool:
        while len(self.held) < size and self.grows():
            pass
        return len(self.held) >= size

    def find(self, what: bytes) -> int:
        at = lo = 0
        while (at := self.held.find(what, lo)) < 0:
            lo = max(0, len(self.held) - len(what) + 1)
            if not self.grows():
                return -1
        return at

    def rest(self) -> int:
        """How many bytes there still are; they are read and dropped."""
        return len(self.held) + sum(map(len, self.pieces))


def records(pieces):
    """(offset, length, version, headers, block, error) of every record of a container's consecutive pieces, then the error that stopped the scan, if any."""
    feed, at = Feed(pieces), 0
    while feed.reaches(1):
        stop = feed.find(ENDS)
        if stop < 0:
            yield at, feed.rest(), None, {}, None, "incomplete header"
            return
        head = bytes(feed.held[:stop])
        fields = header_fields(head)
        version = head.partition(b"\r\n")[0].decode("latin-1")
        size = fields.get("content-length", "")
        if version not in ("WARC/1.0", "WARC/1.1") or not re.fullmatch(r"[0-9]{1,18}", size):
            yield at, feed.rest(), version, fields, None, "bad version or length"
            return
        begin = stop + len(ENDS)
        end = begin + int(size)
        if not feed.reaches(end + len(ENDS)) or feed.held[end : end + len(ENDS)] != ENDS:
            yield at, feed.rest(), version, fields, None, "truncated or unterminated"
            return
        after = end
        while feed.reaches(after + 1) and feed.held[after] in b"\r\n":
            after += 1
        block = bytes(feed.held[begin:end])
        del feed.held[:after]
        yield at, after, version, fields, block, None
        at += after


def plain(name: str, pieces):
    """The pieces of a container's plain bytes. A compressed one waits in a local file until all of it is found readable."""
    if not name.endswith(".gz"):
        yield from pieces
        return
    with tempfile.SpooledTemporaryFile(SPOOL) as file:
        for piece in pieces:
            file.write(piece)
        size = file.tell()
        for last in (False, True):
            file.seek(0)
            try:
                with gzip.GzipFile(fileobj=file, mode="rb") as out:
                    while piece := out.read(PIECE):
                        if last:
                            yield piece
            except (OSError, EOFError, zlib.error) as why:
                raise Unreadable(size) from why


def rows_of(name: str, pieces):
    """Rows of a container's consecutive pieces, one at a time."""
    none = True
    try:
        for offset, length, version, h, block, error in records(plain(name, pieces)):
            none = False
            status = mime = ok = None
            kind = h.get("warc-type", "unknown")
            if block is not None and kind in ("response", "revisit"):
                head, found, payload = block.partition(ENDS)
                line = re.search(r"HTTP/\S+\s+(\d+)", head.decode("utf-8", "replace").split("\r\n")[0])
                status = int(line[1]) if line else 200
                mime = header_fields(head).get("content-type", "application/octet-stream").partition(";")[0].strip().lower()
                digest = h.get("warc-payload-digest", "")
                ok = bool(found) and (not digest.startswith("sha256:") or hashlib.sha256(payload).hexdigest() == digest[7:])
            yield {
                "file": name, "offset": offset, "length": length, "version": version, "type": kind, "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"),
                "date": h.get("warc-date"), "payload_digest": h.get("warc-payload-digest"), "refers_to": h.get("warc-refers-to"), "refers_uri": h.get("warc-refers-to-target-uri"),
                "status": status, "mime": mime, "headers": h, "block": block, "payload_ok": ok, "error": error,
            }
    except Unreadable as why:
        yield {"file": name, "offset": 0, "length": why.args[0], "error": "unreadable container"}
        return
    if none:
        yield {"file": name, "offset": 0, "length": 0, "error": "empty container"}


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])


def zipped(containers: DataFrame) -> DataFrame:
    """Containers of (path, part, content) rows, each part compressed as a member of its own."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                c = b.slice(lo, ROWS)
                data = pa.array([gzip.compress(x.as_py(), mtime=0) for x in c.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), data], names=["path", "part", "content"])

    return containers.select(F.concat("path", F.lit(".gz")).alias("path"), "part", "content").mapInArrow(run, "path string, part long, content binary")


def parsed(containers: DataFrame) -> DataFrame:
    """Record rows of (path, content) rows, a container each, or of (path, part, content) rows, of which those of a path are one container in the order of
    ``part``. Parts go through a scan one by one, so a task holds a record and not its container."""
    parts = "part" in containers.columns

    def run(batches):
        schema = _arrow_schema()
        stream = ((f, c) for b in batches for f, c in zip(b.column(0), b.column(1)))
        found = (r for k, g in groupby(enumerate(stream), lambda x: x[1][0].as_py() if parts else x[0]) for r in container(g))
        rows, size = [], 0
        for r in found:
            rows.append({n: list(r[n].items()) if n == "headers" and r.get(n) is not None else r.get(n) for n in schema.names})
            size += len(r.get("block") or b"")
            if len(rows) == ROWS or size >= PIECE:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def container(group):
        _, (name, first) = next(group)
        return rows_of(name.as_py().rsplit("/", 1)[-1], chain([first.as_py()], (c.as_py() for _, (_, c) in group)))

    if not parts:
        return containers.select("path", "content").mapInArrow(run, SCHEMA)
    ordered = containers.repartition("path").sortWithinPartitions("path", "part", "content")
    return ordered.select("path", "content").mapInArrow(run, SCHEMA)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Records of all containers under a path."""
    return parsed(inputs(spark, path).where(F.col("path").rlike(r"(?i)\.warc(\.gz)?$")))


def inputs(spark: SparkSession, path: str) -> DataFrame:
    """Archive files under a path: names by suffix, no ``._`` side files; content is read only where a query asks for it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.where(name.rlike(r"(?i)\.(warc|warc\.gz|wacz|cdx|cdxj)$") & ~F.startswith(name, F.lit("._"))).orderBy("path")
