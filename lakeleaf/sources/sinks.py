"""Writers: containers, index lines, receipts, exports, streaming segments.

Tables go through Spark's own committers. Containers, indexes and exported folders are byte formats without a Spark writer:
tasks write them straight to the target (a path or address that all executors reach), each file under a name of its own that is moved
into place when it is whole, so a task that runs again or twice leaves the same files. Only a ZIP file has one writer, the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zipfile
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeleaf.operators.archive import CDX_HEADER, cdx_lines, deduplicated, export_paths
from lakeleaf.operators.tables import kept

DROPPED = ("content-encoding", "transfer-encoding", "content-length")


def record_bytes(row: dict) -> bytes:
    """One response or revisit record of a captured resource (seq, url, ts, status, headers, body, digest, refers_to, refers_uri)."""
    fixed = [(k, v) for k, v in (row["headers"] or {}).items() if k.lower() not in DROPPED]
    http_head = "".join(f"{k}: {v}\r\n" for k, v in [*fixed, ("Content-Length", len(row["body"]))])
    payload = f"HTTP/1.1 {row['status']} Response\r\n{http_head}\r\n".encode()
    fields = [("WARC-Type", "revisit" if row["is_revisit"] else "response"), ("WARC-Target-URI", row["url"]), ("WARC-Date", row["ts"]), ("WARC-Record-ID", f"<urn:record:{row['seq']}>")]
    if row["is_revisit"]:
        fields += [("WARC-Refers-To", f"<urn:record:{row['refers_to']}>"), ("WARC-Refers-To-Target-URI", row["refers_uri"]), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    else:
        payload += row["body"]
    fields += [("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(payload))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + payload + b"\r\n\r\n"


def container_rows(resources: DataFrame, dedup: bool = True) -> DataFrame:
    """(file, seq, url, ts, mime, status, digest, is_revisit, length, data) from resources (file, seq, url, ts string, status, mime, headers, body)."""
    rows = deduplicated(resources, dedup=dedup)
    origin = resources.select(F.col("seq").alias("refers_to"), F.col("url").alias("refers_uri"))
    rows = rows.join(origin, "refers_to", "left")
    schema = "file string, seq long, url string, ts string, mime string, status int, digest string, is_revisit boolean, length long, data binary"
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches):
        for b in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            out = []
            for row in b.to_pylist():
                row["headers"] = dict(row["headers"] or [])
                data = record_bytes(row)
                out.append({**{n: row.get(n) for n in arrow.names}, "length": len(data), "data": data})
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.select("file", "seq", "url", "ts", "mime", "status", "digest", "is_revisit", "headers", "body", "refers_to", "refers_uri").mapInArrow(run, schema)


def _target(folder: str):
    """(file system, path below it) of a folder given as a path or an address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))


def _put(store, path: str, pieces) -> int:
    """Write a whole file under a name of its own, then move it into place; returns its size."""
    part, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with store.open_output_stream(part, compression=None) as out:
        for data in pieces:
            out.write(data)
            size += len(data)
    store.move(part, path)
    return size


def _laid_down(rows: DataFrame, folder: str, head: bytes = b"") -> list[str]:
    """Files from rows (file, seq, data): each by one task, in the order of seq, streaming; returns their names (a row a file reaches the driver)."""

    def run(batches):
        store, base = _target(folder)
        store.create_dir(base, recursive=True)
        stream = ((f, d) for b in batches for f, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for name, mine in groupby(stream, lambda r: r[0]):
            size = _put(store, f"{base}/{name}", chain([head] if head else [], (d for _, d in mine)))
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size]})

    ordered = rows.repartition("file").sortWithinPartitions("file", "seq").select("file", "data")
    return sorted(r.file for r in ordered.mapInArrow(run, "file string, bytes long").collect())


def write_containers(rows: DataFrame, folder: str) -> list[str]:
    """Lay container rows down as files with their index beside them; returns the paths of the containers."""
    names = _laid_down(rows.select("file", "seq", "data"), folder)
    index = cdx_lines(rows.withColumn("ts", F.to_timestamp("ts")))
    lines = index.select(F.replace("file", F.lit(".warc"), F.lit(".cdx")).alias("file"), "seq", F.concat("line", F.lit("\n")).cast("binary").alias("data"))
    _laid_down(lines, folder, (CDX_HEADER + "\n").encode())
    return [os.path.join(folder, n) for n in names]


def receipt(outcomes: DataFrame, limitations: list[dict], archives: dict) -> str:
    """Coverage receipt of an outcome table as JSON; counts come from one aggregate."""
    from lakeleaf.operators.reports import STATES

    row = outcomes.agg(F.count("*").alias("n"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES]).first()
    counts = {s: row[s] for s in STATES}
    return json.dumps({"schema_version": 1, "discovered": row.n, "counts": counts, "complete": row.n > 0 and counts["captured"] == row.n and not limitations, "limitations": limitations, "archives": archives}, sort_keys=True)


def export_directory(records: DataFrame, folder: str, by_host: bool = False) -> list[dict]:
    """Write (url, payload) rows below a folder by safe path; two addresses on one path raise unless hosts tell them apart. The manifest, in order of
    address, is made of what the tasks wrote."""
    rows = export_paths(records, by_host).select("url", "payload", "path")
    bad = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("url").alias("url")).where("path is null or n > 1").orderBy("url").first()
    if bad:
        raise ValueError(f"unsafe path of {bad.url}" if bad.path is None else f"two resources at {bad.path}")

    def run(batches):
        store, base = _target(folder)
        for b in batches:
            out = []
            for url, payload, path in zip(*(c.to_pylist() for c in b.columns)):
                target = f"{base}/{path}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                out.append({"url": url, "path": path, "sha256": hashlib.sha256(payload).hexdigest(), "bytes": _put(store, target, [payload])})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("url", pa.string()), ("path", pa.string()), ("sha256", pa.string()), ("bytes", pa.int64())]))

    written = kept(rows.mapInArrow(run, "url string, path string, sha256 string, bytes long"), "exported")
    manifest = [r.asDict() for r in written.orderBy("url").toLocalIterator()]
    store, base = _target(folder)
    store.create_dir(base, recursive=True)
    _put(store, f"{base}/manifest.json", [(json.dumps(manifest, sort_keys=True, indent=2) + "\n").encode()])
    return manifest


def export_zip(records: DataFrame, path: str, by_host: bool = False) -> int:
    """The same as a ZIP file with fixed times and sorted members; equal inputs give equal bytes."""
    members = {}
    for r in export_paths(records, by_host).orderBy("url").select("url", "payload", "path").toLocalIterator():
        if r.path is None or r.path in members:
            raise ValueError(f"unsafe or repeated path of {r.url}")
        members[r.path] = bytes(r.payload)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(members):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, members[name])
    return len(members)


def idempotent_batches(path: str):
    """A foreachBatch writer: each batch replaces its own folder, so a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def failure_report(outcomes: DataFrame, cause: str) -> DataFrame:
    """Counts by state of a capture that died, with the cause's class."""
    from lakeleaf.functions.http import error_class

    return outcomes.groupBy("state").agg(F.count("*").alias("n")).withColumn("cause", error_class(F.lit(cause)))
