"""Super-strings: runs of consecutive windows that share a minimiser travel as one packed string to its bucket.

Every occurrence of a window has the same minimiser, so all of them meet in one bucket, whatever surrounds
them. Within a map task equal strings travel once; only what cannot be decided there goes on. Strings of a
bucket are packed and compressed together, a few megabytes at a time, against a dictionary of sampled text.

Grams that would draw more than a set share of all text to one bucket rank after all others as minimisers, so a
window takes one only if it has no rarer gram. They are found on a sample by hash of the rows; which they are
decides where windows meet, never what is found, because all tasks rank alike.

A row is its doc_id and a 64-bit hash of its text; rows equal in both lose the same parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeleaf.llm.common import byte_slices, dropped, keyed, shuffle_partitions, written

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
CHUNK = 1 << 20
FLUSH = 20 << 20
#: Bytes that a gathered span counts for.
SPAN = 100
OUT = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])
#: Kinds of blobs: strings to be judged, and spans that are decided already.
STRINGS, SPANS = 0, 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64; ``range_hashes`` takes hashes of any byte range from them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) or 1)[0][: len(data)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sliding(x: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """best of x[i : i + width] for each i; shorter than x by width - 1."""
    have = 1
    while 2 * have <= width:
        x = best(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return best(x[: len(x) - rest], x[rest:]) if rest else x


@dataclass
class Packer:
    """Gathers strings and decided spans of one map task and yields compressed blobs by bucket."""

    buckets: np.ndarray  # their labels
    keep_all_of_least: bool  # True: keep every place of the smallest doc_id; False: keep one place and a repeat mark
    dictionary: bytes = b""
    key_bits: int = 12  # of a string's key that travel; strings of other keys that agree in them are judged together
    strings: dict = field(default_factory=dict)
    spans: list = field(default_factory=list)
    size: int = 0
    turn: int = 0

    def add(self, key: int, text: bytes, doc: int, h: int, pos: int, units: int, mark: int = 0) -> None:
        got = self.strings.get(text)
        if got is None:
            self.strings[text] = [key, mark, units, doc, h, [pos]]
            self.size += len(text) + 150
        elif not self.keep_all_of_least:
            got[1] |= 2
            self.spans.append((doc, h, pos, pos + units))
            self.size += SPAN
        elif doc == got[3]:
            if h == got[4]:
                got[5].append(pos)
                self.size += SPAN
            else:  # another row with the same doc_id
                self.size += 2 * SPAN
                self.strings.setdefault((text, h), [key, mark, units, doc, h, []])[5].append(pos)
        elif doc > got[3]:
            self.spans.append((doc, h, pos, pos + units))
            self.size += SPAN
        else:
            self.spans += [(got[3], got[4], p, p + units) for p in got[5]]
            self.size += SPAN * len(got[5])
            got[3:] = [doc, h, [pos]]

    def flush(self) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        n, labels, press, kept = len(self.buckets), self.buckets.tolist(), compressor(self.dictionary), (1 << self.key_bits) - 1
        for text, (key, mark, units, doc, h, places) in self.strings.items():
            if isinstance(text, tuple):
                text = text[0]
            for p in places:
                by.setdefault(key % n, []).append((key // n & kept, mark, units, doc, h, p, text))
        rows = [(labels[b], STRINGS, pack_strings(x, press)) for b, x in by.items()]
        for lo in range(0, len(self.spans), 50_000):
            self.turn += 1
            rows.append((labels[int(mixed(np.array([self.spans[lo][0] + self.turn], np.int64).view(np.uint64))[0] % np.uint64(n))], SPANS, pack_spans(self.spans[lo : lo + 50_000])))
        self.strings, self.spans, self.size = {}, [], 0
        for lo in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 256]), OUT.types)], schema=OUT)


COLUMNS = (np.uint32, np.uint8, np.int32, np.int64, np.int64, np.int64, np.int32)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=6)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=6)
    return zstandard.ZstdCompressor(level=6, dict_data=data)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None)


def pack_strings(entries: list, press: zstandard.ZstdCompressor) -> bytes:
    """(key class, mark, units, doc, h, pos, string) of each entry; numbers by byte plane, doc as differences, for the compressor's sake."""
    *cols, texts = zip(*entries)
    cols = [np.array(c, t) for c, t in zip((*cols, [len(x) for x in texts]), COLUMNS)]
    cols[3] = np.diff(cols[3], prepend=0)
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(texts), -1).T).tobytes() for c in cols]
    return press.compress(b"".join((np.array([len(texts)], np.int64).tobytes(), *planes, *texts)))


def unpack_strings(blob: bytes, expand: zstandard.ZstdDecompressor):
    """[key class, mark, units, doc, h, pos] arrays and the list of strings."""
    raw = expand.decompress(blob)
    n, at, cols = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for t in COLUMNS:
        width = np.dtype(t).itemsize
        cols.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(t).ravel())
        at += n * width
    cols[3] = np.cumsum(cols[3])
    ends = (at + np.cumsum(cols.pop())).tolist()
    return cols, [raw[a:b] for a, b in zip([at, *ends], ends)]


def pack_spans(spans: list) -> bytes:
    doc, h, start, end = zip(*spans)
    parts = [np.array([len(spans)], np.int64), np.array(doc, np.int64), np.array(start, np.int64), np.array(end, np.int64), np.array(h, np.int64)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts))


def unpack_spans(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    doc, start, end = (np.frombuffer(raw, np.int64, n, 8 + 8 * n * k) for k in range(3))
    return [doc, np.frombuffer(raw, np.int64, n, 8 + 24 * n), start, end]


SPAN_SCHEMA = "_id long, _h long, start long, end long"


class Ranking:
    """Rank of grams as minimisers: their hash, the common ones after all others."""

    def __init__(self, common: np.ndarray):
        self.common = np.sort(common.astype(np.uint32))

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        out = grams >> np.uint32(1)
        if len(self.common):
            at = np.searchsorted(self.common, grams)
            out |= (self.common[np.minimum(at, len(self.common) - 1)] == grams).astype(np.uint32) << np.uint32(31)
        return out


def ranking(docs: DataFrame, split: Callable, target: int = 32 << 20) -> tuple[Ranking, bytes]:
    """The ranking, and at most 128 KB of sampled text for compression. Finds the grams that more than a share of the sampled text has as minimiser; the share is that of ``target`` bytes, from ``2**-20`` to
    ``2**-10``, which also bounds how many grams there are. The sample is of ``4096 / share`` bytes, about."""
    rows = keyed(docs)
    total = rows.agg(F.sum(F.octet_length("_text")).alias("n")).first().n or 0
    share = min(max(target / max(total, 1), 2**-20), 2**-10)
    every = max(1, int(total * share / 4096))

    def count(batches):
        for b in batches:
            data, at = byte_slices(b.column(0))
            lo = 0
            while lo < b.num_rows:
                hi = int(max(np.searchsorted(at, at[lo] + CHUNK, "right") - 1, lo + 1))
                found = [(k, len(t)) for _, _, _, k, t, _ in split(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], None)]
                if found:
                    key, size = np.array(found, np.int64).T
                    some, where = np.unique(key, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.bincount(where, size).astype(np.int64))], names=["gram", "n"])
                lo = hi

    sample = rows.where(F.pmod(F.xxhash64("_id", "_h"), F.lit(every)) == 0).select("_text")
    sums = sample.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    sums = written(sums, "grams")
    least = share * (sums.agg(F.sum("n").alias("n")).first().n or 0)
    got = sums.where(F.col("n") > max(least, 4096)).select("gram").toArrow()["gram"].to_numpy()  # at most 1 / share
    dropped(sums)
    some = sample.where("_text <> ''").select(F.substring("_text", 1, 1024).alias("t")).limit(128).collect()
    return Ranking(got), " ".join(r.t for r in some).encode()[: 128 << 10]


def bucket_labels(spark, partitions: int, each: int = 16) -> np.ndarray:
    """Numbers that Spark's hash partitioning deals evenly: ``each`` for each partition."""
    found: dict[int, list[int]] = {}
    n = 4 * each * partitions
    while len(found) < partitions or min(map(len, found.values())) < each:
        some = spark.range(n).select(F.col("id").cast("int").alias("label")).select("label", F.pmod(F.hash("label"), F.lit(partitions)).alias("part")).toArrow()
        found = {}
        for label, part in zip(some["label"].to_pylist(), some["part"].to_pylist()):
            if len(mine := found.setdefault(part, [])) < each:
                mine.append(label)
        n *= 2
    return np.array([x[k] for k in range(each) for _, x in sorted(found.items())], np.int32)


def repeated_spans(docs: DataFrame, split: Callable, judge: Callable, keep_all_of_least: bool, key_bits: int = 12) -> DataFrame:
    """(_id, _h, start, end): spans of repeated windows.

    split(data, offsets, rank) yields (document number, start, units, key, string, mark), key being the hash of the
    minimiser (under ``rank`` its rank); judge(blobs, expand) yields span arrays for the packed strings of one bucket.
    ``key_bits``: how much of the key goes with a string; fewer make larger groups to be judged, never other spans.
    """
    buckets = bucket_labels(docs.sparkSession, shuffle_partitions(docs.sparkSession))
    rank, dictionary = ranking(docs, split)

    def cut(batches):
        packer = Packer(buckets, keep_all_of_least, dictionary, key_bits)
        for b in batches:
            ids, hs = b.column(0).to_pylist(), b.column(1).to_pylist()
            data, at = byte_slices(b.column(2))
            lo = 0
            while lo < len(ids):
                hi = int(max(np.searchsorted(at, at[lo] + CHUNK, "right") - 1, lo + 1))
                for i, pos, units, key, text, mark in split(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], rank):
                    packer.add(key, text, ids[lo + i], hs[lo + i], pos, units, mark)
                lo = hi
                if packer.size > FLUSH:
                    yield from packer.flush()
        yield from packer.flush()

    def judged(batches):
        def out(spans):
            doc, h, start, end = (np.concatenate(x) for x in zip(*spans))
            for lo in range(0, len(doc), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 20_000]) for x in (doc, h, start, end)], names=["_id", "_h", "start", "end"])

        now, blobs, ready, expand = None, [], [], decompressor(dictionary)
        for b in batches:
            for bucket, kind, blob in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now:
                    if blobs:
                        ready += judge(blobs, expand)
                    now, blobs = bucket, []
                if kind == SPANS:
                    ready.append(unpack_spans(blob))
                else:
                    blobs.append(blob)
                if len(ready) > 200:
                    yield from out(ready)
                    ready = []
        if blobs:
            ready += judge(blobs, expand)
        if ready:
            yield from out(ready)

    packed = keyed(docs).mapInArrow(cut, "bucket int, kind byte, blob binary")
    return packed.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(judged, SPAN_SCHEMA)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its spans: (_id, _text, starts, ends), starts and ends null where there are none."""
    per_doc = spans.groupBy("_id", "_h").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    per_doc = per_doc.select("_id", "_h", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    return keyed(docs).join(per_doc, ["_id", "_h"], "left").select("_id", "_text", "starts", "ends")


def covered(n: int, starts, ends) -> np.ndarray:
    """Which of n units the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    if len(starts):
        np.add.at(edge, np.asarray(starts), 1)
        np.add.at(edge, np.asarray(ends), -1)
    return np.cumsum(edge[:n]) > 0
