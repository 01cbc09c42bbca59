"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits are cut into ``links // 2 + 1`` segments, so that of two fingerprints with at most
``links`` differing bits one segment differs by at most one. Each segment is indexed once per bit with that
bit wiped; equal keys are joined and verified, and a pair is reported only at the first key that it shares.

Keys are refined one by one, so that candidate pairs grow with the fingerprints and not with their square:
a key that more than ``hot`` fingerprints share is extended by pieces of the other bits (``links + 1`` pieces,
one of which two linked fingerprints have in common). An extended key that is still shared by more than ``hot``
takes an exact linear way: all variants within ``links // 2`` flipped bits; two fingerprints link exactly if
they share such a variant or pass through one, and all that share one are within ``links`` bits.

Defined cases: null or empty text has no word, fingerprint zero, linked like any other; fewer words than a
shingle make one shingle of all words; rows that repeat a doc_id are one document, so all their fingerprints
are linked; rows of null doc_id are documents of their own, linked by their fingerprints alone, and a component
of such rows only has a null component_id; an empty table gives no row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeleaf.llm.common import connected_components, dropped, written

BITS = 64


def fingerprint_of(text: bytes, words_in: int = 4, seed: int = 42) -> int:
    """The SimHash of UTF-8 text: A-Z lower-cased, words cut at ASCII blanks, repeated shingles counted."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= words_in:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), len(words) - words_in + 1
    step = 65536
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[lo:hi].tolist(), (ends[lo + words_in - 1 : hi + words_in - 1] - 1).tolist())), np.uint64, hi - lo)
        # bytes of four rows are spread over 64-bit lanes, so a block of 255 rows is summed without overflow
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 252 * 252
        if whole:
            lanes = bits[:whole].view(np.uint64).reshape(-1, 252, 8).sum(axis=1, dtype=np.uint64)
            counts += lanes.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_in: int = 4, seed: int = 42) -> DataFrame:
    """(_id, _h, fp): doc_id, a hash of the text and a signed 64-bit fingerprint for each row."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint_of(t.as_buffer().to_pybytes() if t.is_valid else b"", words_in, seed) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["_id", "_h", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h"), "text")
    return rows.mapInArrow(run, "_id long, _h long, fp long")


def segments(links: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    n = links // 2 + 1
    edges = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _index(fps: DataFrame, links: int) -> DataFrame:
    """(fp, place, key, rest): one row for each segment and wiped bit; key packs the place and the segment without that bit, rest holds the other segments' bits.

    Written over one sequence of bit numbers, so that the plan stays short whatever the number of places.
    """
    parts = segments(links)

    def pick(i, values: list):
        out = values[-1] if not isinstance(values[-1], int) else F.lit(values[-1])
        for (first, width), v in reversed(list(zip(parts[:-1], values[:-1]))):
            out = F.when(i < first + width, v if not isinstance(v, int) else F.lit(v)).otherwise(out)
        return out

    bits = F.explode(F.sequence(F.lit(0), F.lit(BITS - 1)))
    rows = fps.select("fp", bits.alias("i"))
    i = F.col("i")
    first = pick(i, [f for f, _ in parts])
    mask = pick(i, [(1 << w) - 1 for _, w in parts]).cast("long")
    place = pick(i, [s << 6 for s in range(len(parts))]) + i - first
    low = lambda f: F.col("fp").bitwiseAND(F.lit((1 << f) - 1))
    others = [low(f) if f + w == BITS else F.shiftleft(F.shiftrightunsigned("fp", f + w), f).bitwiseOR(low(f)) for f, w in parts]
    rows = rows.select("fp", "i", place.alias("place"), first.alias("first"), mask.alias("mask"), pick(i, others).alias("rest"))
    key = F.expr("shiftleft(shiftrightunsigned(fp, first) & mask & ~shiftleft(1L, i - first), 8) | CAST(place AS BIGINT)")
    return rows.select("fp", "place", key.alias("key"), "rest")


def _extended(index: DataFrame, links: int) -> DataFrame:
    """(fp, key) once for each piece of the bits outside the segment; key packs the old key's hash with the piece."""
    width = -(-max(BITS - w for _, w in segments(links)) // (links + 1))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(links)), lambda j: F.xxhash64("key", j, F.call_function("shiftrightunsigned", F.col("rest"), j * width).bitwiseAND(F.lit((1 << width) - 1))))
    return index.select("fp", F.explode(pieces).alias("key"))


def _first_shared(links: int):
    """True where ``place`` is the first key that fp and other share."""
    place = F.lit(-1)
    for s, (first, width) in reversed(list(enumerate(segments(links)))):
        part = F.expr(f"shiftrightunsigned(fp ^ fp2, {first})").bitwiseAND(F.lit((1 << width) - 1))
        # one bit set: its number is the count of ones below it
        bit = F.when(part == 0, F.lit(0)).otherwise(F.bit_count(part - 1).cast("int"))
        place = F.when(F.bit_count(part) <= 1, F.lit(s << 6) + bit).otherwise(place)
    return _near(links) & (F.col("place") == place)


def _near(links: int):
    return F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= links


def _pairs(index: DataFrame, test) -> DataFrame:
    right = index.select(F.col("key"), F.col("fp").alias("fp2"))
    return index.join(right.hint("merge"), "key").where((F.col("fp") < F.col("fp2")) & test).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))


def _split(index: DataFrame, hot: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys that at most ``hot`` rows share, and those of the other keys (None: there are none)."""
    full = written(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), name)
    if full.isEmpty():
        return index, None
    return index.join(full, "key", "left_anti"), index.join(full, "key", "left_semi")


def link_pairs(fps: DataFrame, links: int = 4, hot: int = 128) -> DataFrame:
    """(a, b): fingerprint pairs that join the same fingerprints as all links at most ``links`` bits apart; ``fps``: (fp), distinct."""
    if links % 2:
        raise ValueError("links must be even: hot keys meet halfway")
    cold, full = _split(_index(fps, links), hot, "hot_keys")
    edges = _pairs(cold.select("fp", "place", "key"), _first_shared(links))
    if full is None:
        return edges
    warm, crowded = _split(written(_extended(full, links), "extended"), hot, "hot_keys")
    edges = edges.unionByName(_pairs(warm, _near(links)))
    if crowded is None:
        return edges
    masks = [0] + [sum(1 << i for i in c) for r in range(1, links // 2 + 1) for c in combinations(range(BITS), r)]

    def near(batches, masks=np.array(masks, np.uint64)):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(fp), 256):
                v = fp[lo : lo + 256, None] ^ masks
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp[lo : lo + 256].view(np.int64), len(masks))), pa.array(v.ravel().view(np.int64))], names=["fp", "variant"])

    # the planner takes variants for as small as their input, so both sides are told to shuffle
    variants = crowded.select("fp").distinct().mapInArrow(near, "fp long, variant long").hint("merge")
    least = variants.groupBy("variant").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most").drop("most")
    met = variants.join(least.hint("merge"), "variant").where("fp > least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
    return edges.unionByName(met)


def labelled(docs: DataFrame, links: int = 4, words_in: int = 4, seed: int = 42, hot: int = 128) -> DataFrame:
    """(_id, _h, fp, component, component_id) for each row; ``component`` names the component by its least fingerprint, also where no row has a doc_id."""
    prints = written(fingerprints(docs, words_in, seed), "prints")
    firsts = written(prints.groupBy("fp").agg(F.min("_id").alias("first")), "print_ids")
    # rows that repeat a doc_id: each of its fingerprints is linked to the least of them
    repeated = prints.where("_id is not null").groupBy("_id").agg(F.min("fp").alias("b"), F.max("fp").alias("c")).where("b < c").select("_id", "b")
    same = prints.join(repeated, "_id").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    comp = written(connected_components(link_pairs(firsts.select("fp"), links, hot).unionByName(same)), "print_components")
    several = firsts.join(comp.withColumnRenamed("node", "fp"), "fp")
    best = several.groupBy("component").agg(F.min("first").alias("component_id"))
    label = firsts.join(several.join(best, "component").select("fp", "component", "component_id"), "fp", "left")
    label = label.select("fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(label, "fp")


def components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored)."""
    return labelled(docs, **options).select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group: that of the smallest doc_id (a null one is the largest), of the smallest text hash among rows that repeat it; of rows that repeat both, one."""
    rows = written(labelled(docs.select("doc_id", "text"), **options).select("component", "_id", "_h"), "labelled")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_h")).alias("f")).select(F.col("f._id").alias("_id"), F.col("f._h").alias("_h"))
    copies = rows.groupBy("_id", "_h").agg(F.count("*").alias("n")).where("n > 1").select("_id", "_h")
    first = written(first.join(copies.withColumn("_again", F.lit(True)), first._id.eqNullSafe(copies._id) & (first._h == copies._h), "left").select(first._id, first._h, F.coalesce("_again", F.lit(False)).alias("_again")), "kept_ids")
    dropped(rows)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_t"))  # names of ``docs`` cannot meet these
    kept = packed.join(first, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_h"))).select("_row", "_d", "_t", "_again")
    out = kept.where("not _again").select("_row")
    if not first.where("_again").isEmpty():
        out = out.unionByName(kept.where("_again").groupBy("_d", "_t").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select("_row.*")
