"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) sorted by size enter the bin whose remaining capacity is the tightest that still holds
them, found in a balanced tree of remaining capacities. The capacity is the smallest for which all groups fit
the given number of shards.

Groups of one size are interchangeable, so the driver packs a histogram: how many groups there are of each size. It
has at most ``sqrt(2 * total)`` entries, since distinct sizes sum to no more than the total (and each takes up at least
its value), whatever the number of groups. While one bin stays the tightest, it takes as many groups of a size as it
holds in one step. The result is a list of runs: in the order of size and group, which shard takes the groups from a
place on. Every group finds its place in that order by a range-partitioned rank and its shard by its place.

A group larger than an even share takes a shard of its own size; nothing is split.

Defined cases: null text has no bytes and forms one group with empty text; repeated rows and null doc_ids are
rows like any other; an empty table gives no rows. Slots are numbered from 0 in each shard by one rank over all rows
in the order of shard and row hash, range-partitioned, so neither a shard nor rows of one doc_id are gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeleaf.llm.common import dropped, ranked, written


class CapacityTree:
    """Bins by remaining capacity in an AVL tree; finds the tightest bin that holds a size in O(log n)."""

    class Node:
        __slots__ = ("key", "left", "right", "height")

        def __init__(self, key):
            self.key, self.left, self.right, self.height = key, None, None, 1

    def __init__(self):
        self.root = None

    @staticmethod
    def _h(n):
        return n.height if n else 0

    def _fixed(self, n):
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        lean = self._h(n.left) - self._h(n.right)
        if lean > 1:
            if self._h(n.left.left) < self._h(n.left.right):
                n.left = self._turn(n.left, "right", "left")
            return self._turn(n, "left", "right")
        if lean < -1:
            if self._h(n.right.right) < self._h(n.right.left):
                n.right = self._turn(n.right, "left", "right")
            return self._turn(n, "right", "left")
        return n

    def _turn(self, n, up, down):
        top = getattr(n, up)
        setattr(n, up, getattr(top, down))
        setattr(top, down, n)
        for x in (n, top):
            x.height = 1 + max(self._h(x.left), self._h(x.right))
        return top

    def add(self, remaining: int, number: int) -> None:
        def put(n, key):
            if n is None:
                return self.Node(key)
            if key < n.key:
                n.left = put(n.left, key)
            else:
                n.right = put(n.right, key)
            return self._fixed(n)

        self.root = put(self.root, (remaining, number))

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the (remaining, number) of the tightest bin that holds ``size``."""
        n, best = self.root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        if best is not None:
            self.root = self._without(self.root, best)
        return best

    def _without(self, n, key):
        if key < n.key:
            n.left = self._without(n.left, key)
        elif key > n.key:
            n.right = self._without(n.right, key)
        elif n.left is None or n.right is None:
            return n.left or n.right
        else:
            least = n.right
            while least.left:
                least = least.left
            n.key = least.key
            n.right = self._without(n.right, least.key)
        return self._fixed(n)


def best_fit_decreasing(sizes: list[tuple[int, int]], bins: int, capacity: int) -> list[tuple[int, int]] | None:
    """Runs (groups, bin) in the order of ``sizes``, which are (size, groups) in descending order; None if they do not fit."""
    tree = CapacityTree()
    for number in range(bins):
        tree.add(capacity, number)
    out: list[tuple[int, int]] = []
    for size, count in sizes:
        while count:
            got = tree.take(size)
            if got is None:
                return None
            # filled further, the tightest bin stays the tightest
            some = min(count, got[0] // size)
            tree.add(got[0] - some * size, got[1])
            count -= some
            if out and out[-1][1] == got[1]:
                out[-1] = (out[-1][0] + some, got[1])
            else:
                out.append((some, got[1]))
    return out


def pack(sizes: list[tuple[int, int]], bins: int) -> list[tuple[int, int]]:
    """Runs (groups, bin) of the (size, groups), descending, under the least capacity that best fit decreasing can meet.

    Any size above an even share of what is left gets a bin to itself first, so that the capacity of the rest is not raised by it.
    """
    sizes, alone, total = list(sizes), 0, sum(s * n for s, n in sizes)
    first = 0
    while first < len(sizes) and alone < bins - 1 and sizes[first][0] > total / (bins - alone):
        size, count = sizes[first]
        total -= size
        alone += 1
        sizes[first] = (size, count - 1)
        first += count == 1
    rest, free = sizes[first:], bins - alone
    own = [(1, b) for b in range(alone)]
    if not rest:
        return own
    lo = max(rest[0][0], -(-total // free))
    hi, got = lo, best_fit_decreasing(rest, free, lo)
    step = max(1, lo // 1000)
    while got is None:
        lo, hi, step = hi + 1, hi + step, step * 2
        got = best_fit_decreasing(rest, free, hi)
    while lo < hi:
        mid = (lo + hi) // 2
        if (x := best_fit_decreasing(rest, free, mid)) is None:
            lo = mid + 1
        else:
            hi, got = mid, x
    return own + [(n, alone + b) for n, b in got]


def assign(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row; texts stay where they are."""
    if overhead < 1:
        raise ValueError("sizes must be positive")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = F.monotonically_increasing_id().alias("_row")  # kept by the written table, so that equal rows differ
    rows = written(docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_group"), own), "sizes")
    groups = rows.groupBy("_group").agg(F.sum("size").alias("bytes"))
    places = ranked(groups, F.desc("bytes"), F.asc("_group"))
    histogram = sorted(((r.bytes, r.n) for r in places.groupBy("bytes").agg(F.count("*").alias("n")).collect()), reverse=True)
    runs = pack(histogram, shards)
    ends, bins = np.cumsum([n for n, _ in runs] or [0]), np.array([b for _, b in runs] or [0], np.int32)

    def place(batches):
        for b in batches:
            at = np.searchsorted(ends, b.column(1).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bins[at])], names=["_group", "shard"])

    where = places.select("_group", "position").mapInArrow(place, "_group binary, shard int")
    placed = written(rows.join(where, "_group").select("doc_id", "size", "text_crc32", "shard", "_row"), "placed")
    dropped(rows)
    return numbered(placed, "shard", F.xxhash64("doc_id", "text_crc32", "_row"), "_row").drop("_row")


def numbered(rows: DataFrame, by: str, *order) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each value of ``by`` (few values): the rank over all rows less that of the value's first row."""
    out = ranked(rows, F.asc(by), *order)
    firsts = {r[0]: r[1] for r in out.groupBy(by).agg(F.min("position")).collect()}  # one row for each value
    before = F.element_at(F.create_map(*[F.lit(x) for kv in firsts.items() for x in kv]), F.col(by)) if firsts else F.lit(0)
    return out.withColumn("slot", F.col("position") - before).drop("position")


def shard_table(docs: DataFrame, path: str, **options) -> None:
    """Write the documents themselves under ``path``, one folder for each shard."""
    placed = assign(docs, **options).select("doc_id", "text_crc32", "shard", "slot")
    full = docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    w = Window.partitionBy("doc_id", "text_crc32").orderBy("slot")
    left = full.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "text_crc32").orderBy(F.lit(1))))
    right = placed.withColumn("_k", F.row_number().over(w)).withColumnsRenamed({"doc_id": "_d", "text_crc32": "_c", "_k": "_j"})
    joined = left.join(right, left.doc_id.eqNullSafe(right._d) & (left.text_crc32 == right._c) & (left._k == right._j))
    joined.drop("_d", "_c", "_j", "_k", "text_crc32").write.partitionBy("shard").parquet(path)
