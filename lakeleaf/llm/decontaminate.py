"""Benchmark decontamination by latent semantic retrieval.

1. The dictionary of the benchmark's terms (exact 64-bit hashes). One scan counts in how many of all documents each occurs, and
   writes the terms of every passage of every document.
2. A latent space of low rank: the TF-IDF passages of all documents and all items
   are decomposed by a distributed randomised SVD in one pass: the passage matrix and its transpose are multiplied
   on the executors and partial products summed by term block; only the small factor is orthogonalised on the
   driver. Texts are folded in, each dimension damped by the root of its singular value (and one passage more, so that what less than
   one passage supports isn't blown up); passages that repeat are one row. The matrix has one column a term, ``width`` at
   most (terms are hashed to columns beyond), so no factor grows with the benchmark.
3. All documents are read in passages of 3 or 4 units, the size of an item's window (by class of item length), one at every
   unit. Passages whose latent cosine with an item is at least ``cosine`` are its candidates: matrix products of
   passages with all items, a stated query set, in blocks.
4. Candidates (overlapping ones joined, a unit added at both ends) are verified on words, by their places in the dictionary: some window has enough words of
   the item, and the longest common subsequence of item and window is at least ``lcs`` of the item; or, for
   paraphrases, at least ``lcs_answer`` while the item's answer (its last sentence of three words or more,
   else its last third) is there by ``answer`` of its words.

Terms and words are runs of letters, digits and non-ASCII bytes of the text in lower case. Words that no item has
have no place in the space. Items are read in blocks of ``block``, one scan of the documents for each.

Defined cases: null or empty text has no passage; null items and items without any term match nothing; items are told apart by
(item_id, text), so a null or repeated item_id is an item like any other; repeated rows match alike; documents are told apart by doc_id and a
hash of the text; an empty benchmark or table gives no row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeleaf.llm.common import byte_slices, dropped, written
from lakeleaf.llm.superstrings import mixed, prefix_hashes, range_hashes

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MATCH = "doc_id long, text_hash long, item_id long, cosine double, lcs double, answer double, word_from int, word_to int"
#: Words of the least unit; units double from level to level.
UNIT = 4
LEVELS = 12
#: Bits of an item's map of terms; a bound of the words that a window shares with it.
MAP = 1024
#: Products with the whole passage matrix before the last one; more of them turn the space to the commonest topics, and find no more (see README).
ROUNDS = 0


def _table() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for c in range(256):
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            out[c] = c
        elif 65 <= c <= 90:
            out[c] = c + 32
    return out


FOLD = _table()


def hashed_terms(data: np.ndarray, offsets: np.ndarray):
    """Of every word in order: its 64-bit hash, its document's number, its start and end."""
    low = FOLD[data]
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = low > 0
    change = np.diff(edge)
    begins, stops = change == 1, change == -1
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    inside = cut[(edge[cut] == 1) & (edge[cut + 1] == 1)]
    begins[inside] = stops[inside] = True
    starts, ends = np.flatnonzero(begins[:-1]), np.flatnonzero(stops)
    return mixed(range_hashes(prefix_hashes(low), starts, ends)), np.searchsorted(offsets, starts, "right") - 1, starts, ends


def terms_of(text: bytes) -> np.ndarray:
    return hashed_terms(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0] if text else np.zeros(0, np.uint64)


def chunked(column, size: int = 1 << 20):
    """(first row, bytes, offsets) of runs of rows of about ``size`` bytes."""
    data, at = byte_slices(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = int(max(np.searchsorted(at, at[lo] + size, "right") - 1, lo + 1))
        yield lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Dictionary:
    """Slots of a sorted set of term hashes, found by their leading bits."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.unique(terms)
        self.bits = max(4, min(22, int(len(self.terms)).bit_length() + 3))
        self.first = np.searchsorted(self.terms >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.first).max()) if len(self.terms) else 0

    def __len__(self) -> int:
        return len(self.terms)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 for those not in the set."""
        out = np.full(len(h), -1, np.int32)
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        for k in range(self.most):
            some = np.flatnonzero(at + k < end)
            here = at[some] + k
            same = self.terms[here] == h[some]
            out[some[same]] = here[same]
        return out


def scanned(docs: DataFrame, known: Dictionary, words: int) -> DataFrame:
    """One scan of all documents, written: (slot, n) says how many documents of a task hold a term of the dictionary, and for slot -1 how many
    there are; (passage) is the terms' slots, sorted, of each run of ``words`` words that has any."""
    kind = slot_type(known)

    def scan(batches):
        total, n = np.zeros(len(known), np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, data, offsets in chunked(b.column(0)):
                h, doc, *_ = hashed_terms(data, offsets)
                slot = known.slots(h)
                hit = np.flatnonzero(slot >= 0)
                if not len(hit):
                    continue
                of, slot = doc[hit], slot[hit].astype(np.int64)
                pair = np.sort(of * len(known) + slot)
                total += np.bincount(pair[np.concatenate(([True], pair[1:] != pair[:-1]))] % len(known), minlength=len(known))
                size = np.bincount(doc, minlength=len(offsets) - 1)
                many = -(-size // words)
                part = (np.cumsum(many) - many)[of] + (hit - (np.cumsum(size) - size)[of]) // words
                key = np.sort(part * len(known) + slot)
                part = key // len(known)
                edges = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(key))
                flat = (key % len(known)).astype(kind)
                passage = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])
                for lo in range(0, len(passage), 10_000):
                    some = passage.slice(lo, 10_000)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), some], names=["slot", "n", "passage"])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n)), pa.nulls(len(some) + 1, pa.binary())], names=["slot", "n", "passage"])

    return written(docs.select(F.lower(F.coalesce("text", F.lit("")))).mapInArrow(scan, "slot long, n long, passage binary"), "scanned")


def slot_type(known: Dictionary):
    return np.uint16 if len(known) <= 1 << 16 else np.uint32


def document_frequencies(scan: DataFrame, known: Dictionary) -> tuple[np.ndarray, int]:
    """How many documents hold each term of the dictionary, and how many documents there are."""
    # at most a row for each term of the block reaches the driver
    sums = scan.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = sums["slot"].to_numpy(), sums["n"].to_numpy()
    out = np.zeros(len(known), np.int64)
    out[slot[slot >= 0]] = n[slot >= 0]
    return out, int(n[slot < 0].sum())


def listed(b: pa.RecordBatch):
    """Entries (row, column, weight) of rows (at array<int>, weight array<double>)."""
    at, weight = b.column(0), b.column(1)
    return np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy().astype(np.int64), weight.flatten().to_numpy()


def passage_entries(known: Dictionary, idf: np.ndarray, columns: int):
    """Entries of rows of sorted slots: TF-IDF by column, of length 1."""
    kind = slot_type(known)

    def entries(b):
        c = b.column(0).cast(pa.large_binary())
        offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        slot = np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).astype(np.int64)
        key = np.repeat(np.arange(len(c)), np.diff(offsets) // np.dtype(kind).itemsize) * columns + slot % columns
        weight = idf[slot]
        if columns < len(known):
            order = np.argsort(key, kind="stable")
            key, weight = key[order], weight[order]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        row, at, weight = key[head] // columns, key[head] % columns, np.add.reduceat(weight, head)
        some = weight > 0
        row, at, weight = row[some], at[some], weight[some]
        return row, at, weight / np.sqrt(np.bincount(row, weight * weight, minlength=len(c)))[row]

    return entries


def add_product(z: np.ndarray, q: np.ndarray, common: np.ndarray, row: np.ndarray, at: np.ndarray, weight: np.ndarray, step: int = 1024) -> None:
    """Add AᵀAq to z, for the entries of A by row. Columns in ``common`` are multiplied as a dense block, others entry by entry; both exactly."""
    place = np.full(len(z), -1, np.int64)
    place[common] = np.arange(len(common))
    first = np.append(np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))), len(row)) if len(row) else np.zeros(1, np.int64)
    dense = q[common]
    for lo in range(0, len(first) - 1, step):
        own = first[lo : lo + step + 1]
        a, x = at[own[0] : own[-1]], weight[own[0] : own[-1]].astype(q.dtype)
        r = np.repeat(np.arange(len(own) - 1), np.diff(own))
        here = place[a] >= 0
        block = np.zeros((len(own) - 1, len(common)), q.dtype)
        block[r[here], place[a[here]]] = x[here]
        p = block @ dense
        a, x, r = a[~here], x[~here], r[~here]
        if len(a):
            g = q.take(a, axis=0)
            g *= x[:, None]
            head = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            p[r[head]] += np.add.reduceat(g, head, axis=0)
            order = np.argsort(a, kind="stable")
            a, g = a[order], p.take(r[order], axis=0)
            g *= x[order, None]
            head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            z[a[head]] += np.add.reduceat(g, head, axis=0)
        z[common] += block.T @ p


def randomised_svd(rows: DataFrame, terms: int, rank: int, rounds: int = 2, seed: int = 3, block: int = 4096, entries=listed, common: np.ndarray | None = None, kind=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(V, squared singular values) of a sparse matrix: ``entries`` takes them from a batch of ``rows``; ``common`` names columns that many rows have. Products are of type ``kind``, their sums of 64 bits.
    ``rounds`` products find the range, and one more gives the factors (Nyström's way, which loses nothing of that product)."""
    common = np.zeros(0, np.int64) if common is None else common

    def product(q: np.ndarray) -> np.ndarray:
        near, shape = q.astype(kind), q.shape

        def part(batches):
            z = np.zeros(shape)
            for b in batches:
                add_product(z, near, common, *entries(b))
            lows = range(0, terms, block)
            yield pa.RecordBatch.from_arrays([pa.array(lows, pa.int64()), pa.array([z[lo : lo + block].tobytes() for lo in lows], pa.binary())], names=["lo", "part"])

        def add(table):
            parts = [np.frombuffer(x.as_buffer()) for x in table["part"]]
            return pa.table({"lo": table["lo"][:1], "part": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})

        # partial products are bounded by terms * rank; each is summed by term block
        got = rows.mapInArrow(part, "lo long, part binary").groupBy("lo").applyInArrow(add, "lo long, part binary").collect()
        out = np.zeros(shape)
        for r in got:
            out[r.lo : r.lo + block] = np.frombuffer(bytes(r.part)).reshape(-1, shape[1])
        return out

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, min(rank, terms))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(product(q))[0]
    z = product(q)
    # a shift of the size of rounding keeps the small core positive
    shift = float(np.finfo(kind).eps * np.linalg.norm(z)) or 1e-30
    z += shift * q
    core = q.T @ z
    size, turn = np.linalg.eigh((core + core.T) / 2)
    basis, root, _ = np.linalg.svd(z @ turn / np.sqrt(np.maximum(size, shift)), full_matrices=False)
    return basis, np.where(root * root > 4 * shift, root * root - shift, 0.0)


def masks_of(a: list) -> dict:
    """The places of each element, as bits."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    return where


def common_length(masks: list[int], n: int) -> int:
    """Length of the longest common subsequence with a list of n elements, by bit vectors; ``masks``: where each element of the other one occurs in it."""
    v = full = (1 << n) - 1
    for m in masks:
        u = v & m
        if u:
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def common_subsequence(a: list, b: list) -> int:
    where = masks_of(a)
    return common_length([where[x] for x in b if x in where], len(a))


def answer_of(text: str) -> list[bytes]:
    sentences = [WORD.findall(FOLD[np.frombuffer(s.encode(), np.uint8)].tobytes()) for s in re.split(r"[.!?\n]+", text)]
    whole = [w for s in sentences for w in s]
    last = next((s for s in reversed(sentences) if len(s) >= 3), [])
    return last if last and len(last) < len(whole) else whole[-max(1, len(whole) // 3) :]


def words_of(text: str) -> list[bytes]:
    return WORD.findall(FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes())


def level_of(window: int) -> tuple[int, int]:
    """(level, units) of the least passage that is as long as a window: 3 or 4 units of UNIT << level words."""
    for level in range(LEVELS):
        for units in (3, 4):
            if units * (UNIT << level) >= window:
                return level, units
    return LEVELS - 1, 4


class Space:
    """Latent space of a block of items, and the items to verify; all that workers need."""

    def __init__(self, items: list[tuple[int | None, bytes]], known: Dictionary, idf: np.ndarray, basis: np.ndarray):
        self.ids, self.texts, self.known, self.idf = [i for i, _ in items], [t for _, t in items], known, idf.astype(np.float32)
        self.basis = basis.astype(np.float32)
        slots = [known.slots(terms_of(t)) for t in self.texts]
        self.lengths = np.array([len(s) for s in slots], np.int64)
        self.windows = np.maximum(self.lengths + self.lengths // 4, self.lengths + 2)
        self.latent = np.zeros((len(items), basis.shape[1]), np.float32)
        self.map = np.zeros((len(items), MAP + 1), bool)  # the last column: no term
        for i, s in enumerate(slots):
            self.latent[i] = unit(self.fold(s[None])[0]) if len(s) else 0
            self.map[i, s % MAP] = True
        self.classes: dict[tuple[int, int], np.ndarray] = {}
        for i, w in enumerate(self.windows.tolist()):
            if self.lengths[i]:
                self.classes.setdefault(level_of(w), []).append(i)
        self.classes = {k: np.array(v) for k, v in self.classes.items()}
        self.cache: dict[int, tuple] = {}

    def fold(self, slots: np.ndarray) -> np.ndarray:
        """Latent vectors of rows of slots."""
        return (self.basis[slots % len(self.basis)] * self.idf[slots][..., None]).sum(1)

    def item(self, i: int) -> tuple[list[int], list[int], dict, dict]:
        """Slots of an item's words and of its answer's, and where each slot occurs in them."""
        if i not in self.cache:
            if len(self.cache) > 2000:
                self.cache.clear()
            own = self.known.slots(terms_of(self.texts[i])).tolist()
            reply = self.known.slots(terms_of(b" ".join(answer_of(self.texts[i].decode())))).tolist()
            self.cache[i] = (own, reply, masks_of(own), masks_of(reply))
        return self.cache[i]

    def units(self, slot: np.ndarray, place: np.ndarray, inside: np.ndarray, rows: int) -> np.ndarray:
        """Sums of latent vectors of the words by unit; ``place``: the unit of each word, ``inside``: its place there."""
        grid = np.full((rows, UNIT), -1, np.int32)
        grid[place, inside] = slot
        out = np.zeros((rows, self.basis.shape[1]), np.float32)
        for k in range(UNIT):
            some = np.flatnonzero(grid[:, k] >= 0)
            for lo in range(0, len(some), 1 << 13):  # small enough for the cache
                at = some[lo : lo + (1 << 13)]
                s = grid[at, k]
                out[at] += self.basis.take(s % len(self.basis), axis=0) * self.idf[s][:, None]
        return out

    def candidates(self, slot: np.ndarray, doc: np.ndarray, docs: int, least: float):
        """(item, first word, end) of regions that hold a passage of cosine ``least``; words are numbered over the whole chunk."""
        size = np.bincount(doc, minlength=docs)
        first = np.concatenate(([0], np.cumsum(size)))
        inside = np.arange(len(doc)) - first[doc]
        # each document has three empty units after its own, so no passage reaches the next document
        many = -(-size // UNIT)
        base = np.concatenate(([0], np.cumsum(many + 3)))
        sums = self.units(slot, base[doc] + inside // UNIT, inside % UNIT, int(base[-1]))
        for level in range(max(k for k, _ in self.classes) + 1):
            step = UNIT << level
            of = np.repeat(np.arange(docs), many + 3)
            for units in (3, 4):
                mine = self.classes.get((level, units))
                if mine is None or len(sums) < units:
                    continue
                passage = sums[: len(sums) - units + 1].copy()
                for k in range(1, units):
                    passage += sums[k : len(sums) - units + 1 + k]
                norm = np.sqrt(np.einsum("ij,ij->i", passage, passage))
                some = np.flatnonzero(norm > 0)
                rows = max(1, (1 << 21) // len(mine))
                q = self.latent[mine].T.copy()
                found = []
                for lo in range(0, len(some), rows):
                    p = some[lo : lo + rows]
                    close = np.flatnonzero((passage[p] / norm[p, None]) @ q >= least)
                    if len(close):
                        found.append(mine[close % len(mine)] * len(sums) + p[close // len(mine)])
                if found:
                    key = np.sort(np.concatenate(found))
                    i, p = key // len(sums), key % len(sums)
                    # runs of passages that overlap, of one item and document, make one region
                    new = np.concatenate(([True], (np.diff(key) > units) | (of[p[1:]] != of[p[:-1]]) | (i[1:] != i[:-1])))
                    a, z = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(key)) - 1
                    d = of[p[a]]
                    begin = np.maximum(0, (p[a] - base[d] - 1) * step)
                    end = np.minimum(size[d], (p[z] - base[d] + units + 1) * step)
                    ok = begin < end
                    yield i[a][ok], first[d][ok] + begin[ok], first[d][ok] + end[ok]
            # the next level: two units make one
            now = -(-many // 2)
            after = np.concatenate(([0], np.cumsum(now + 3)))
            mine = np.repeat(np.arange(docs), now)
            k = np.arange(len(mine)) - np.repeat(np.cumsum(now) - now, now)
            left = base[mine] + 2 * k
            up = np.zeros((int(after[-1]), sums.shape[1]), np.float32)
            up[after[mine] + k] = sums[left] + sums[left + 1]
            sums, many, base = up, now, after

    def promising(self, slot: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray, least: float) -> np.ndarray:
        """Which regions have a window with ``least`` of the item's words, going by its map; no common subsequence is longer than that."""
        need = np.ceil(least * self.lengths - 1e-9).astype(np.int64)
        column = np.where(slot >= 0, slot % MAP, MAP)
        out, size = [], end - begin
        bounds = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + (1 << 19), 1 << 19))
        for lo, hi in zip(bounds, [*bounds[1:], len(size)]):
            if lo == hi:
                continue
            n = size[lo:hi]
            starts = np.cumsum(n) - n
            at = np.arange(int(n.sum())) - np.repeat(starts - begin[lo:hi], n)
            who = np.repeat(item[lo:hi], n)
            run = np.concatenate(([0], np.cumsum(self.map[who, column[at]], dtype=np.int32)))
            stop = np.minimum(np.arange(len(at)) + self.windows[who], np.repeat(starts + n, n))
            most = np.maximum.reduceat(run[stop] - run[:-1], starts)
            out.append(lo + np.flatnonzero(most >= need[item[lo:hi]]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def cosine(self, window: np.ndarray, i: int) -> float:
        """Latent cosine of an item and a window of slots."""
        return float(unit(self.fold(window[window >= 0][None])[0]) @ self.latent[i])


def unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) or 1.0)


def passage_words(items: list[bytes]) -> int:
    """Words of a passage: a quarter more than the items' median."""
    return max(8, int(np.median([len(terms_of(t)) for t in items])) * 5 // 4)


def latent_basis(scan: DataFrame, items: list[bytes], known: Dictionary, idf: np.ndarray, df: np.ndarray, rank: int, width: int) -> np.ndarray:
    """Columns' latent vectors, each dimension damped by the root of its singular value: from the passages of all documents and all items."""
    spark, columns = scan.sparkSession, min(width, len(known))
    own = [(np.sort(known.slots(terms_of(t))).astype(slot_type(known)).tobytes(),) for t in items]
    passages = scan.where("passage is not null").select("passage").unionByName(spark.createDataFrame(own, "passage binary"))
    matrix = written(passages.distinct(), "passages")
    held = np.bincount(np.arange(len(known)) % columns, df, minlength=columns)
    common = np.sort(np.argsort(-held, kind="stable")[:512])
    # a task's partial product has the size of the factor, so there is a task for each core, not for each file
    rows = matrix.coalesce(max(1, spark.sparkContext.defaultParallelism))
    basis, values = randomised_svd(rows, columns, min(rank + 8, columns), rounds=ROUNDS, entries=passage_entries(known, idf, columns), common=common, kind=np.float32)
    dropped(matrix)
    good = np.flatnonzero(values[:rank] > 1e-6 * values[0]) if values[0] > 0 else np.zeros(0, np.int64)
    return basis[:, good] / (values[good] + 1) ** 0.25


def matches(
    docs: DataFrame, benchmark: DataFrame, lcs: float = 0.6, lcs_answer: float = 0.45, answer: float = 0.8, cosine: float = 0.33, rank: int = 128, width: int = 1 << 15, block: int = 1 << 16
) -> DataFrame:
    """(doc_id, text_hash, item_id, cosine, lcs, answer, word_from, word_to): the best match of each item in each document that holds it."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.lower("text").alias("text")).where("text is not null").distinct()
    blocks = -(-items.count() // block)
    items = written(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, 2 * blocks if blocks > 1 else 1)))), "items")
    found = None
    for k in [r.block for r in items.select("block").distinct().orderBy("block").collect()]:
        mine = sorted(((r.item_id, r.text.encode()) for r in items.where(F.col("block") == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        mine = [r for r in mine if len(terms_of(r[1]))]
        if not mine:
            continue
        known = Dictionary(np.concatenate([terms_of(t) for _, t in mine]))
        scan = scanned(docs, known, passage_words([t for _, t in mine]))
        df, n = document_frequencies(scan, known)
        idf = np.where(df > 0, np.log((n + 1) / (df + 1.0)) + 0.1, 0.0)  # what no document holds can't tell them apart
        space = Space(mine, known, idf, latent_basis(scan, [t for _, t in mine], known, idf, df, rank, width))
        dropped(scan)
        sent = spark.sparkContext.broadcast(space)  # bounded by block, width and rank
        part = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(_search(sent, lcs, lcs_answer, answer, cosine), MATCH)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], MATCH) if found is None else found


def _search(sent, lcs: float, lcs_answer: float, answer: float, cosine: float):
    least = min(lcs, lcs_answer)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32())

    def run(batches):
        space = sent.value
        for b in batches:
            for lo, data, offsets in chunked(b.column(2)):
                h, doc, *_ = hashed_terms(data, offsets)
                if not len(h):
                    continue
                slot = space.known.slots(h)
                first = np.searchsorted(doc, np.arange(len(offsets)))
                best: dict[tuple[int, int], tuple] = {}
                for item, begin, end in space.candidates(slot, doc, len(offsets) - 1, cosine):
                    for r in space.promising(slot, item, begin, end, least):
                        i, a, z = int(item[r]), int(begin[r]), int(end[r])
                        own, reply, *masks = space.item(i)
                        got = verified(own, reply, slot[a:z].tolist(), least, lcs, answer, masks)
                        if got[0] >= lcs or (got[0] >= lcs_answer and got[1] >= answer):
                            d = int(doc[a])
                            here = a - int(first[d])
                            row = (*got[:2], space.cosine(slot[a + got[2] : a + got[3]], i), here + got[2], here + got[3])
                            best[d, i] = max(best.get((d, i), row), row)
                if best:
                    ids, hashes = b.column(0), b.column(1)
                    rows = [(ids[lo + d].as_py(), hashes[lo + d].as_py(), space.ids[i], c, s, q, x, y) for (d, i), (s, q, c, x, y) in best.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in MATCH.split(", ")])

    return run


def verified(item: list, answer: list, words: list, least: float, lcs: float, whole: float, masks=None) -> tuple[float, float, int, int]:
    """(share of the item in a common subsequence, share of its answer there, first and last place), over windows a quarter longer than the item; ``least``: a share below which none is wanted. A window with
    a share of ``lcs``, or ``whole`` of the answer, goes before others. Windows begin at words of the item: any other holds no more than the next one."""
    n, size = len(item), max(len(item) + len(item) // 4, len(item) + 2)
    own, reply = masks or (masks_of(item), masks_of(answer))
    at = [k for k, w in enumerate(words) if w in own]
    seq = [own[words[k]] for k in at]
    need = max(1, least * n - 1e-9)
    best, good = (0.0, 0.0, 0, 0), False
    if len(at) < need or common_length(seq, n) < need:
        return best  # no window has more than all the words
    end = 0
    for first, a in enumerate(at):
        while end < len(at) and at[end] < a + size:
            end += 1
        if end - first < need or good and end - first <= best[0] * n:
            continue
        share = common_length(seq[first:end], n) / n
        if share * n < need or good and share <= best[0]:
            continue
        found = [reply[words[k]] for k in at[first:end] if words[k] in reply]
        got = (share, common_length(found, len(answer)) / max(1, len(answer)), a, min(len(words), a + size))
        fits = share >= lcs or got[1] >= whole
        if fits and not good or share > best[0] and fits >= good:
            best, good = got, fits
    return best


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; a row goes by its own text, whatever rows share its doc_id."""
    found = matches(docs.select("doc_id", "text"), benchmark, **options).select(F.col("doc_id").alias("_hit"), "text_hash").distinct()
    found = written(found, "contaminated")
    return docs.join(found, docs.doc_id.cast("long").eqNullSafe(found._hit) & (F.xxhash64(docs.text) == found.text_hash), "left_anti")
