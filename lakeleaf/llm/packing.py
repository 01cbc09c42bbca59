"""Packing by lexical retrieval.

Documents are tokenised, closed with ``end_id`` and cut: whole windows of ``window`` tokens are sequences of
their own, the rest of each document (shorter than a window) is packed with related rests.

Retrieval is BM25 over the whole documents' terms (token ids), every term of a document being its query; number
of documents, document frequencies and mean length are those of the whole table. A table of at most
``per_shard`` documents is one fill task. A larger one is grouped by likeness: documents' BM25 vectors are
projected to ``DIMS`` numbers, a tree of two-means splits is fitted on a bounded sample, and runs of neighbouring
leaves make fill tasks of about ``per_shard`` documents whatever the input's size. A leaf that holds more (copies,
mostly) is divided by hash. Retrieval is exact inside a fill task; a neighbour that the tree puts elsewhere is not
reached, so recall is measured (README) and falls with the number of fill tasks, but not as one over it.

A fill task makes one window after another: a seed, then its best unused neighbours that fit, then as much
of the best neighbour left as closes the window; what is cut off stays in the index. A task's last window is
cut into powers of two, so nothing is padded.

Ids are those of a plain call of the ``tokenizers`` file. A blank between two characters that are not white space always begins a
new pre-token of the byte-level pattern, so the words cut there have the same ids as in the whole text: texts are cut by Arrow, many at a time, and each word that a
run of texts has is merged once. Texts with other blanks, and texts that hold a special token, are encoded one by one, those with a special token by ``tokenizers``.
The vocabulary and merge order of that file are also given to ``tiktoken``, which merges rare words three times as fast. Of what it merges, one call in ``CHECKED``
(by a checksum of its text) is repeated by ``tokenizers``, for good; a difference raises, and so does a word that doesn't begin with a token.

Defined cases: null text is empty, its document is ``end_id`` alone; null and repeated doc_ids are documents
like any other, told apart by a number of the written row, so that they too are dealt over fill tasks; an empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeleaf.llm.common import written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# Fixed value: the byte-level pre-tokeniser's pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def fast_twin(tokenizer):
    """An equal ``tiktoken`` encoding of a byte-level BPE tokenizer, or None."""
    import json

    import tiktoken

    model = json.loads(tokenizer.to_str())
    if model["model"]["type"] != "BPE" or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model.get("normalizer"):
        return None
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    hidden = [c for c in range(256) if c not in set(shown)]
    byte_of = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(hidden)}
    special = {t["content"] for t in model.get("added_tokens", ())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("twin", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: One in so many calls of the twin is repeated by the tokenizer itself.
CHECKED = 64
#: Longer pieces aren't cached, which bounds the cache's bytes by its entries.
LONGEST = 64
#: Words kept from run to run of texts.
KEPT = 100_000
#: What ``str.isspace`` takes for white space (more than the pattern's own), and texts that have a blank beside it or begin or end with it.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
UNCUT = rf"\A{WHITE}|{WHITE}\z|\x20{WHITE}|{WHITE}\x20"


class Encoder:
    """Token ids as little-endian 16-bit bytes, from a bounded cache of pieces."""

    def __init__(self, path: str, entries: int = 500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 65536
        if self.wide:
            raise ValueError("ids beyond 16 bits are not supported")
        self.cache: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.twin = fast_twin(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.entries = entries
        mark = self.tokenizer.encode("\r", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.words, self.word_ids = pa.array([""], pa.large_string()), pa.array([b""], pa.large_binary())
        self.sizes = np.zeros(65536, np.int64)  # bytes of each token
        for token, i in self.twin._mergeable_ranks.items() if self.twin else ():
            self.sizes[i] = len(token)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)  # without offsets

    def ids(self, text: str) -> np.ndarray:
        if self.twin is None:
            return self.plain(text)
        out = np.array(self.twin.encode_ordinary(text), np.uint16)
        if zlib.crc32(text.encode()) % CHECKED == 0 and not np.array_equal(out, self.plain(text)):
            raise RuntimeError("both tokenizers must give the same ids")
        return out

    def whole(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self.plain(text).tobytes()
        first, *rest = text.split(" ")
        if first and (first[-1].isspace() or not rest):
            return self.whole(text)
        cache = self.cache
        found = list(map(cache.get, rest))
        if None in found:
            missing = list({p: None for p, ids in zip(rest, found) if ids is None})
            if any(not p or p[0].isspace() or p[-1].isspace() or "\r" in p for p in missing) or self.mark is None:
                return self.whole(text)
            ids = self.ids(" " + "\r ".join(missing))
            raw, at = ids.tobytes(), [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            new = {p: raw[2 * a + 2 : 2 * z] for p, a, z in zip(missing, at, at[1:])}
            found = [new[p] if ids is None else ids for p, ids in zip(rest, found)]
            if len(cache) < self.entries:
                cache.update((p, x) for p, x in new.items() if len(p) <= LONGEST)
        if first:  # the text's first piece has no blank before it
            found.insert(0, self.head(first))
        return b"".join(found)

    def head(self, first: str) -> bytes:
        if len(self.heads) > 50_000:
            self.heads.clear()
        ids = self.heads.get(first) or self.whole(first)
        if len(first) <= LONGEST:
            self.heads[first] = ids
        return ids

    def merged(self, words: pa.Array, step: int = 512) -> list[pa.Array]:
        """Ids of words that begin and end with no white space, each with a blank before it."""
        out = []
        for lo in range(0, len(words), step):
            some = words.slice(lo, step)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), pa.scalar(" ", pa.large_string()))[0].as_py()
            ids = self.ids(" " + text)
            ends = np.cumsum(self.sizes[ids])
            places = np.concatenate(([0], np.cumsum(pc.binary_length(some).to_numpy() + 1)))
            bounds = np.searchsorted(ends, places, "right")
            if not np.array_equal(ends[bounds[1:] - 1], places[1:]):
                raise RuntimeError("a word must begin with a token")
            out.append(pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(bounds * 2), pa.py_buffer(ids)]))
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts one after another, and where each text's begin (one more entry than texts)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        alone = pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False) | (self.twin is None)
        for x in self.special:
            alone |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.if_else(pa.array(alone), "", texts), " ")
        at, flat = parts.offsets.to_numpy() - parts.offsets[0].as_py(), parts.flatten()
        first = flat.take(pa.array(at[:-1])).to_pylist()
        # words known before keep their places
        coded = pa.concat_arrays([self.words, flat]).dictionary_encode()
        del parts, flat
        words, known = coded.dictionary, len(self.words)
        word_ids = pa.concat_arrays([self.word_ids, *self.merged(words.slice(known))])
        # a text's first piece has no blank before it; a text that isn't cut is such a piece
        first = [self.head(x) if x else b"" for x in first]
        for i in np.flatnonzero(alone).tolist():
            first[i] = self.encode(texts[i].as_py())
        place = coded.indices.to_numpy()[known:].copy()
        place[at[:-1]] = len(words) + np.arange(len(first))
        found = pa.concat_arrays([word_ids, pa.array(first, pa.large_binary())]).take(pa.array(place))
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1]
        if known < KEPT and len(words) > known:
            short = pc.less_equal(pc.binary_length(words), LONGEST)
            self.words, self.word_ids = (x.filter(short).slice(0, KEPT) for x in (words, word_ids))
        return np.frombuffer(found.buffers()[2] or b"", np.uint16)[: int(ends[-1]) // 2], ends[at] // 2


def worker_encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    kept = sys.modules.setdefault("_lakeleaf_encoders", types.ModuleType("_lakeleaf_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Encoder(path)
    return kept.__dict__[path]


def forget(*kept: str) -> None:
    """Frees what a worker keeps between tasks for steps that are over, and gives the memory back."""
    if any([sys.modules.pop(f"_lakeleaf_{name}", None) for name in kept]):
        gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # glibc's
        trim(0)


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(batches, rows: int = 1000):
    """Batches of at most ``rows`` rows: bounds the buffers on both sides."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.slice(lo, rows)


def text_runs(b: pa.RecordBatch, size: int = 1 << 22):
    """Runs of a batch's rows whose texts (column 1) have about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64))
    lo = 0
    while lo < len(b):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")), lo + 1)
        yield b.slice(lo, hi - lo)
        lo = hi


def count_bytes(counts: np.ndarray) -> bytes:
    """A document's counts, of one byte each if all fit, else of four."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def bag_from(terms, counts) -> tuple[np.ndarray, np.ndarray]:
    """Terms and counts as ``tokenised`` wrote them."""
    term, count = np.frombuffer(terms, np.uint16), np.frombuffer(counts, np.uint8)
    return term, count.astype(np.uint32) if len(count) == len(term) else count.view(np.uint32)


def bag_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms and their counts."""
    return np.unique(ids, return_counts=True)


def tokenised(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """(doc_id, tokens, full, rest, mix, terms, counts): token count, CRCs of the whole windows, ids of the rest, the whole document's terms without ``end_id``."""

    def run(batches):
        encoder = worker_encoder(tokenizer)
        end = np.array([end_id], np.uint16)
        for b, flat, at in ((some, *encoder.encode_all(some.column(1))) for batch in batches for some in text_runs(batch)):
            for lo in range(0, len(b), 1000):
                own = b.slice(lo, 1000)
                tokens, full, rest, terms, counts = [], [], [], [], []
                for a, z in zip(at[lo : lo + 1000].tolist(), at[lo + 1 : lo + 1001].tolist()):
                    ids = np.concatenate((flat[a:z], end))
                    whole = len(ids) // window * window
                    tokens.append(len(ids))
                    full.append(np.array([crc_of(ids[k : k + window]) for k in range(0, whole, window)], np.uint32).tobytes())
                    rest.append(ids[whole:].tobytes())
                    term, count = bag_of(ids[:-1])
                    terms.append(term.astype(np.uint16).tobytes())
                    counts.append(count_bytes(count))
                columns = [own.column(0), pa.array(tokens, pa.int64()), *(pa.array(c, pa.binary()) for c in (full, rest)), own.column(2), *(pa.array(c, pa.binary()) for c in (terms, counts))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tokens", "full", "rest", "mix", "terms", "counts"])

    out = "doc_id long, tokens long, full binary, rest binary, mix long, terms binary, counts binary"
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("mix")).mapInArrow(run, out)


class Stats:
    """Figures of the whole table: documents, mean length, document frequency of each term."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean = max(1, n), max(1.0, mean)
        self.idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))

    def weight(self, term, tf, length, k1: float = 1.2, b: float = 0.75):
        return self.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / self.mean))


def stats_of(rows: DataFrame) -> Stats:
    """At most one row for each token id and two more reach the driver."""

    def count(batches):
        forget("encoders")
        df, docs, length = np.zeros(65536, np.int64), 0, 0
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint16), minlength=65536)
            docs += len(b)
            length += sum(b.column(1).to_pylist())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1, -2], pa.int64()), pa.array([*df[some].tolist(), docs, length], pa.int64())], names=["term", "n"])

    got = dict(rows.select("terms", "tokens").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pandas().values.tolist())
    n, length = got.pop(-1, 0), got.pop(-2, 0)
    df = np.zeros(65536, np.int64)
    df[list(got)] = list(got.values())
    return Stats(n, (length - n) / max(1, n), df)


DIMS = 128


def likeness(terms: list[np.ndarray], counts: list[np.ndarray], stats: Stats) -> np.ndarray:
    """Unit vectors of documents: BM25 weights, projected at random."""
    kept = sys.modules.setdefault("_lakeleaf_projection", types.ModuleType("_lakeleaf_projection"))
    if "basis" not in kept.__dict__:
        kept.basis = np.random.default_rng(11).standard_normal((65536, DIMS), np.float32)
    out = np.zeros((len(terms), DIMS), np.float32)
    for i, (t, c) in enumerate(zip(terms, counts)):
        if len(t):
            v = stats.weight(t, c, c.sum()).astype(np.float32) @ kept.basis[t]
            out[i] = v / (np.linalg.norm(v) or 1)
    return out


class Tree:
    """Two-means splits of a sample down to leaves of ``least`` documents; each leaf has its first fill task and how many it is divided into."""

    def __init__(self, sample: np.ndarray, scale: float, per_shard: int):
        self.normal, self.limit, self.child, sizes = [], [], [], []
        least = per_shard / 4

        def grow(idx) -> int:
            """A node's number, or -1 - leaf; leaves are numbered from left to right."""
            x = sample[idx]
            side = None
            if len(idx) * scale > least and len(idx) > 1:
                centred = x - x.mean(0)
                axis = centred[np.argmax((centred**2).sum(1))]
                for _ in range(4):
                    axis = centred.T @ (centred @ axis)
                    axis = axis / (np.linalg.norm(axis) or 1)
                side = centred @ axis > 0
                for _ in range(6):
                    if side.all() or not side.any():
                        break
                    one, two = x[~side].mean(0), x[side].mean(0)
                    normal, limit = two - one, (two @ two - one @ one) / 2
                    side = x @ normal > limit
            if side is None or side.all() or not side.any():
                sizes.append(len(idx) * scale)
                return -len(sizes)
            at = len(self.normal)
            self.normal.append(normal)
            self.limit.append(limit)
            self.child.append(None)
            self.child[at] = (grow(idx[~side]), grow(idx[side]))
            return at

        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 2 * len(sample) + 1000))
        self.root = grow(np.arange(len(sample)))
        sys.setrecursionlimit(limit)
        self.first, self.parts, now, room = [], [], -1, 0.0
        for size in sizes:
            if size > per_shard:
                parts, room = int(-(-size // per_shard)), 0.0
                self.first.append(now + 1)
                now += parts
            else:
                if size > room:
                    now, room = now + 1, float(per_shard)
                parts, room = 1, room - size
                self.first.append(now)
            self.parts.append(parts)
        self.normal, self.limit, self.child = np.array(self.normal, np.float32).reshape(-1, DIMS), np.array(self.limit, np.float32), np.array(self.child, np.int64).reshape(-1, 2)
        self.first, self.parts = np.array(self.first, np.int64), np.array(self.parts, np.int64)

    def shard(self, vectors: np.ndarray, mix: np.ndarray) -> np.ndarray:
        node = np.full(len(vectors), self.root)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            right = np.einsum("ij,ij->i", vectors[inner], self.normal[at]) > self.limit[at]
            node[inner] = self.child[at, right.astype(np.int64)]
        leaf = -1 - node
        return self.first[leaf] + mix % self.parts[leaf]


def sharded(rows: DataFrame, stats: Stats, per_shard: int, sample: int = 20_000) -> DataFrame:
    """``rows`` with the fill task of each, by likeness; ``sample``: documents that the tree is fitted on, about."""
    if stats.n <= per_shard:
        return rows.withColumn("shard", F.lit(0).cast("long"))
    terms_of = lambda b: zip(*(bag_from(t.as_buffer(), c.as_buffer()) for t, c in zip(b.column("terms"), b.column("counts"))))

    def vectors(batches):
        for b in pieces(batches):
            out = likeness(*terms_of(b), stats)
            yield pa.RecordBatch.from_arrays([b.column("mix"), pa.array([v.tobytes() for v in out], pa.binary())], names=["mix", "v"])

    every = max(1, stats.n // sample)
    got = rows.where(F.pmod("mix", F.lit(every)) == 0).select("mix", "terms", "counts").mapInArrow(vectors, "mix long, v binary").limit(2 * sample).toArrow().sort_by("mix")
    x = np.frombuffer(b"".join(got["v"].to_pylist()), np.float32).reshape(-1, DIMS)
    tree = Tree(x, stats.n / max(1, len(x)), per_shard)

    def place(batches):
        forget("encoders")
        for b in pieces(batches):
            where = tree.shard(likeness(*terms_of(b), stats), b.column("mix").to_numpy())
            yield b.append_column("shard", pa.array(where, pa.int64()))

    return rows.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", shard long")


class Index:
    """BM25 inverted index of one fill task, with the whole table's figures: postings of every term, by term."""

    def __init__(self, bags: list, stats: Stats | None = None):
        bags = [x if isinstance(x, tuple) else bag_of(x) for x in bags]
        n = max(1, len(bags))
        lengths = np.array([c.sum() for _, c in bags], np.int64)
        held = np.array([len(t) for t, _ in bags], np.int64)
        term = np.concatenate([*(t for t, _ in bags), np.zeros(0, np.uint16)]).astype(np.uint16, copy=False)
        tf = np.concatenate([*(c for _, c in bags), np.zeros(0, np.uint32)]).astype(np.uint32, copy=False)
        doc = np.repeat(np.arange(len(bags), dtype=np.int32), held)
        if stats is None:
            stats = Stats(n, lengths.mean() if len(lengths) else 1.0, np.bincount(term, minlength=65536))
        order = np.argsort(term, kind="stable")
        term, self.doc, tf = term[order], doc[order].astype(np.int64), tf[order]
        del doc, order
        new = np.concatenate(([True], term[1:] != term[:-1])) if len(term) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(term)).astype(np.int64)[: len(self.first)]
        slot = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.weight = np.empty(len(term))
        for lo in range(0, len(term), 1 << 16):
            own = slice(lo, lo + (1 << 16))
            self.weight[own] = stats.weight(term[own], tf[own], lengths[self.doc[own]])
        del term, tf, new
        # each document's query: all its terms that some other document here has too
        shared = (self.last - self.first)[slot] > 1
        own = self.doc[shared].astype(np.int32)
        terms = slot[shared][np.argsort(own, kind="stable")]
        at = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(bags)))))
        del own, shared
        self.query = [terms[a:z] for a, z in zip(at, at[1:])]
        self.n = len(bags)
        # weights of terms that an eighth of the documents have lie in full rows; no more than eight rows for each term of a mean document
        full = np.flatnonzero((self.last - self.first) * 8 >= self.n)
        self.row = np.full(len(self.first), -1, np.int64)
        self.row[full] = np.arange(len(full))
        self.table = np.zeros((len(full), self.n), np.float32)
        mine = self.row[slot] >= 0
        self.table[self.row[slot[mine]], self.doc[mine]] = self.weight[mine]

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term with the seed, best score first, then in order."""
        terms = self.query[seed]
        if not len(terms):
            return terms
        row = self.row[terms]
        common, terms = self.table[row[row >= 0]].sum(0), terms[row < 0]
        size = self.last[terms] - self.first[terms]
        where = np.arange(size.sum()) + np.repeat(self.first[terms] - np.cumsum(size) + size, size)
        score = np.bincount(self.doc[where], self.weight[where], self.n) + common
        score[seed] = 0
        found = np.flatnonzero((score > 0) & ~used)
        return found[np.argsort(-score[found], kind="stable")]


def fill(ids: list[np.ndarray], window: int, bags: list | None = None, stats: Stats | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, end) pieces over the rests of one fill task; ``bags``: terms of the whole documents."""
    index = Index(ids if bags is None else bags, stats)
    n = len(ids)
    start, size = np.zeros(n, np.int64), np.array([len(x) for x in ids], np.int64)
    used, nxt, out = size == 0, 0, []
    while True:
        while nxt < n and used[nxt]:
            nxt += 1
        if nxt == n:
            break
        pieces, room = [], window

        def take(d, room):
            m = int(min(room, size[d] - start[d]))
            pieces.append((d, int(start[d]), int(start[d]) + m))
            start[d] += m
            used[d] = start[d] == size[d]
            return room - m

        room = take(nxt, room)
        best = index.neighbours(pieces[0][0], used)
        left = (size - start)[best]
        while room and len(best):
            ok = np.flatnonzero(left <= room)
            if not len(ok):
                room = take(int(best[0]), room)
                break
            k = int(ok[0])
            room = take(int(best[k]), room)
            passed = best[:k]
            best, left = (np.delete(best, k), np.delete(left, k)) if len(passed) else (best[1:], left[1:])
        d = nxt
        while room and d < n:
            if not used[d]:
                room = take(d, room)
            d += 1
        out.append(pieces)
    if out:
        out[-1:] = powers_of_two(out[-1], window)
    return out


def powers_of_two(pieces: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """Cut one sequence into sequences whose lengths are powers of two."""
    total, out, queue = sum(z - a for _, a, z in pieces), [], list(pieces)
    if total == window:
        return [pieces]
    while total:
        room, now = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            d, a, z = queue.pop(0)
            m = min(room, z - a)
            now.append((d, a, a + m))
            room -= m
            if a + m < z:
                queue.insert(0, (d, a + m, z))
        out.append(now)
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, per_shard: int = 2048) -> DataFrame:
    """One row for each piece: which ids of which document lie where in which sequence."""
    rows = written(tokenised(docs, tokenizer, window, end_id), "tokens")
    stats = stats_of(rows)
    rows = sharded(rows, stats, per_shard)

    def run(batches):
        def shard_rows(shard, docs):
            docs.sort(key=lambda r: (r[0] is None, r[0] or 0, r[4]))
            number, out = shard << 32, []
            for doc, tokens, full, *_ in docs:
                for k, crc in enumerate(np.frombuffer(full, np.uint32).tolist()):
                    out.append((doc, k * window, window, crc, tokens, number, 0))
                    number += 1
            ids = [np.frombuffer(r[3], np.uint16) for r in docs]
            bags = [bag_from(r[5], r[6]) for r in docs]
            for sequence in fill(ids, window, bags, stats):
                offset = 0
                for d, a, z in sequence:
                    doc, tokens = docs[d][:2]
                    out.append((doc, tokens - len(ids[d]) + a, z - a, crc_of(ids[d][a:z]), tokens, number, offset))
                    offset += z - a
                number += 1
            for lo in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[lo : lo + 20_000])], names=[x.split()[0] for x in PIECES.split(", ")])

        forget("encoders", "projection")
        now, gathered = None, []
        for b in pieces(batches):
            for shard, *row in zip(*(c.to_pylist() for c in b.columns)):
                if shard != now:
                    if gathered:
                        yield from shard_rows(now, gathered)
                    now, gathered = shard, []
                gathered.append(row)
        if gathered:
            yield from shard_rows(now, gathered)

    parted = rows.repartition(F.col("shard")).sortWithinPartitions("shard").select("shard", "doc_id", "tokens", "full", "rest", "mix", "terms", "counts")
    return parted.mapInArrow(run, PIECES)
