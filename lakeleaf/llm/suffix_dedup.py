"""Substring dedup on bytes: bucket-pointer refinement of suffixes.

Windows of ``window`` bytes reach the bucket of their minimiser (the smallest hash of ``gram`` bytes in them)
inside packed runs. There all suffixes are first sorted into buckets of equal q-grams; a suffix's pointer is its
bucket's place in the order. Buckets of several suffixes are refined by sorting them on the pointers of the
suffixes that begin where their common bytes end, which adds the later bucket's depth to theirs. Buckets are taken
in order, a run at a time, and each run is refined until it is done before the next is begun; new pointers are
written at once, so what follows reuses them and gets deeper in one step. A bucket is done when it has one suffix or
``window`` common bytes. Neighbours in the order that share a window, compared by hash and then byte by byte, are its occurrences.

A byte is removed if a ``window``-byte string covers it that also starts anywhere else, in the same document
or another. Defined cases: null or empty text has no byte; texts shorter than the window lose nothing;
repeated rows, also those of null or repeated doc_id, are occurrences like any other; an empty table gives no row.
What is left may not be valid UTF-8, so it is bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeleaf.llm.common import real_id
from lakeleaf.llm.superstrings import covered, mixed, powers, prefix_hashes, repeated_spans, sliding, unpack_strings, with_spans

Q = 7


def split_bytes(window: int, gram: int):
    span = window - gram + 1

    def split(data, offsets, rank):
        if len(data) < window:
            return
        prefix = prefix_hashes(data)
        h = (mixed((prefix[gram:] - prefix[:-gram]) * powers(len(prefix))[1][: len(data) - gram + 1]) >> np.uint64(32)).astype(np.uint32)
        h = h if rank is None else rank(h)
        least = sliding(h, span)
        end = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
        valid = np.arange(window, window + len(least)) <= end
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        run = np.flatnonzero(first)
        if not len(run):
            return
        stop = np.flatnonzero(valid & np.append(first[1:] | ~valid[1:], True))
        # a run in which the minimiser occurs twice may repeat a window within itself
        top = np.where(valid, least, 0)
        top = sliding(np.concatenate((np.zeros(span - 1, np.uint32), top, np.zeros(len(h) - len(top), np.uint32))), span, np.maximum)
        at = np.flatnonzero(top == h)
        lo, hi = np.searchsorted(at, run), np.searchsorted(at, stop + span)
        mine, count = least[run], np.zeros(len(run), np.int64)
        values = np.append(h[at], 0)
        for k in range(int(min(64, (hi - lo).max()))):
            count += (lo + k < hi) & (values[np.minimum(lo + k, len(at))] == mine)
        mark = (count > 1) | (hi - lo > 64)
        doc = np.searchsorted(offsets, run, "right") - 1
        raw = data.tobytes()
        yield from (
            (d, p, u, k, raw[s : s + u], m)
            for d, p, u, k, s, m in zip(doc.tolist(), (run - offsets[doc]).tolist(), (stop - run + window).tolist(), mine.tolist(), run.tolist(), mark.astype(int).tolist())
        )

    return split


def repeated_starts(texts: list[bytes], window: int, runs: int = 4) -> list[np.ndarray]:
    """For each string the starts of ``window``-byte strings that occur more than once in all of them, by bucket-pointer refinement."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    n, q = int(ends[-1]), min(Q, window)
    data = np.frombuffer(b"".join(texts) + bytes(q), np.uint8)
    left = (np.repeat(ends, lengths) - np.arange(n)).astype(np.int32)  # bytes from here to the string's end
    grams = np.zeros(n, np.uint64)
    for i in range(q):  # nine bits a byte; zero stands for the end of a string, which is like any other string's
        grams |= np.where(left > i, data[i : i + n].astype(np.uint64) + np.uint64(1), np.uint64(0)) << np.uint64(9 * (q - 1 - i))
    order = np.argsort(grams)
    grams = grams[order]
    new = np.concatenate(([True], grams[1:] != grams[:-1]))
    order = order.astype(np.int32)
    del grams
    pointer, depth = np.empty(n, np.int32), np.full(n, q, np.int32)
    heads = np.flatnonzero(new)
    pointer[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    size = np.diff(np.append(heads, n))
    crowded = np.flatnonzero(np.repeat(size > 1, size)) if q < window else np.zeros(0, np.int64)
    cuts = np.searchsorted(crowded, [crowded[k * len(crowded) // runs] for k in range(1, runs)]) if len(crowded) else np.zeros(0, np.int64)
    # a run begins where a bucket does
    cuts = [int(np.searchsorted(crowded, pointer[order[crowded[c]]])) for c in cuts]
    for at in np.split(crowded, cuts):
        while len(at):
            s = order[at]
            own, d = pointer[s].astype(np.int64), depth[s]
            inside = left[s] > d
            there = np.where(inside, s + d, 0)
            later = np.where(inside, pointer[there], -1)
            deeper = np.minimum(d + np.where(inside, depth[there], window), window)
            sort = np.argsort(own * (n + 1) + later + 1)
            s, own, later, deeper = s[sort], own[sort], later[sort], deeper[sort]
            order[at] = s
            new = np.concatenate(([True], (own[1:] != own[:-1]) | (later[1:] != later[:-1])))
            heads = np.flatnonzero(new)
            size = np.diff(np.append(heads, len(s)))
            pointer[s] = np.repeat(at[heads], size)
            depth[s] = deeper
            at = at[np.repeat(size > 1, size) & (deeper < window)]
    whole = order[left[order] >= window]
    if not len(whole):
        return [np.zeros(0, np.int64)] * len(texts)
    same = pointer[whole[1:]] == pointer[whole[:-1]]
    # runs that were split deeper than the window
    prefix = prefix_hashes(data[:n])
    h = (prefix[whole + window] - prefix[whole]) * powers(n + 1)[1][whole]
    close = np.flatnonzero(~same & (h[1:] == h[:-1]))
    for lo in range(0, len(close), 4096):
        k = close[lo : lo + 4096]
        one, two = (data[whole[x][:, None] + np.arange(window)] for x in (k, k + 1))
        same[k] = (one == two).all(1)
    starts = np.sort(whole[np.append(same, False) | np.append(False, same)]).astype(np.int64)
    cut = np.searchsorted(starts, ends)
    return [starts[a:b] - (e - m) for a, b, e, m in zip(np.concatenate(([0], cut[:-1])), cut, ends, lengths)]


def judge_bytes(window: int):
    def judge(blobs, expand):
        count: dict[bytes, int] = {}
        key_of: dict[bytes, int] = {}
        marked: set[bytes] = set()
        for blob in blobs:
            cols, texts = unpack_strings(blob, expand)
            for k, m, t in zip(cols[0].tolist(), cols[1].tolist(), texts):
                count[t] = count.get(t, 0) + (2 if m & 2 else 1)
                key_of[t] = k
                if m & 1:
                    marked.add(t)
        groups: dict[int, list[bytes]] = {}
        for t, k in key_of.items():
            groups.setdefault(k, []).append(t)
        some = [t for g in groups.values() if len(g) > 1 or g[0] in marked for t in g]
        starts: dict[bytes, np.ndarray] = {}
        lo = 0
        while lo < len(some):  # a key's strings stay together
            hi, size = lo, 0
            while hi < len(some) and (size < 2 << 20 or key_of[some[hi]] == key_of[some[hi - 1]]):
                size += len(some[hi])
                hi += 1
            starts.update(zip(some[lo:hi], repeated_starts(some[lo:hi], window)))
            lo = hi
        for blob in blobs:
            cols, texts = unpack_strings(blob, expand)
            doc, h, pos, units = cols[3].tolist(), cols[4].tolist(), cols[5].tolist(), cols[2].tolist()
            out = []
            for i, t in enumerate(texts):
                if count[t] > 1:
                    out.append((doc[i], h[i], pos[i], pos[i] + units[i]))
                elif t in starts and len(x := starts[t]):
                    gap = np.flatnonzero(np.diff(x) > window)
                    for a, z in zip(x[np.concatenate(([0], gap + 1))].tolist(), x[np.append(gap, len(x) - 1)].tolist()):
                        out.append((doc[i], h[i], pos[i] + a, pos[i] + z + window))
            if out:
                x = np.array(out, np.int64)
                yield [x[:, 0], x[:, 1], x[:, 2], x[:, 3]]

    return judge


def byte_spans(docs: DataFrame, window: int = 200, gram: int = 32) -> DataFrame:
    """(_id, _h, start, end) in UTF-8 bytes, for everything to be removed."""
    # whole keys: suffixes of strings that share no minimiser are never sorted together
    return repeated_spans(docs, split_bytes(window, gram), judge_bytes(window), keep_all_of_least=False, key_bits=32)


def kept_bytes(docs: DataFrame, window: int = 200, gram: int = 32) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each document without repeated bytes."""

    def apply(batches):
        for b in batches:
            rows = []
            for i, t, s, e in zip(*(c.to_pylist() for c in b.columns)):
                raw = t.encode()
                if not s:
                    rows.append((i, len(raw), 0, 0, raw))
                    continue
                gone = covered(len(raw), s, e)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((i, len(raw), len(raw) - len(kept), int(gone[0]) + int((np.diff(gone.astype(np.int8)) == 1).sum()), kept))
            yield pa.RecordBatch.from_pylist([], OUT) if not rows else pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), OUT.types)], schema=OUT)

    out = with_spans(docs, byte_spans(docs, window, gram)).mapInArrow(apply, "_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


OUT = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def sha256_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
