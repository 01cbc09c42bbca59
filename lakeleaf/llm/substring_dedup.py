"""Substring dedup on word windows by super-k-mer partitioning.

A window is ``window`` consecutive words of one document; its minimiser is the smallest hash of ``gram``
consecutive words in it. Runs of windows with one minimiser are packed as one string and sent to the
minimiser's bucket, where windows are sorted and counted exactly (equal hashes are compared byte by byte).
A word is removed if a window covers it whose words also start in a document with a smaller doc_id.

Defined cases: null or empty text has no word; documents shorter than a window lose nothing; rows that
repeat a doc_id never remove each other's words; a null doc_id counts as the smallest. Memory of a task is
bounded by one bucket's distinct strings and its compressed blobs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeleaf.llm.common import real_id
from lakeleaf.llm.superstrings import covered, mixed, prefix_hashes, range_hashes, repeated_spans, sliding, unpack_strings, with_spans


def _blank() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


BLANK = _blank()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the document number of each."""
    letter = np.zeros(len(data) + 2, np.int8)
    letter[1:-1] = ~BLANK[data]
    change = np.diff(letter)
    begins, stops = change == 1, change == -1
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    inside = cut[(letter[cut] == 1) & (letter[cut + 1] == 1)]  # documents that touch are cut apart
    begins[inside] = stops[inside] = True
    starts, ends = np.flatnonzero(begins[:-1]), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def split_words(window: int, gram: int):
    def split(data, offsets, rank):
        starts, ends, doc = word_bounds(data, offsets)
        n = len(starts) - window + 1
        if n <= 0:
            return
        # words joined by one space, so that a window's bytes do not depend on the blanks between its words
        lengths = ends - starts
        at = np.concatenate(([0], np.cumsum(lengths + 1)))
        flat = np.full(at[-1], 0x20, np.uint8)
        to = np.ones(at[-1], bool)
        to[at[1:] - 1] = False
        flat[to] = data[~BLANK[data]]
        a, z = at[:-1], at[1:] - 1
        prefix = prefix_hashes(flat)
        m = len(starts) - gram + 1
        grams = (mixed(range_hashes(prefix, a[:m], z[gram - 1 :])) >> np.uint64(32)).astype(np.uint32)
        grams = grams if rank is None else rank(grams)
        least = sliding(grams, window - gram + 1)
        valid = doc[:n] == doc[window - 1 :]
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (doc[1:n] != doc[: n - 1])
        run = np.flatnonzero(first)
        if not len(run):
            return
        stop = np.flatnonzero(valid & np.append(first[1:] | ~valid[1:], True))
        base = np.searchsorted(doc, np.arange(len(offsets)))
        raw = flat.tobytes()
        last = stop + window - 1
        yield from (
            (d, p, u, k, raw[s:e], 0)
            for d, p, u, k, s, e in zip(doc[run].tolist(), (run - base[doc[run]]).tolist(), (last - run + 1).tolist(), least[run].tolist(), a[run].tolist(), z[last].tolist())
        )

    return split


def judge_words(window: int):
    def judge(blobs, expand):
        least: dict[bytes, int] = {}
        key_of: dict[bytes, int] = {}
        for blob in blobs:
            cols, texts = unpack_strings(blob, expand)
            for k, d, t in zip(cols[0].tolist(), cols[3].tolist(), texts):
                if d < least.get(t, 2**63):
                    least[t] = d
                    key_of[t] = k
        # windows can be shared only by strings with one minimiser
        per_key: dict[int, int] = {}
        for k in key_of.values():
            per_key[k] = per_key.get(k, 0) + 1
        some = [t for t, k in key_of.items() if per_key[k] > 1]
        flags = _shared(some, [least[t] for t in some], window) if some else {}
        for blob in blobs:
            cols, texts = unpack_strings(blob, expand)
            doc, h, pos, units = cols[3], cols[4], cols[5], cols[2]
            out = []
            for i, t in enumerate(texts):
                if doc[i] > least[t]:
                    out.append((doc[i], h[i], pos[i], pos[i] + units[i]))
                elif t in flags:
                    out += [(doc[i], h[i], pos[i] + w, pos[i] + w + window) for w in flags[t]]
            if out:
                x = np.array(out, np.int64)
                yield [x[:, 0], x[:, 1], x[:, 2], x[:, 3]]

    return judge


def _shared(texts: list[bytes], docs: list[int], window: int) -> dict[bytes, list[int]]:
    """Numbers of each string's windows that a string of a smaller doc_id has too."""
    raw = b"\n".join(texts)
    data = np.frombuffer(raw, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
    starts, ends, of = word_bounds(data, offsets)
    n = len(starts) - window + 1
    w = np.flatnonzero(of[:n] == of[window - 1 :])
    s, e = starts[w], ends[w + window - 1]
    hashes = range_hashes(prefix_hashes(data), s, e)
    doc = np.array(docs, np.int64)[of[w]]
    order = np.argsort(hashes, kind="stable")
    sorted_h = hashes[order]
    new = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))
    if new.all():
        return {}
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    several = size[group] > 1
    # only groups of several; equal hashes must be equal bytes
    order, group = order[several], group[several]
    s1, e1 = s[order].tolist(), e[order].tolist()
    head = None
    for i, g in enumerate(group.tolist()):
        if g != head:
            head, text = g, raw[s1[i] : e1[i]]
        elif raw[s1[i] : e1[i]] != text:
            return _shared_plain(raw, s.tolist(), e.tolist(), doc.tolist(), of[w], w - np.searchsorted(of, of[w]), texts)
    start_of = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    lowest = np.minimum.reduceat(doc[order], start_of)
    hit = order[doc[order] > np.repeat(lowest, np.diff(np.append(start_of, len(order))))]
    first = np.searchsorted(of, np.arange(len(texts)))
    out: dict[bytes, list[int]] = {}
    for t, k in zip(of[w[hit]].tolist(), (w[hit] - first[of[w[hit]]]).tolist()):
        out.setdefault(texts[t], []).append(k)
    return out


def _shared_plain(raw, starts, ends, docs, of, number, texts) -> dict[bytes, list[int]]:
    """The same by a dictionary of whole windows, for buckets where two windows have one hash."""
    least: dict[bytes, int] = {}
    for s, e, d in zip(starts, ends, docs):
        least[raw[s:e]] = min(d, least.get(raw[s:e], d))
    out: dict[bytes, list[int]] = {}
    for s, e, d, t, k in zip(starts, ends, docs, of.tolist(), number.tolist()):
        if d > least[raw[s:e]]:
            out.setdefault(texts[t], []).append(k)
    return out


def word_spans(docs: DataFrame, window: int = 13, gram: int = 2) -> DataFrame:
    """(_id, _h, start, end) in words, for everything to be removed."""
    return repeated_spans(docs, split_words(window, gram), judge_words(window), keep_all_of_least=True)


def kept_words(docs: DataFrame, window: int = 13, gram: int = 2) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): each document without the words that earlier documents have."""

    def apply(batches):
        for b in batches:
            rows = []
            for i, t, s, e in zip(*(c.to_pylist() for c in b.columns)):
                words = t.encode().split()
                gone = covered(len(words), s or (), e or ())
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if s else words
                rows.append((i, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["_id", "n_words", "n_removed", "kept_text"]) if rows else pa.RecordBatch.from_pylist([], pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]))

    out = with_spans(docs, word_spans(docs, window, gram)).mapInArrow(apply, "_id long, n_words long, n_removed long, kept_text string")
    return out.select(real_id().alias("doc_id"), "n_words", "n_removed", "kept_text")


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
