import hashlib
from collections import Counter

import numpy as np
import pytest

from lakeleaf.llm import substring_dedup, suffix_dedup, superstrings
from lakeleaf.llm.superstrings import covered


@pytest.fixture(scope="module")
def many(spark):
    """Thousands of rows of null or repeated doc_id, most of which hold a passage or a copy, and frequent words."""
    rng = np.random.default_rng(9)
    words = ["of", "the", "and", "x"] + ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words, n))
    passages = [prose(60) for _ in range(3)]
    out = []
    for k in range(2600):
        text = f"{prose(int(rng.integers(1, 20)))} {passages[k % 3]} {prose(5)}" if k % 4 else prose(int(rng.integers(0, 40)))
        out.append((None if k < 2000 else k % 3 if k < 2400 else k, text, "en"))
    out += [(None, out[1][1], "en")] * 300 + [(None, None, None), (1, "", "en")]
    return out, spark.createDataFrame(out, "doc_id long, text string, lang string").repartition(6)


def test_words(docs, rows):
    check_words(docs, rows)


def test_words_of_null_and_repeated_ids(many):
    check_words(many[1], many[0])


def check_words(docs, rows):
    low = lambda i: -1 if i is None else i  # noqa: E731  null sorts first
    least = {}
    for i, t, _ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            s = tuple(w[k : k + 13])
            least[s] = min(least.get(s, 10**9), low(i))
    expected = Counter()
    for i, t, _ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < low(i):
                gone[k : k + 13] = [True] * 13
        expected[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.kept_words(docs).collect())
    assert got == expected
    assert sum(k[2] for k in expected) > 500


def test_bytes(docs, rows):
    check_bytes(docs, rows)


def test_bytes_of_null_and_repeated_ids(many):
    check_bytes(many[1], many[0])


def test_frequent_grams_rank_last(many):
    docs = many[1]
    split = substring_dedup.split_words(13, 2)
    rank, dictionary = superstrings.ranking(docs, split, 0)
    assert 0 < len(dictionary) <= 128 << 10
    assert 0 < len(rank.common) <= 1 << 20
    grams = np.array([*rank.common[:3], 5, 2**32 - 1], np.uint32)
    assert (rank(grams)[:3] >= 1 << 31).all() and (rank(grams)[3:] < 1 << 31).all()


def test_bucket_labels_are_dealt_evenly(spark):
    labels = superstrings.bucket_labels(spark, 13)
    frame = spark.createDataFrame([(int(x),) for x in labels], "bucket int").repartition(13, "bucket").selectExpr("spark_partition_id() as p")
    assert len(set(labels.tolist())) == 13 * 16 and {r["count"] for r in frame.groupBy("p").count().collect()} == {16}


def check_bytes(docs, rows):
    seen = Counter(b[k : k + 200] for _, t, _ in rows for b in [(t or "").encode()] for k in range(len(b) - 199))
    expected = Counter()
    for i, t, _ in rows:
        b = (t or "").encode()
        hit = [k for k in range(len(b) - 199) if seen[b[k : k + 200]] > 1]
        gone = covered(len(b), hit, [k + 200 for k in hit])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        expected[i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.kept_bytes(docs).collect())
    assert got == expected


def test_periodic_text_repeats_itself():
    texts = [b"ab" * 150 + b"c" * 10, b"x" * 90 + b"y" * 300]
    got = suffix_dedup.repeated_starts(texts, 200)
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    for t, starts in zip(texts, got):
        assert starts.tolist() == [k for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1]


@pytest.mark.parametrize("window", [8, 9, 20, 31])
def test_refinement_depths(window):
    rng = np.random.default_rng(window)
    texts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (5, 40, 200, 333)]
    seen = Counter(t[k : k + window] for t in texts for k in range(len(t) - window + 1))
    for t, starts in zip(texts, suffix_dedup.repeated_starts(texts, window)):
        assert starts.tolist() == [k for k in range(len(t) - window + 1) if seen[t[k : k + window]] > 1]


@pytest.mark.parametrize("runs", [1, 3, 8])
def test_pointers_are_reused_across_runs(runs):
    rng = np.random.default_rng(runs)
    part = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (150, 230, 400)]
    texts = [part[0] + part[1], part[1] + part[0], part[2][:250] + part[1] + b"\0", b"\0" * 230, part[2], part[2] + b"z", b"ab"]
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    for t, starts in zip(texts, suffix_dedup.repeated_starts(texts, 200, runs)):
        assert starts.tolist() == [k for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1]


def test_strings_of_other_minimisers_are_judged_apart(spark, monkeypatch):
    """Whole keys reach the judge: keys that agree in their lower bits don't make their strings one group."""

    def split_bytes(window, gram):
        def split(data, offsets, rank):
            raw = data.tobytes()
            return [(d, 0, 1, 7 + (d << 24), raw[offsets[d] : offsets[d + 1]], 0) for d in range(len(offsets) - 1)]

        return split

    def judge_bytes(window):
        def judge(blobs, expand):
            got = [superstrings.unpack_strings(b, expand) for b in blobs]
            groups, strings = {k for c, _ in got for k in c[0].tolist()}, {t for _, x in got for t in x}
            yield [np.array([x], np.int64) for x in (0, 0, len(groups), len(strings))]

        return judge

    monkeypatch.setattr(suffix_dedup, "split_bytes", split_bytes)
    monkeypatch.setattr(suffix_dedup, "judge_bytes", judge_bytes)
    frame = spark.createDataFrame([(k, f"text {k}") for k in range(100)], "doc_id long, text string").coalesce(1)
    assert [(r.start, r.end) for r in suffix_dedup.byte_spans(frame).collect()] == [(100, 100)]


def test_empty(empty):
    assert substring_dedup.kept_words(empty).collect() == [] == suffix_dedup.kept_bytes(empty).collect()


def test_hash_collisions_take_the_exact_way(monkeypatch):
    texts = [b" ".join(b"w%d" % (i + k) for i in range(14)) for k in (0, 1, 5)]
    want = substring_dedup._shared(texts, [3, 1, 2], 13)
    monkeypatch.setattr(substring_dedup, "range_hashes", lambda p, s, e: np.zeros(len(s), np.uint64))
    assert substring_dedup._shared(texts, [3, 1, 2], 13) == want


def test_digest():
    assert substring_dedup.sha256_of("a") == hashlib.sha256(b"a").hexdigest() == suffix_dedup.sha256_of(b"a")
