import hashlib
import math
import os
import re
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeleaf.llm import decontaminate, langid, packing, quality, queries, secrets, sharding, warc

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
RANDOM = "q7Zx9Lk2Vb8Rt4Wm1Pc6"


def plain_secrets(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


TEXTS = [
    "é password = 'hunter22xyz' and TOKEN:abc", "secret=token: abcdefgh", "AKIA" + "A1" * 8 + " AKIAshort", "0123456789abcdef01234567 x", "api_key=" + "0a" * 16 + ",apikey:short", f"key {RANDOM} end",
    None, "", "𝒳 passwd:longenough1 𝒳 password:longenough2", "thisisaverylongwordwithoutdigits", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1",
]


def test_secret_patterns(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], 1)], "doc_id long, text string, spans int")
    for r in secrets.scan(df).collect():
        t = TEXTS[0] if r.doc_id is None else TEXTS[r.doc_id] or ""
        base = [(s.start, s.kind, s.end) for s in r.spans if s.kind < 3]
        assert base == plain_secrets(t), t
    extra = {t[s.start : s.end] for r in secrets.scan(df).collect() for t in [TEXTS[r.doc_id or 0] or ""] for s in r.spans if s.kind == 3}
    assert RANDOM in extra and not any(x.startswith("aaaa") for x in extra)
    masked = secrets.redacted(df)
    assert masked.columns == df.columns
    by = {r.doc_id: r.text for r in masked.collect()}
    assert by[3] == "[REDACTED] x" and by[9] == TEXTS[9] and by[6] is None and by[1] == "[REDACTED]"[:0] + by[1]
    assert secrets.scan(df.limit(0)).collect() == []


def test_secret_query_counts_spans_by_kind(spark, tmp_path):
    texts = [*TEXTS, "x AKIA" + "B2" * 9, "token=abcdefgh " + "0f" * 12 + " AKIA" + "A1" * 8 + " secret:qrstuvwx"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op2_secret_scan(spark, str(tmp_path)).collect():
        base = plain_secrets(texts[r.doc_id] or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in base) for kind in range(3)], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in base).encode()).hexdigest()


def test_secret_tokens_inside_assignments_and_mixed_runs(spark):
    texts = [f"client_key={RANDOM}", f"?sig={RANDOM}&x", f"AUTH={RANDOM}==", f"v1/ab-{RANDOM}", f"{RANDOM}", f"a={RANDOM}=b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(df).collect():
        found = [texts[r.doc_id][s.start : s.end].rstrip("=") for s in r.spans if s.kind == 3]
        assert len(found) == 1 and found[0] in (RANDOM, "ab-" + RANDOM), texts[r.doc_id]


def plain_p(token):
    """The battery's p-value in plain Python."""
    body = token.rstrip("=")
    name = next(k for k, p in (("hex", "[0-9a-f]+"), ("HEX", "[0-9A-F]+"), ("base32", "[A-Z2-7]+"), ("base62", "[A-Za-z0-9]+"), ("base64", "[A-Za-z0-9+/]+"), ("base64url", "[A-Za-z0-9_-]+")) if re.fullmatch(p, body))
    at = [secrets.ALPHABETS[name].index(c) + 1 for c in body]
    n, k = len(at), len(secrets.ALPHABETS[name])
    tail = lambda z: math.erfc(z / 2**0.5) / 2

    def gamma(x, mean, variance, third):
        skew = third / variance**1.5
        shape = 4 / skew**2
        return tail((max(1e-9, 1 + (x - mean) / variance**0.5 * skew / 2) ** (1 / 3) - (1 - 1 / (9 * shape))) * 3 * shape**0.5)

    equal, p, m = sum(c * (c - 1) / 2 for c in Counter(at).values()), 1 / k, n * (n - 1) / 2
    ps = [gamma(equal, m * p, m * p * (1 - p), m * p * (1 - p) * (1 - 2 * p) + n * (n - 1) * (n - 2) * p * p * (1 - p))]
    counts = [len(re.findall(c, body)) for c in ("[0-9]", "[A-Z]", "[a-z]", "[^0-9A-Za-z]")]
    cells = [(c, n * w / k) for c, w in zip(counts, secrets.SHARES[name]) if w]
    ps.append(gamma(sum((c - e) ** 2 / e for c, e in cells), len(cells) - 1, 2 * (len(cells) - 1), 8 * (len(cells) - 1)))
    high = sum(2 * x > k for x in at)
    runs = 1 + sum((2 * x > k) != (2 * y > k) for x, y in zip(at, at[1:]))
    expected = 2 * high * (n - high) / n + 1
    spread = max(0, (expected - 1) * (expected - 2) / (n - 1)) ** 0.5
    ps.append(2 * tail(abs(runs - expected) / spread if 0 < high < n and spread else 10))
    mean = sum(at) / n
    around = sum((x - mean) ** 2 for x in at)
    lag = sum((x - mean) * (y - mean) for x, y in zip(at, at[1:]))
    ps.append(2 * tail(abs(lag / around * n**0.5 + n**-0.5) if around else 10))
    return 1 - (1 - min(1, *ps)) ** 4


def random_tokens(rng, n):
    alphabets = list(secrets.ALPHABETS.values())
    return ["".join(rng.choice(list(alphabets[k % len(alphabets)]), int(rng.integers(20, 60)))) for k in range(n)]


def identifiers(rng, n):
    """CamelCase names and slugs that end in digits."""
    words = "get user account handler service factory default message buffer config request response table index parser stream client server value event".split()
    out = []
    for k in range(n):
        w = rng.choice(words, 5)
        out.append(("".join(x.title() for x in w) if k % 2 else "-".join(w)) + str(rng.integers(1, 10**4)))
    return out


def test_battery_against_plain_form(spark):
    rng = np.random.default_rng(7)
    tokens = random_tokens(rng, 60) + identifiers(rng, 40) + ["a" * 30 + "1", "0123456789abcdef" * 3, "ABCDEFGH234567ABCDEFGH"]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.p_value(F.col("t")).alias("p")).collect()
    assert all(r.p == pytest.approx(plain_p(r.t), abs=2e-5) for r in got)


def test_battery_p_is_about_even_and_tells_names_from_keys(spark):
    rng = np.random.default_rng(8)
    keys = ["".join(rng.choice(list(secrets.ALPHABETS[a]), n)) for a in secrets.ALPHABETS for n in (20, 32, 64) for _ in range(60)]
    p = np.array([plain_p(t) for t in keys])
    assert all(abs((p > c).mean() - (1 - c)) < 0.12 for c in (0.1, 0.5, 0.8))
    names = np.array([plain_p(t) for t in identifiers(rng, 400)])
    assert (names > 0.5).mean() < 0.02
    rows = [(i, f"see {t} there") for i, t in enumerate(keys + identifiers(rng, 2000))]
    out = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    eligible = [i for i, t in enumerate(keys) if re.search("[0-9]", t) and re.search("[A-Za-z]", t)]
    assert np.mean([len(out[i]) > 0 for i in eligible]) > 0.9  # hex of 24 and more is found by its pattern
    alarms = sum(len(out[i]) > 0 for i in range(len(keys), len(rows)))
    assert alarms <= 0.1 * (alarms + len(eligible))


def test_thresholds_by_estimated_false_discoveries():
    even = {c: 50 for c in range(1, secrets.CLASSES + 1)}
    assert secrets.limit_of(even, 0.05) == 1
    few = dict.fromkeys(range(1, 11), 400)  # structured tokens below p = 0.05
    c = secrets.limit_of({k: even[k] + few.get(k, 0) for k in even}, 0.05)
    above = sum(v for k, v in even.items() if k >= c), sum(v for k, v in few.items() if k >= c)
    assert c > 1 and above[1] <= 0.06 * sum(above) and secrets.limit_of(even | {c - 1: 4000}, 0.05) >= c
    assert secrets.limit_of({}, 0.05) == secrets.CLASSES + 1 == secrets.limit_of({0: 9}, 0.05)


def test_many_matches_in_one_text(spark):
    """Thousands of matches of each kind, overlapping ones among them: positions and masks as in the plain form."""
    rng = np.random.default_rng(9)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 26)) for _ in range(1500)]
    text = " é ".join(f"{x} token={x[:9]} AKIA{'Z9' * 9} v1/ab-{x[:5]}Q{x[5:15].upper()}xY{x[16:24]}" for x in hexes)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = secrets.scan(df).first()
    assert [(s.start, s.kind, s.end) for s in r.spans if s.kind < 3] == plain_secrets(text)
    spans, at, out = [(s.start, s.end) for s in r.spans], 0, []
    for a, z in spans:
        if a >= at:
            out += [text[at:a], "[REDACTED]"]
        at = max(at, z)
    assert secrets.redacted(df).first().text == "".join(out) + text[at:]


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 1200
    rows = [(0, "http://a/", "x" * 999), (1, "http://b/", "x" * 999), (2, "http://c/", big), (5, None, big), (9, "http://d/\r\nX: 1", big), (3, "http://e/", None), (4, "http://f/", "WARC/1.1\r\n\r\n" * 100), (None, "http://g/", big), (2, "http://c/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for size in (warc.CHUNK_BYTES, 100):
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.error) for r in warc.archive_and_read(pages, chunk_bytes=size).collect())
        expected = Counter()
        for i, _, h in rows:
            b = (h or "").encode()
            again = h == big and i != 9
            expected[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 9 if again else None, None] += 1
        assert got == expected
    chunks = warc.chunk_table(pages, archives=1, chunk_bytes=100)
    assert chunks.where("chunks > 1").count() > 10
    path = str(tmp_path / "a.warc")
    size = warc.export_warc(chunks, 0, path)
    back = list(warc.read_warc_file(path, 64))
    assert size > 0 and len(back) == len(rows) and all(r[-1] is None for r in back)
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-30])
    assert any(r[-1] for r in warc.read_warc_file(path, 64))
    assert warc.archive_and_read(pages.limit(0)).collect() == []


def test_sharding(spark, docs, rows, empty):
    out = sharding.assign(docs, shards=5).collect()
    assert len(out) == len(rows)
    slots, where, size = defaultdict(list), defaultdict(set), Counter()
    text = defaultdict(list)
    for i, t, _ in rows:
        text[i].append(t or "")
    for r in out:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
        match = [t for t in text[r.doc_id] if zlib.crc32(t.encode()) == r.text_crc32 and len(t.encode()) + 8 == r["size"]]
        assert match
        where[match[0]].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, where.values())) == 1
    assert sharding.assign(empty).collect() == []


def plain_best_fit(sizes, bins, capacity):
    free, out = [capacity] * bins, []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(free) if r >= s]
        if not fits:
            return None
        b = min(fits)[1]
        free[b] -= s
        out.append(b)
    return out


def spread(runs):
    return [b for n, b in runs for _ in range(n)]


def test_best_fit_decreasing():
    one = lambda sizes: sorted(Counter(sizes).items(), reverse=True)
    assert spread(sharding.best_fit_decreasing(one([6, 5, 4, 3, 2]), 2, 10)) == [0, 1, 0, 1, 1]
    assert sharding.best_fit_decreasing(one([6, 6]), 1, 10) is None
    rng = np.random.default_rng(2)
    for most, bins in ((1000, 7), (12, 5), (40, 24)):
        sizes = sorted(rng.integers(1, most, 500).tolist(), reverse=True)
        for capacity in (sum(sizes) // bins, sum(sizes) // bins + 3, sum(sizes) // bins + most):
            got = sharding.best_fit_decreasing(one(sizes), bins, capacity)
            assert (None if got is None else spread(got)) == plain_best_fit(sizes, bins, capacity)
        load = Counter()
        for s, b in zip(sizes, spread(sharding.pack(one(sizes), bins)), strict=True):
            load[b] += s
        assert max(load.values()) <= 1.01 * sum(sizes) / bins + 1
    assert spread(sharding.pack(one([10**6, 5, 5, 4, 4]), 3)) in ([0, 1, 2, 1, 2], [0, 1, 2, 2, 1])
    assert spread(sharding.pack(one([9, 9, 9]), 2)) in ([0, 1, 1], [0, 0, 1])


def test_shards_are_nearly_equal_with_hot_groups_and_ids(spark):
    """Whole assignment against the plain form: equal sizes are interchangeable, so loads must be equal."""
    rng = np.random.default_rng(4)
    texts = ["hot " * 9] * 40 + ["x" * int(n) for n in rng.integers(0, 60, 500)] + [f"{k:04d}" for k in range(700)]
    rows = [(None if k % 3 else int(k % 50), t, 1, "s") for k, t in enumerate(texts)] + [(None, None, 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, _group string").repartition(5)
    out = sharding.assign(df, shards=6).collect()
    slots, load, sizes = defaultdict(list), Counter(), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert len(out) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    for _, t, *_ in rows:
        sizes[t or ""] += len(t or "") + 8
    groups = sorted(sizes.values(), reverse=True)
    capacity = next(c for c in range(-(-sum(groups) // 6), sum(groups)) if plain_best_fit(groups, 6, c))
    plain = Counter()
    for s, b in zip(groups, plain_best_fit(groups, 6, capacity)):
        plain[b] += s
    assert sorted(load.values()) == sorted(plain.values())
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(groups) / 6 + 8


def test_language_id(docs, rows, empty):
    model = langid.fit(docs)
    out = langid.predict(docs.select("doc_id", "text", "score"), model).collect()
    assert len(out) == len(rows)
    known = {t: l for _, t, l in rows if t and l and len(t) > 100 and not t.startswith(("é", "ab"))}
    good = [r.lang_pred == known[r.text] for r in out if r.text in known]
    assert sum(good) / len(good) > 0.8
    for r in out:
        assert 0 <= r.score <= 1
        if r.text is None or not re.search(r"[^\W\d_]", r.text):
            assert r.lang_pred == "und" and r.rejected
        else:
            assert r.lang_pred in model.langs
    assert langid.fit(empty) is None
    assert all(r.lang_pred == "und" for r in langid.predict(docs.select("doc_id", "text"), None).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_language_id_on_held_out_rows(spark):
    """Accuracy on rows that never train; real text is kept, the same text with its characters in disorder is rejected."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    held = docs.where(langid.held_out() & F.col("lang").isNotNull() & (F.length("text") >= 100))
    out = langid.predict(held, model).collect()
    assert len(out) > 50 and np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert np.mean([r.rejected for r in out]) <= 0.02
    rng = np.random.default_rng(1)
    noise = [(k, "".join(rng.permutation(list(r.text[:3000])))) for k, r in enumerate(out)]
    mixed = langid.predict(spark.createDataFrame(noise, "doc_id long, text string"), model).collect()
    assert np.mean([r.rejected for r in mixed]) > 0.9
    assert 0.005 < model.temperature < 5 and 0 < model.floor < 1


def test_language_id_never_learns_from_held_out_rows(docs, rows):
    """Rows that are held out may say anything: the model is the same."""
    ids = {i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    other = docs.withColumn("lang", F.when(F.col("doc_id").isin(*ids), F.lit("xx")).otherwise(F.col("lang")))
    one, two = langid.fit(docs, epochs=1, least_steps=1), langid.fit(other, epochs=1, least_steps=1)
    assert "xx" not in two.langs and np.array_equal(one.logits, two.logits) and one.floor == two.floor


def test_packing(spark, docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    odd = ["two  blanks", " lead", "trail ", "a\n b", "a\r b", "<|endoftext|> x", "don't  stop\n\n now", "x " * 3000]
    more = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    for shard in (2048, 10):
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in packing.pack(both, path, per_shard=shard).collect():
            pieces[r.doc_id, r.doc_tokens].append(r)
            sequences[r.sequence_id].append((r.offset, r.length))
        for seq in sequences.values():
            at = 0
            for offset, length in sorted(seq):
                assert offset == at
                at += length
            assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
        for i, x in [*((i, x) for i, x, _ in rows if i != 7), *((1000 + i, x) for i, x in enumerate(odd))]:
            ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
            at = 0
            for r in sorted(pieces[i, len(ids)], key=lambda r: r.start):
                assert r.start == at and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
                at += r.length
            assert at == len(ids)
    assert packing.pack(empty, path).collect() == []


def test_ids_are_those_of_a_plain_call():
    """Strings of every kind: the cached pieces and the twin against the tokenizer's own call."""
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    plain, encoder = tokenizers.Tokenizer.from_file(path), packing.Encoder(path)
    rng = np.random.default_rng(12)
    letters = [*"abcdefghijklmnopqrstuvwxyzABCDE", *"0123456789", *"éßñçüøæ", *"  \n\t\r", *".,;:!?'\"-_/|#$%&*<>", "\u00a0", "\u3000", "字", "🙂", "\u0301", "<|endoftext|>", "'s", " the", "tion"]
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(3000)] + ["a" * 500 + " " + "b" * 70, "<|endoftext|>", "x <|endoftext|> y", "<|endof text|>"]
    for x in texts * 2:
        assert np.frombuffer(encoder.encode(x), np.uint16).tolist() == plain.encode(x, add_special_tokens=False).ids, x
    assert encoder.twin is not None and max(map(len, encoder.cache)) <= packing.LONGEST
    encoder.twin = type("Wrong", (), {"encode_ordinary": lambda self, text: [1]})()
    with pytest.raises(RuntimeError):
        for k in range(1000):
            encoder.ids(f"never seen {k}")


def test_texts_are_encoded_many_at_a_time():
    """Ids of runs of texts against the tokenizer's own calls; words that occur in several texts are merged once, many in one call."""
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    plain, encoder = tokenizers.Tokenizer.from_file(path), packing.Encoder(path)
    rng = np.random.default_rng(13)
    marks = [*"abcdefgh019", "éß", "字", "🙂", ",", ".\n", "'s", "\r", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "<|endoftext|>"]
    words = ["".join(rng.choice(marks, int(rng.integers(1, 6)))) for _ in range(400)] + ["", "x" * 500]
    clean = [w for w in words if w and w == w.strip() and "<" not in w]
    texts = [" ".join(rng.choice(clean if k % 3 else words, int(rng.integers(0, 30)))) for k in range(2000)] + [None, "", " ", "one", "<|endoftext|>"]
    for lo in [*range(0, len(texts), 300), 0]:
        some = texts[lo : lo + 300]
        flat, at = encoder.encode_all(pa.array(some))
        assert at[0] == 0 and at[-1] == len(flat) and len(at) == len(some) + 1
        for x, a, z in zip(some, at, at[1:]):
            assert flat[a:z].tolist() == plain.encode(x or "", add_special_tokens=False).ids, x
    assert encoder.words[0].as_py() == "" and max(map(len, encoder.words.to_pylist())) <= packing.LONGEST
    calls, ids = [], encoder.ids
    encoder.ids = lambda text: calls.append(text) or ids(text)
    encoder.encode_all(pa.array([f"one word{k} more of {k % 7}" for k in range(1000)]))
    assert len(calls) <= 5 and sum(text.count(" word") for text in calls) == 1000 and sum(text.count(" more") for text in calls) <= 1
    encoder.encode_all(pa.array(["one word5 more of 3"]))
    assert len(calls) <= 5
    assert [len(x) for x in packing.text_runs(pa.RecordBatch.from_arrays([pa.nulls(4), pa.array(["aa", None, "bbbb", "c" * 9])], names=["doc_id", "text"]), 6)] == [3, 1]
    encoder.sizes = encoder.sizes * 0
    with pytest.raises(RuntimeError):
        encoder.encode_all(pa.array(["a b qx"]))


def test_repeated_null_rows_are_dealt_over_fill_tasks(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rows = [(None, "the same text again and again")] * 900 + [(k, f"word{k} other{k * 7} text") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    tokens = packing.written(packing.tokenised(df, path, 1024, 0), "tokens")
    sizes = packing.sharded(tokens, packing.stats_of(tokens), 100).groupBy("shard").count().collect()
    assert len(sizes) >= 8 and max(r["count"] for r in sizes) <= 250


def test_retrieval_prefers_related_neighbours():
    ids = [np.array(x, np.uint16) for x in ([1] * 5 + [7, 8, 9], [1] * 6 + [20, 21], [7, 8, 9, 30, 31], [1] * 4 + [40])]
    index = packing.Index(ids)
    assert index.neighbours(0, np.zeros(4, bool))[0] == 2
    assert 2 not in index.neighbours(0, np.array([False, False, True, False]))


def test_packing_holds_little_beside_its_rows(spark):
    """Counts travel in one byte where they fit, an index takes few bytes a posting while it is made, and workers drop what a later step doesn't need."""
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    texts = [(0, "one two two"), (1, "a " * 300 + "b"), (2, None), (3, " ".join(["x"] * 255)), (4, " ".join(["y"] * 257))]
    got = {r.doc_id: r for r in packing.tokenised(spark.createDataFrame(texts, "doc_id long, text string"), path, 1024, 0).collect()}
    plain = packing.Encoder(path)
    for i, x in texts:
        want, found = packing.bag_of(np.frombuffer(plain.encode(x or ""), np.uint16)), packing.bag_from(got[i].terms, got[i].counts)
        assert all(np.array_equal(a, b) for a, b in zip(want, found, strict=True))
    assert [len(got[i].counts) // max(1, len(got[i].terms) // 2) for i in range(5)] == [1, 4, 0, 1, 4]

    rng = np.random.default_rng(14)
    bags = [packing.bag_of((rng.zipf(1.3, 500) % 50_000).astype(np.uint16)) for _ in range(1000)]
    tracemalloc.start()
    packing.Index(bags, packing.Stats(1000, 500.0, np.ones(65536)))
    most = tracemalloc.get_traced_memory()[1] / sum(len(t) for t, _ in bags)
    tracemalloc.stop()
    assert most < 70

    packing.worker_encoder(path)
    packing.likeness([bags[0][0]], [bags[0][1]], packing.Stats(1, 1.0, np.ones(65536)))
    assert {"_lakeleaf_encoders", "_lakeleaf_projection"} <= set(sys.modules)
    packing.forget("encoders", "projection")
    assert not {"_lakeleaf_encoders", "_lakeleaf_projection"} & set(sys.modules)


def test_retrieval_uses_all_terms_of_whole_documents():
    # 30 rarer terms shared with nobody but a decoy each; the true neighbour shares 200 commoner ones
    rare, common = np.arange(100, 130), np.arange(1000, 1200)
    ids = [np.concatenate([rare, common]), common, *([r, 5000 + r] for r in rare), *(common[:100] + 0 for _ in range(3))]
    index = packing.Index([np.array(x, np.uint16) for x in ids])
    assert index.neighbours(0, np.zeros(len(ids), bool))[0] == 1 and len(index.neighbours(0, np.zeros(len(ids), bool))) == len(ids) - 1
    # rests share nothing, the documents' other windows do
    rests = [np.array(x, np.uint16) for x in ([1] * 6, [2] * 6, [3] * 6)]
    bags = [packing.bag_of(np.array(x, np.uint16)) for x in ([1, 8, 9], [2, 5, 6], [3, 8, 9])]
    assert [d for d, _, _ in packing.fill(rests, 12, bags)[0]] == [0, 2]


def test_packing_brings_related_documents_together(spark):
    public = pytest.importorskip("public_tokenizers")
    rng = np.random.default_rng(8)
    topics = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(40)] for _ in range(30)]
    texts = [(20 * k + j, " ".join(rng.choice(topics[k], 60))) for j in range(20) for k in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    path = public.path("byte_bpe_50k.json")
    rows = packing.tokenised(df, path, 1024, 0)
    placed = packing.sharded(rows, packing.stats_of(rows), 40).select("doc_id", "shard").collect()
    shards = defaultdict(Counter)
    for r in placed:
        shards[r.doc_id // 20][r.shard] += 1
    assert len({r.shard for r in placed}) >= 10
    assert np.mean([max(c.values()) / 20 for c in shards.values()]) > 0.9


def test_quality(spark, docs, rows, empty):
    junk = [(1000 + i, " ".join(f"w{k}$$$" for k in range(60 + i)), 0) for i in range(40)]
    good = [(2000 + i, " ".join(f"w{k}" for k in range(60 + i)), 1) for i in range(120)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([x[:2] for x in junk + good], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in junk + good], "doc_id long, quality int, toxic int")
    out = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.judged(both, labels).collect()}
    texts = [(i, t or "") for i, t, _ in rows] + [x[:2] for x in junk + good]
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        r = out[i, len(w), sum(map(len, w))]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        if i is not None and 1000 <= i < 2000:
            assert not r.kept
        if i is not None and i >= 2000:
            assert r.kept
    assert quality.judged(empty, labels).collect() == []
    assert all(r.rule == 0 for r in quality.judged(both, labels.limit(0)).collect())


def test_equal_hashes_of_different_windows_do_not_count(spark, rows):
    """All windows get one of three hashes, so collisions interleave with real repeats."""
    texts = [(i, t) for i, (_, t, _) in enumerate(rows) if t and len(t) < 2000] + [(900, "a b c x a b c y a b c"), (901, "ab c d a bc d ab c d")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.statistics(df, window_hash=lambda *w: F.xxhash64(*w) % 3).collect()}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:]))
        assert got[i] == len({k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}), t


def test_rules_hold_on_rows_that_did_not_train():
    rng = np.random.default_rng(3)

    def sample(n):
        bad = rng.random(n) < 0.15
        kind = rng.integers(0, 2, n)
        table = {f: rng.random(n) for f in quality.FEATURES}
        table["symbol_ratio"] = np.where(bad & (kind == 0), rng.uniform(0.2, 0.4, n), rng.uniform(0, 0.05, n))
        table["repeat_ratio"] = np.where(bad & (kind == 1), rng.uniform(0.7, 1, n), rng.uniform(0, 0.3, n))
        return table, bad

    for n in (120, 3000):
        rules = quality.learn(*sample(n))
        table, bad = sample(5000)
        hit = np.zeros(5000, bool)
        for r in rules:
            hit |= quality._covers(r, table, np.ones(5000, bool))
        assert (hit & bad).sum() >= 0.95 * bad.sum() and (hit & ~bad).sum() <= 0.02 * hit.sum()
    # a conjunction: neither condition alone is precise
    table = {f: rng.random(4000) for f in quality.FEATURES}
    bad = (table["bang_ratio"] > 0.6) & (table["mean_word"] < 0.5)
    hit = np.zeros(4000, bool)
    for r in quality.learn(table, bad):
        hit |= quality._covers(r, table, np.ones(4000, bool))
    assert (hit & bad).sum() >= 0.8 * bad.sum() and (hit & ~bad).sum() <= 0.02 * hit.sum()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_quality_verdict_on_held_out_labels(spark):
    """Learn from four fifths of the labels; precision and recall on the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = quality.judged(docs, labels.where(~held)).join(labels.where(held).select("doc_id", "quality"), "doc_id").collect()
    assert sum(r.rule > 0 for r in out) > 0
    bad = [r for r in out if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
    assert sum(r.rule > 0 and r.quality == 1 for r in out) <= 0.02 * len(out)


def test_long_text_statistics(spark):
    text = "\n".join(f"word{k % 997} other{k % 89} | {k}" for k in range(40_000))
    r = quality.statistics(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_words == 160_000 and r.n_symbols == 40_000 and r.n_dup_lines == 0


def test_decontamination(spark, docs, empty):
    item = "Quarx zelbo fintal murpo dreska volin tharb ankeso brillo gantz. Wolpe syndra kelt morvan ispil tragon."
    near = item.replace("murpo", "changed").upper()
    para = " ".join(w for k, w in enumerate(item.split(". ")[0].split()) if k % 3) + " filler. " + item.split(". ")[1]
    pad = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua " * 3
    texts = {5000: pad + item + " " + pad, 5001: pad + near + pad, 5002: pad + para + " " + pad, 5003: pad, 5004: "murpo " + pad + " volin"}
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(more, bench).collect()}
    assert got == {(5000, 1), (5001, 1), (5002, 1)}
    kept = decontaminate.clean(more, bench)
    assert kept.columns == more.columns and kept.count() == more.count() - 3
    assert decontaminate.matches(empty, bench).collect() == [] == decontaminate.matches(more, bench.limit(0)).collect()
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.matches(more, bench, block=1).collect()}
    assert blocks == got


def test_decontamination_finds_all_that_verification_accepts(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(4000)]
    prose = lambda n: list(rng.choice(words[2000:], n))
    item = words[:60]
    short = words[100:115]
    rare = words[500:2000]
    texts = [" ".join([*prose(40), *item, *prose(40)]) for _ in range(300)]  # nearly all documents hold the item: its terms weigh little
    # three fifths of its words, spread, straddling passages at any place; rare words around them weigh much
    for k in range(40):
        kept = [w for j, w in enumerate(item) if j % 5 not in (1, 3)]
        texts.append(" ".join([*rng.choice(rare, k * 3 + 60), *kept, *rng.choice(rare, 90)]))
    # a short item's lighter words, in order: its heavier ones, which no document has, are changed
    light = [w for j, w in enumerate(short) if j % 5 not in (1, 3)]
    texts += [" ".join([*prose(60), *light]) for _ in range(60)]
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    ).collect()}
    assert found == {(k, 1) for k in range(340)} | {(k, 2) for k in range(340, 400)}


def plain_matches(texts, items, lcs=0.6, lcs_answer=0.45, answer=0.8):
    """Every item against every window of every text."""
    out = set()
    for d, t in texts:
        words = decontaminate.words_of((t or "").lower())
        for i, x in items:
            own = decontaminate.words_of(x.lower())
            reply = decontaminate.answer_of(x.lower())
            size = max(len(own) + len(own) // 4, len(own) + 2)
            for a in range(max(1, len(words) - size + 1)):
                window = words[a : a + size]
                share = decontaminate.common_subsequence(own, window) / len(own)
                if share >= lcs or share >= lcs_answer and decontaminate.common_subsequence(reply, window) / max(1, len(reply)) >= answer:
                    out.add((d, i))
                    break
    return out


def test_decontamination_against_brute_force(spark):
    """Paraphrases by substitution, deletion and insertion: nothing beyond brute force, and at least nine tenths of it."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmno"), int(rng.integers(2, 7)))) for _ in range(600)]
    weight = 1 / np.arange(1, 601)
    prose = lambda n: list(rng.choice(vocabulary, n, p=weight / weight.sum()))
    items = []
    for i in range(25):
        w = prose(int(rng.integers(12, 50)))
        w[len(w) * 2 // 3] += "."
        items.append((i, " ".join(w)))
    texts = [(k, " ".join(prose(int(rng.integers(0, 120))))) for k in range(60)]
    for k in range(240):
        w = items[k % 25][1].split()
        keep = rng.choice([0.5, 0.65, 0.8, 0.95])
        changed = [x if rng.random() < keep else y for x in w for y in (prose(1) if k % 2 else [""])[:1]]
        texts.append((100 + k, " ".join([*prose(int(rng.integers(0, 60))), *changed, *prose(int(rng.integers(0, 60)))])))
    texts += [(None, texts[70][1]), (None, "a b"), (100, texts[3][1]), (500, None), (501, "")]
    docs = spark.createDataFrame([(*x, "x", 0.5) for x in texts], "doc_id long, text string, text_hash string, cosine double").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    want = plain_matches(texts, items)
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 100
    some = decontaminate.matches(docs, bench, block=5)
    again = {(r.doc_id, r.item_id) for r in some.collect()}
    assert again <= want and len(again) >= 0.9 * len(want)
    kept = decontaminate.clean(docs, bench)
    hits = {(r.doc_id, r.text_hash) for r in decontaminate.matches(docs, bench).collect()}
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((r.doc_id, r.text) for r in rows if (r.doc_id, r.h) not in hits), key=repr)
    assert (None, "a b") in {(r.doc_id, r.text) for r in kept.collect()}


def test_verification_accepts_any_window():
    item, answer = [b"%d" % k for k in range(40)], [b"%d" % k for k in range(32, 40)]
    words = item[:20] + [b"x"] * 100 + item[20:39]  # most of the item in the first window, the answer in the last
    assert decontaminate.verified(item, answer, words, 0.45, 0.6, 0.8)[:2] == (19 / 40, 7 / 8)


def test_longest_common_subsequence():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (rng.integers(0, 4, rng.integers(0, 20)).tolist() for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == plain(a, b)


@pytest.fixture(scope="module")
def terse(spark):
    """5000 documents of a few of the items' words each, many of them alike; the items; and how many different passages they have."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(40)]
    texts = [" ".join(rng.choice(words, 1 + k % 5)) for k in range(5000)]
    items = [" ".join(words[k : k + 30]) for k in (0, 5, 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), len({tuple(sorted(t.split())) for t in texts + items})


@pytest.fixture()
def rows_decomposed(monkeypatch):
    counts, svd = [], decontaminate.randomised_svd

    def counted(rows, *args, **options):
        counts.append(rows.count())
        return svd(rows, *args, **options)

    monkeypatch.setattr(decontaminate, "randomised_svd", counted)
    return counts


def test_latent_space_is_of_all_passages(terse, rows_decomposed):
    docs, bench, passages = terse
    assert decontaminate.matches(docs, bench).count() == 0
    assert rows_decomposed == [passages]


def test_pipelines_latent_space_is_of_all_passages(spark, terse, rows_decomposed, tmp_path):
    import corpus_pipeline

    docs, bench, passages = terse
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)["benchmark_decontamination"]
    assert stage(spark, docs, str(tmp_path)).count() == docs.count()
    assert rows_decomposed == [passages]


@pytest.mark.parametrize("columns", [30, 17])
def test_product_of_passages(columns):
    """Entries and products of packed passages against plain matrices, with hashed columns and columns taken as a dense block."""
    rng = np.random.default_rng(columns)
    known = decontaminate.Dictionary(np.arange(30, dtype=np.uint64))
    idf = rng.random(30) * (np.arange(30) != 4)
    slots = [np.sort(rng.integers(0, 30, n)) for n in rng.integers(1, 12, 50)] + [np.array([4, 4])]
    plain = np.zeros((len(slots), columns))
    for k, x in enumerate(slots):
        np.add.at(plain[k], x % columns, idf[x])
    norm = np.sqrt((plain * plain).sum(1, keepdims=True))
    plain /= np.where(norm > 0, norm, 1)
    q = rng.standard_normal((columns, 5))
    batch = pa.RecordBatch.from_arrays([pa.array([x.astype(np.uint16).tobytes() for x in slots], pa.binary())], names=["passage"])
    for common in ([], [0, 3, 16], range(columns)):
        z = np.zeros_like(q)
        for part in (batch.slice(0, 20), batch.slice(20)):
            decontaminate.add_product(z, q, np.array(common, np.int64), *decontaminate.passage_entries(known, idf, columns)(part), step=7)
        assert np.allclose(z, plain.T @ (plain @ q))


def test_randomised_svd(spark):
    rng = np.random.default_rng(4)
    m = rng.random((30, 50)) * (rng.random((30, 50)) < 0.3)
    rows = spark.createDataFrame([([int(j) for j in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) for r in m], "at array<int>, weight array<double>").repartition(3)
    basis, values = decontaminate.randomised_svd(rows, 50, 38, block=16)
    want = np.linalg.svd(m, compute_uv=False) ** 2
    assert np.allclose(values[:10], want[:10], rtol=1e-6) and np.allclose(basis.T @ basis, np.eye(38), atol=1e-8)


def test_pipeline(spark, docs, tmp_path):
    pytest.importorskip("tokenizers")
    import corpus_pipeline

    clean = docs.select("doc_id", "text", "lang", "source", "n_chars", "spans", "score")
    clean.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zz yy xx ww vv uu tt ss rr qq")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == clean.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r.doc_id for r in now.collect()}
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed == kept and 0 < len(kept) < docs.count()
    assert F is not None
