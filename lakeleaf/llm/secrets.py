"""Secret scans by patterns and by a battery of randomness tests, in SQL functions only.

Patterns (fixed rules): assignments of a credential, access keys, long hex. The battery adds spans: tokens of
at least ``MIN_TOKEN`` characters that hold a letter and a digit (the longest runs in base64 and in base64url, so each
is cut at the other's characters, and ``=`` is kept as trailing padding only) get an encoding (hex, base32, base62, base64,
base64url) by the characters they use. Under the hypothesis that the characters are drawn evenly from that
alphabet, four tests give p-values: chi-squared over single characters (its tail by a gamma law that has the statistic's exact
mean, variance and skewness at this length, since a cell expects less than one character), chi-squared over classes (digits,
upper case, lower case, others), the number of runs above and below the alphabet's middle, and lag-one serial
correlation. The least of the four, p, becomes 1 - (1 - p)^4, which is about even for random tokens.

A token is reported as random if p exceeds its band's threshold. Structured text has small p, random text even p, so within each band of
lengths the number of random tokens is estimated from those with p above one half, and the share of structured tokens among all
above a threshold is what is there beyond the random tokens' even share. The threshold is the least for which that share, the
estimated false-discovery rate of the alarms, stays below ``q`` (and twice the root of their number, the estimate's own spread); what p rejects at 0.001 is never reported. The counts by band
and class of p, of distinct tokens, cover the whole table and are a bounded number of rows.

The battery also judges what the patterns found: ``n_even`` counts the base spans whose value it takes for random.

Positions are code points, end exclusive. Matches of a pattern are leftmost and do not overlap; battery spans
that overlap a pattern's span are left out. Positions and overlaps are folded in blocks of ``BLOCK`` matches, so a text's cost grows
with its matches, not with their square. Defined cases: null or empty text has no span; null and repeated
doc_ids are rows like any other; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeleaf.llm.common import written

# The pattern rules.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_TOKEN = 20
# Longest runs in base64 and in base64url; "=" only as trailing padding.
TOKENS = tuple(rf"(?<![{c}])[{c}]{{20,}}(?![{c}])(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?" for c in ("A-Za-z0-9+/", "A-Za-z0-9_-"))
KINDS = ("assign", "access", "hex", "random")
# Alphabets by encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
# Characters of each class by encoding: digits, upper case, lower case, others.
SHARES = {"hex": (10, 0, 6, 0), "HEX": (10, 6, 0, 0), "base32": (6, 26, 0, 0), "base62": (10, 26, 26, 0), "base64": (10, 26, 26, 2), "base64url": (10, 26, 26, 2)}
BANDS = (20, 28, 36, 48, 64, 96)
CLASSES = 200
#: The smallest p that is ever reported.
FLOOR = 0.001
#: The p above which a pattern's value counts as random.
EVEN = 0.01
BLOCK = 128

_SPAN = "array<struct<start:int,kind:int,end:int,token:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def folded(items: Column, state: Column, step, out_type: str) -> Column:
    """The array that ``step(state, item) -> (state, out)`` gives, out null for nothing; blocks of items keep the copying of arrays short."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))

    def inner(before, block):
        begin = F.struct(before.alias("s"), F.array().cast(f"array<{out_type}>").alias("out"))

        def one(acc, x):
            return once(F.struct(*[c.alias(n) for c, n in zip(step(acc["s"], x), ("s", "o"))]), lambda r: F.struct(r["s"].alias("s"), F.when(r["o"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(r["o"]).cast(f"array<{out_type}>"))).alias("out")))

        return F.aggregate(block, begin, one)

    def outer(acc, block):
        return once(inner(acc["s"], block), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(state.alias("s"), F.array().cast(f"array<array<{out_type}>>").alias("out"))
    return F.when(F.size(items) > 0, F.aggregate(blocks, start, outer, lambda acc: F.flatten(acc["out"]))).otherwise(F.array().cast(f"array<{out_type}>"))


_STRUCT = _SPAN[len("array<") : -1]


def match_spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, hint: Column | None = None) -> Column:
    """Spans of all matches of ``pattern``, from the matches and the pieces between them; ``least``: characters that ``group`` must have."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("gap"), found.alias("hit"), inner.alias("in"))

    def step(at, x):
        begin = at + x["gap"]
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["in"].alias("token"))
        return end, F.when(x["hit"].isNotNull() & (F.length(x["in"]) >= least), span)

    return F.when(text.rlike(pattern) if hint is None else hint, once(zipped, lambda z: folded(z, F.lit(0), step, _STRUCT))).otherwise(_none())


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of ``others``; by one pass in the order of starts from each side, which keeps how far others reach."""
    slim = lambda c, own: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), s["kind"].alias("kind"), s["token"].alias("token")))
    both = F.sort_array(F.concat(slim(spans, True), slim(others, False)))
    type_ = "struct<start:int,end:int,own:boolean,kind:int,token:string>"

    def forward(reach, s):  # others that begin before, or with it
        return F.when(s["own"], reach).otherwise(F.greatest(reach, s["end"])), F.when(~s["own"] | (reach <= s["start"]), s)

    def backward(reach, s):  # others that begin after, or with it
        return F.when(s["own"], reach).otherwise(F.least(reach, s["start"])), F.when(s["own"] & (reach >= s["end"]), s)

    some = once(both, lambda z: folded(z, F.lit(0), forward, type_))
    kept = once(F.reverse(some), lambda z: folded(z, F.lit(2**31 - 1), backward, type_))
    out = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["token"].alias("token"))).cast(_SPAN)
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(out)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, within 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    # Polynomial of a published approximation.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-z * z / 2) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding(token: Column) -> Column:
    body = F.rtrim(token, F.lit("="))
    return (
        F.when(body.rlike("^[0-9a-f]+$"), "hex")
        .when(body.rlike("^[0-9A-F]+$"), "HEX")
        .when(body.rlike("^[A-Z2-7]+$"), "base32")
        .when(body.rlike("^[A-Za-z0-9]+$"), "base62")
        .when(body.rlike("^[A-Za-z0-9+/]+$"), "base64")
        .when(body.rlike("^[A-Za-z0-9_-]+$"), "base64url")
    )


def gamma_score(x: Column, mean: Column, variance: Column, third: Column) -> Column:
    """The normal score of x under a shifted gamma law with these moments, by the cube-root form."""

    def score(s):
        ratio = F.greatest(F.lit(1e-9), 1 + s["x"] * s["skew"] / 2)  # s.x: x in standard deviations from the mean
        shape = 4 / (s["skew"] * s["skew"])
        return (F.pow(ratio, F.lit(1 / 3)) - 1 + 1 / (9 * shape)) * 3 * F.sqrt(shape)

    return once(variance, lambda v: once(F.struct(((x - mean) / F.sqrt(v)).alias("x"), (third / F.pow(v, F.lit(1.5))).alias("skew")), score))


def p_value(token: Column) -> Column:
    """The battery's p-value under even random characters; null if the token fits no encoding."""
    body = F.rtrim(token, F.lit("="))
    name = encoding(token)
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), name)
    shares = F.element_at(F.create_map(*[x for k, v in SHARES.items() for x in (F.lit(k), F.array(*[F.lit(float(y)) for y in v]))]), name)

    def counted(s: Column) -> Column:
        at, k, n, body = s["at"], s["k"], s["n"], s["body"]
        # pairs of equal characters; chi-squared over characters is a rising function of their number
        equal = F.aggregate(F.transform(F.array_distinct(at), lambda c: F.size(F.filter(at, lambda x: x == c)).cast("double")), F.lit(0.0), lambda a, x: a + x * (x - 1) / 2)
        lost = lambda chars: F.length(body) - F.length(F.translate(body, chars, ""))
        kinds = F.struct(lost("0123456789").alias("d"), lost("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("u"), lost("abcdefghijklmnopqrstuvwxyz").alias("l"))
        counts = once(kinds, lambda c: F.array(c["d"], c["u"], c["l"], F.length(body) - c["d"] - c["u"] - c["l"]))
        cells = F.filter(F.arrays_zip(counts.alias("c"), F.transform(s["shares"], lambda w: w * n / k).alias("e")), lambda x: x["e"] > 0)
        chi = F.aggregate(cells, F.lit(0.0), lambda a, x: a + (x["c"] - x["e"]) * (x["c"] - x["e"]) / x["e"])
        pairs = F.arrays_zip(F.slice(at, 1, F.size(at) - 1).alias("a"), F.slice(at, 2, F.size(at) - 1).alias("b"))
        high = F.size(F.filter(at, lambda x: x * 2 > k)).cast("double")
        runs = 1 + F.size(F.filter(pairs, lambda p: (p["a"] * 2 > k) != (p["b"] * 2 > k)))
        mean = F.aggregate(at, F.lit(0.0), lambda a, x: a + x) / n
        free = (F.size(F.filter(s["shares"], lambda w: w > 0)) - 1).cast("double")
        return F.struct(*[c.alias(x) for x, c in (("at", at), ("k", k), ("n", n), ("equal", equal), ("chi", chi), ("free", free), ("pairs", pairs), ("high", high), ("runs", runs), ("mean", mean), ("p", 1 / k), ("m", n * (n - 1) / 2), ("expected", 2 * high * (n - high) / n + 1))])

    def scored(s: Column) -> Column:
        n, p, m, mean = s["n"], s["p"], s["m"], s["mean"]
        z_chi = gamma_score(s["equal"], m * p, m * p * (1 - p), m * p * (1 - p) * (1 - 2 * p) + n * (n - 1) * (n - 2) * p * p * (1 - p))
        z_class = F.when(s["free"] > 0, gamma_score(s["chi"], s["free"], 2 * s["free"], 8 * s["free"])).otherwise(F.lit(-10.0))
        spread = F.sqrt(F.greatest(F.lit(0.0), (s["expected"] - 1) * (s["expected"] - 2) / (n - 1)))
        z_runs = once(spread, lambda d: F.when((s["high"] == 0) | (s["high"] == n) | (d == 0), F.lit(10.0)).otherwise(F.abs(s["runs"] - s["expected"]) / d))
        around = F.aggregate(s["at"], F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        lag = F.aggregate(s["pairs"], F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        z_lag = once(around, lambda d: F.when(d == 0, F.lit(10.0)).otherwise(F.abs(lag / d * F.sqrt(n) + 1 / F.sqrt(n))))
        # the last two have both tails
        tails = F.transform(F.arrays_zip(F.array(z_chi, z_class, z_runs, z_lag).alias("z"), F.array(*[F.lit(x) for x in (1.0, 1.0, 2.0, 2.0)]).alias("sides")), lambda x: upper_tail(x["z"]) * x["sides"])
        return 1 - F.pow(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.array_min(tails))), F.lit(4.0))

    chars = F.transform(F.split(body, ""), lambda c: F.call_function("instr", alphabet, c))
    ready = F.struct(chars.alias("at"), F.length(alphabet).cast("double").alias("k"), F.length(body).cast("double").alias("n"), body.alias("body"), shares.alias("shares"))
    return F.when(name.isNotNull() & (F.length(body) > 2), once(once(ready, counted), scored))


def band(length: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS):
        out = F.when(length >= least, i).otherwise(out)
    return out


def p_class(p: Column) -> Column:
    """Classes of equal width in p, 1 to CLASSES; 0 for p below FLOOR."""
    return F.when(p < FLOOR, F.lit(0)).otherwise(F.least(F.lit(CLASSES), F.floor(p * CLASSES) + 1)).cast("int")


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with _base (spans of the patterns) and _tokens (battery candidates with band and p-value class)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(
        match_spans(text, ASSIGN, 0, 2, 6, text.rlike(ASSIGN_HINT)),
        match_spans(text, ACCESS, 1, hint=text.contains("AKIA")),
        match_spans(text, HEX, 2),
    )
    tokens = F.concat(*[match_spans(text, t, 3, hint=text.rlike("[0-9]") & text.rlike(t)) for t in TOKENS])
    rows = docs.select(*keep, base.alias("_base"), tokens.alias("_found"))
    mixed = F.filter("_found", lambda t: t["token"].rlike("[0-9]") & t["token"].rlike("[A-Za-z]"))
    rows = rows.select(*keep, "_base", F.sort_array(mixed).alias("_mixed"))
    # both alphabets may give the same run
    rows = rows.select(*keep, "_base", F.filter("_mixed", lambda t, k: (k == 0) | (t != F.get(F.col("_mixed"), k - 1))).alias("_single"))
    rows = rows.select(*keep, "_base", apart(F.col("_single"), F.col("_base")).alias("_loose"))

    def judged(t):
        return once(F.coalesce(p_value(t["token"]), F.lit(0.0)), lambda p: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end"), band(F.length(t["token"])).alias("band"), p_class(p).alias("class"), F.xxhash64(t["token"]).alias("h")))

    return rows.select(*keep, F.transform("_base", judged).alias("_base"), F.transform("_loose", judged).alias("_tokens"))


def limits(rows: DataFrame, q: float) -> dict[int, int]:
    """For each band the least p-value class whose tokens, with all above, are structured by at most ``q``, as estimated; from at most bands * classes counts."""
    counts = rows.select(F.explode("_tokens").alias("t")).select("t.band", "t.class", "t.h").distinct().groupBy("band", "class").agg(F.count("*").alias("n")).collect()
    return {b: limit_of({r["class"]: r["n"] for r in counts if r["band"] == b}, q) for b in range(len(BANDS))}


def limit_of(counts: dict[int, int], q: float) -> int:
    """The least class of ``counts`` above whose threshold at most ``q`` of the tokens are structured; CLASSES + 1: none."""
    half = CLASSES // 2
    random = 2 * sum(n for c, n in counts.items() if c > half)  # even p: as many below one half
    best, above = CLASSES + 1, 0
    for c in range(CLASSES, 0, -1):
        above += counts.get(c, 0)
        even = random * (CLASSES - c + 1) / CLASSES
        if above and above - even <= q * above + 2 * above**0.5:
            best = c
    return best


def scan(docs: DataFrame, q: float = 0.05, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default doc_id) with ``spans``: array of (start, kind, end) by start, then kind as in ``KINDS``, and ``n_even``: base spans that the battery takes for random."""
    keep = keep or ["doc_id"]
    rows = written(scanned(docs, keep), "secrets")
    found = limits(rows, q)
    limit = F.create_map(*[F.lit(x) for kv in found.items() for x in kv])
    over = F.filter("_tokens", lambda t: t["class"] >= F.element_at(limit, t["band"]))
    # a run inside a longer one, of the other alphabet, is left out
    rows = rows.withColumn("_over", F.sort_array(F.transform(over, lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("back"), t["kind"].alias("kind")))))
    longest = lambda reach, t: (F.greatest(reach, -t["back"]), F.when(-t["back"] > reach, F.struct(t["start"].alias("start"), t["kind"].alias("kind"), (-t["back"]).alias("end"))))
    alone = folded(F.col("_over"), F.lit(0), longest, "struct<start:int,kind:int,end:int>")
    kind = "array<struct<start:int,kind:int,end:int>>"
    slim = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).cast(kind)
    even = F.size(F.filter("_base", lambda t: t["class"] > CLASSES * EVEN)).cast("long")
    return rows.select(*keep, F.sort_array(F.concat(slim(F.col("_base")), alone)).alias("spans"), even.alias("n_even"))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[REDACTED]", q: float = 0.05) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans become one. n_chars follows if there is one."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "text")  # names of ``docs`` cannot meet the scan's own
    rows = scan(packed, q, ["_row", "text"])
    # what lies between the spans, each piece cut out of a block's text
    step = lambda at, s: (F.greatest(at, s["end"]), F.when(s["start"] >= at, F.struct(at.alias("a"), s["start"].alias("z"))))
    rows = rows.withColumn("_gaps", folded(F.col("spans"), F.lit(0), step, "struct<a:int,z:int>"))
    part = lambda text, a, z: F.call_function("substr", text, a + 1, z - a)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_gaps") - 1) / BLOCK).cast("int")), lambda b: F.slice(F.col("_gaps"), b * BLOCK + 1, BLOCK))

    def joined(g):
        first, last = F.element_at(g, 1)["a"], F.element_at(g, -1)["z"]
        return once(part(F.col("text"), first, last), lambda t: F.array_join(F.transform(g, lambda x: part(t, x["a"] - first, x["z"] - first)), mark))

    tail = F.call_function("substr", F.col("text"), F.array_max(F.transform("spans", lambda s: s["end"])) + 1)
    text = F.concat(F.array_join(F.transform(blocks, joined), mark), F.lit(mark), tail)
    found = F.size("spans") > 0
    rows = rows.select("_row", found.alias("_found"), F.when(found, text).otherwise(F.col("text")).alias("_text"))
    out = []
    for c in docs.columns:
        old = F.col("_row").getField(c)
        if c == "text":
            out.append(F.col("_text").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("_found"), F.length("_text").cast(docs.schema[c].dataType)).otherwise(old).alias(c))
        else:
            out.append(old.alias(c))
    return rows.select(*out)
