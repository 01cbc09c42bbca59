"""Golden values and models of the functions behind the queries."""

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lakeleaf.engine import Engine, dispatch
from lakeleaf.functions import http, urls
from lakeleaf.operators import archive as A
from lakeleaf.operators import catalogue as C
from lakeleaf.operators import checks as V
from lakeleaf.operators import crawl, reports, retrieval, rules, windows
from lakeleaf.operators import discover as D
from lakeleaf.operators import extract as X
from lakeleaf.sources import sinks, warc_files
from lakeleaf.streaming import journal, pacing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def mapped(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", function(F.col("v")).alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


CANONICAL = [
    ("HTTP://User@Example.com/", None), ("https://EXAMPLE.com:443", "https://example.com/"), ("http://a.b:8080/x?b=2&a=1&utm_x=3#f", "http://a.b:8080/x?a=1&b=2"), ("ftp://a.b/", None),
    ("https://a.b/?GCLID=1&z=&y", "https://a.b/?y=&z="), ("https://a.b/docs/", "https://a.b/docs/"), ("https://[::1]:443/p", "https://[::1]/p"), ("https://a.b/?q=a+b%20c%2Fd~*", "https://a.b/?q=a+b+c%2Fd~%2A"),
    ("https://a.b/?a=2&a=1", "https://a.b/?a=2&a=1"), ("https://a.b:99999/", None), ("https://a.b/?x=%zz", "https://a.b/?x=%25zz"), ("https:///p", None), ("https://a.b/ä|x y", "https://a.b/ä|x y"),
]


def test_canonical(spark):
    assert mapped(spark, [u for u, _ in CANONICAL], urls.canonical) == [c for _, c in CANONICAL]
    assert mapped(spark, ["https://a.b/?utm_a=1&b=2"], lambda c: urls.canonical(c, "preserve")) == ["https://a.b/?b=2&utm_a=1"]
    assert mapped(spark, ["https://a.b/?utm_a=1"], lambda c: urls.canonical(c, "drop")) == ["https://a.b/"]
    with pytest.raises(ValueError):
        urls.canonical("x", "other")


def test_canonical_never_fails_on_noise(spark):
    rng = random.Random(20260905)
    noise = ["".join(rng.choice("ahtps:/.?#[]@%&=+ é\\0") for _ in range(rng.randrange(48))) for _ in range(300)]
    for f in (urls.canonical, urls.surt, urls.safe_path, urls.redacted, urls.sitemap_identity, urls.replay_key):
        assert len(mapped(spark, noise, f)) == 300


def test_other_urls(spark):
    assert mapped(spark, ["https://A.example.com:8443/x;p?q", "mailto:x"], urls.surt) == ["com,example,a:8443)/x?q", "mailto:x"]
    assert mapped(spark, ["https://h/a/../b/", "https://h/", "https://h/x?q=1", "https://h/a\\b"], urls.safe_path) == ["b/index.html", "index.html", "x__q_" + hashlib.sha256(b"q=1").hexdigest()[:12], None]
    assert mapped(spark, ["https://h/a/b/a/c/a", "https://h/a/a"], urls.is_trap) == [True, False]
    assert mapped(spark, ["https://x.e.com/", "https://e.com.evil/"], lambda c: urls.in_scope(c, ["e.com"])) == [True, False]
    assert urls.scope_hosts(["b.x", "a.x"], {"a.x": ["w.a.x"]}) == ["a.x", "b.x", "w.a.x"]
    with pytest.raises(ValueError):
        urls.scope_hosts(["a.x"], {"b.x": ["c.x"]})


def test_http(spark):
    statuses = [0, 503, 403, 404, 418, None, 501]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(statuses)], "i int, s int").select("i", http.retry_class("s").alias("c"), http.retry_class("s", F.lit("E")).alias("e")).orderBy("i").collect()
    assert [r.c for r in rows] == ["transient", "transient", "access_denied", "not_found", "permanent_client", "unknown", "unknown"]
    assert [r.e for r in rows][5:] == ["network", "network"]
    body = spark.createDataFrame([(gzip.compress(b"hi"), "gzip"), (b"hi", ""), (b"x", "br"), (gzip.compress(b"a" * 99), "gzip")], "b binary, e string")
    got = [(bytes(r.d.body) if r.d.body else None, r.d.error) for r in body.select(http.decoded_payload("b", "e", 50).alias("d")).collect()]
    assert got == [(b"hi", None), (b"hi", None), (None, "unsupported content encoding: br"), (None, "byte limit")]
    assert one(spark, http.retry_after_ms(F.lit("999999999999999999999"), F.current_timestamp())) == 2**53 - 1


def test_rules_preview(spark):
    config = {"version": 1, "rules": [{"id": "pdf", "match": {"mime": "application/pdf"}, "decision": {"download": False}}]}
    rows = [("https://example.test/a", "page", 0, None, None), ("https://sub.example.test/b", "asset", 0, "application/pdf", None), ("https://example.test.evil/c", "page", 0, None, None)]
    df = spark.createDataFrame(rows, "url string, kind string, depth long, mime string, bytes long")
    got = {r.url[-1]: r.decision for r in rules.preview(df, config, ["example.test"]).collect()}
    assert (got["a"].state, got["a"].rule_id, got["a"].missing, got["a"].download) == ("needs_metadata", "pdf", ["mime"], False)
    assert (got["b"].state, got["b"].download, got["b"].traverse, got["b"].discover) == ("decided", False, False, True)
    assert (got["c"].state, got["c"].discover, got["c"].rule_id) == ("out_of_scope", False, None)
    for bad in ({"version": 2, "rules": []}, {"version": 1, "rules": [{"id": "a", "match": {"regex": "x"}, "decision": {"download": True}}]}, {"version": 1, "rules": [{"id": "a", "match": {"min_depth": 3, "max_depth": 2}, "decision": {"download": True}}]}):
        with pytest.raises(rules.RuleError):
            rules.validated(bad)


DISCOVERY = [
    ("text/html", "https://e.x/d/p", '<base href="/b/"><!-- <a href=no> --><a href="a?x=1&amp;y=2#f">x</a><img src=i.png srcset="s1.png 1x, s2.png 2x"><script src=j.js></script>', ["https://e.x/b/a?x=1&y=2", "https://e.x/b/i.png", "https://e.x/b/s1.png", "https://e.x/b/s2.png", "https://e.x/b/j.js"]),
    ("text/html", "https://e.x/", '<a href="#t"></a><a href="mailto:a@b"></a><object data=o.bin></object><video poster=p.jpg></video>', ["https://e.x/o.bin", "https://e.x/p.jpg"]),
    ("text/css", "https://e.x/c/s.css", "/* url(no.png) */ @import 'i.css'; a{background:url( \"\\61 .png\" )} b{content:'url(no)'}", ["https://e.x/c/i.css", "https://e.x/c/a.png"]),
    ("text/html", "https://e.x/", '<style>p{background:url(s.png)}</style><p style="background:url(t.png)">', ["https://e.x/s.png", "https://e.x/t.png"]),
    ("text/html", "https://e.x/", '<img srcset="a.png,b.png 2x,data:image/png;base64,AA,BB 3x">', ["https://e.x/a.png", "https://e.x/b.png"]),
]


@pytest.mark.parametrize("mime,url,text,expected", DISCOVERY)
def test_discovery(mime, url, text, expected):
    assert [u for u, _ in D.references(text, mime, url)[0]] == expected


def test_parsers():
    notes = D.references('<script></script><a href="javascript:x">', "text/html", "https://e.x/")[1]
    assert notes == ["script_generated_content_not_evaluated", "unsupported_reference_scheme"]
    assert D.robots_rules("User-agent: *\nDisallow: /a\nUser-agent: ArchiveBot/1\nDisallow: /b # c\n") == ["/b"]
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    found, error = D.sitemap_entries(f"<urlset {ns}><url><loc> https://e.x/A?b#c </loc></url><url><loc>https://s.e.x/</loc></url><url><loc>https://e.x:443/A?b</loc></url></urlset>", "https://e.x/s.xml", ["e.x"])
    assert error is None and found == [("https://e.x/A?b", "page"), ("https://s.e.x/", "excluded")]
    assert D.sitemap_entries("<!DOCTYPE x><urlset/>", "https://e.x/", ["e.x"])[1] == "unsupported declaration or prefix"
    assert D.sitemap_entries("<urlset/>", "https://e.x/s", ["e.x"], ["https://e.x/s"]) == ([], None)


def test_extract():
    got = X.extracted(b"alpha\xff", "text/plain")
    assert (got["status"], got["reason"], got["locators"]) == ("partial", "invalid_encoding", [{"paragraph": 1, "start": 0, "end": 6}])
    html = "<head><title>t</title></head><p>One  two<p>three<li>x<script>no</script><div hidden>no</div><ul><li>a<li>b</ul>"
    assert X.visible_text(html) == "One two\nthree\nx\na\nb"
    assert X.extracted(b"%PDF", "application/pdf")["status"] == "unsupported"
    assert X.extracted(b"<div>" * 600, "text/html")["reason"] == "structure_limit"
    assert X.line_difference("a\nb\n", "a\nc", "x", "y")[1].endswith("\\ No newline at end of file\n")
    assert X.line_difference("a", "a", "x", "y") == ("complete", "")
    assert X.line_difference("a" * 40000, "b", "x", "y") == ("not_generated_size_limit", None)


def test_json():
    assert X.canonical_text({"\U0001f4a1": 1, "": 2}) == '{"\U0001f4a1":1,"":2}'
    for bad in (1.5, 2**53, {"a": float("nan")}, "\ud800"):
        with pytest.raises(ValueError):
            X.canonical_text(bad)
    with pytest.raises(ValueError):
        X.strict_tree('{"a":1,"a":1}')
    assert X.same_tree({"a": [1, 2]}, {"a": [1.0, 2]}) and not X.same_tree([True], [1])
    deep = []
    for _ in range(30):
        deep = [deep]
    assert X.json_problem(deep) == "depth limit"
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"enum": [1, 2]}}}, "required": ["a"]}
    assert X.schema_error({"a": [1, 3]}, schema) == "$.a[1]: not one of the allowed values"
    assert X.schema_error({}, schema) == "$.a: required" and X.schema_error({"a": [True]}, {"properties": {"a": {"items": {"type": "integer"}}}}) == "$.a[0]: expected integer"


def test_retrieval(spark):
    docs = spark.createDataFrame([("a", "committee water water report", [1.0, 0.0]), ("b", "forest assessment", [0.0, 1.0])], "id string, text string, embedding array<double>")
    search = lambda q, e=None: [(r.id, r.score) for r in retrieval.hybrid(docs, q, e, docs, 10, "id", "id").collect()]
    assert search("water")[0][0] == "a" and search("absent") == []
    assert search("", [0.0, 1.0])[0] == ("b", pytest.approx(1 / 61))
    assert search("water", [1.0, 0.0])[0] == ("a", pytest.approx(2 / 61))
    for bad in ([0.0, 0.0], [float("nan")], [], [True]):
        with pytest.raises(ValueError):
            retrieval.unit(bad)
    assert retrieval.unit([1.7e308, 1.7e308]) == pytest.approx([0.5**0.5] * 2) == retrieval.unit([1e-320, 1e-320])
    with pytest.raises(ValueError):
        retrieval.fused([], 0)
    with pytest.raises(Exception, match="dimension"):
        retrieval.vector_scores(docs, [1.0], "id").collect()


def test_memory(spark):
    log = spark.createDataFrame([(1, "a", "x", [1.0]), (3, "a", "x", None), (5, "a", "y", None), (2, "b", "z", [2.0])], "seq long, id string, text string, embedding array<double>")
    now = {r.id: (r.text, r.embedding, r.text_since) for r in retrieval.memory_put(log).collect()}
    assert now == {"a": ("y", None, 5), "b": ("z", [1.0], 2)}
    edges = spark.createDataFrame([(2, "s", "r", "t", "a"), (6, "s", "r", "t2", "a"), (6, "s", "r", "t2", "a"), (4, "s", "r", "u", "b"), (4, "", "r", "u", "b"), (4, "s", "r", "u", "none")], "seq long, source string, relation string, target string, document string")
    assert {(r.target, r.document) for r in retrieval.memory_relate(edges, retrieval.memory_put(log)).collect()} == {("t2", "a"), ("u", "b")}


def test_query_language(spark):
    docs = spark.createDataFrame([(1, "Über den Fluss"), (2, "the river runs"), (3, "river the runs"), (4, "riverbank")], "derivative_id int, text string")
    hits = lambda q: sorted(r.id for r in retrieval.full_text(docs, q).collect())
    assert hits("uber") == [1] and hits('"the river"') == [2] and hits("river*") == [2, 3, 4]
    assert hits("river NOT (the AND fluss)") == [2, 3] and hits("fluss OR riverbank") == [1, 4] and hits("runs the") == [2, 3]
    for bad in ("", "a AND", "(a", "NEAR(a b)", "col:a", "^a", '"a'):
        with pytest.raises(retrieval.QueryError):
            retrieval.parse_query(bad)


def test_windows(spark):
    rows = spark.createDataFrame([(i % 3, float((i * 7919) % 1000)) for i in range(900)], "g int, v double")
    got = {r.g: r for r in windows.floor_percentiles(rows, ["g"], "v", {"p50": 0.5, "p99": 0.99, "p0": 0.0}).collect()}
    for g in range(3):
        v = sorted(float((i * 7919) % 1000) for i in range(900) if i % 3 == g)
        assert (got[g].p50, got[g].p99, got[g].p0) == (v[150], v[297], v[0])
    four = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "latency_ms int")
    assert reports.latency(four).first().p50 == 3
    ranked = windows.global_rank(rows.repartition(17), [F.desc("v"), F.asc("g")], "n").select("n").collect()
    assert sorted(r.n for r in ranked) == list(range(1, 901))


def test_catalogue_moves_and_backdating(spark):
    log = [(1, "u1", b"a", 10.0, None), (2, "u1", b"b", 5.0, None), (3, "u2", b"a", 20.0, "u1"), (4, "u3", b"a", 30.0, "nope"), (5, "u1", b"a", 40.0, None), (6, "u4", b"c", 50.0, "u2"), (7, "u5", b"q", 1.0, None), (8, "u5", b"q", 2.0, "u1")]
    df = spark.createDataFrame([(i, u, c, "text/plain", "public", t, m) for i, u, c, t, m in log], "acquisition_id long, url string, content binary, mime string, handling string, acquired double, moved_from string")
    got = {r.acquisition_id: r for r in C.register(df, moves=True).collect()}
    assert set(got) == {1, 2, 3, 5, 6, 7}  # an unknown origin and a conflict of sources are refused
    sid = hashlib.sha256(b"u1").hexdigest()
    assert got[3].source_id == got[6].source_id == sid and got[3].moved and got[3].before_url == "u1" and got[6].before_url == "u2"
    assert not got[2].advances_url_head and got[2].content_changed and got[5].before_content_hash == hashlib.sha256(b"a").hexdigest() and got[5].content_changed is False
    assert got[1].content_changed is None and got[3].duplicate_content and not got[1].duplicate_content
    p = json.loads(got[1].payload_json)
    assert hashlib.sha256(json.dumps(p, sort_keys=True, separators=(",", ":")).encode()).hexdigest() == got[1].receipt_id
    again = {r.acquisition_id: r.receipt_id for r in C.register(df.repartition(17), moves=True).collect()}
    assert again == {k: r.receipt_id for k, r in got.items()}


def test_policy():
    e = lambda i, action, details, at=0.0, reason="r": {"source_id": "s", "event_id": i, "action": action, "reason": reason, "recorded": at, "details": json.dumps(details)}
    out = C.policy_fold("public", [e(1, "retention", {"retain_until": 9}), e(2, "remove", {"confirm": "s"}, 5.0), e(3, "flag", {"flag": "z"}), e(4, "handling", {"handling": "public"}), e(5, "retention", {"legal_hold": True}), e(6, "remove", {"confirm": "s"}, 20.0), e(7, "retention", {"legal_hold": False}), e(8, "remove", {"confirm": "x"}, 20.0), e(9, "remove", {"confirm": "s"}, 20.0), e(10, "flag", {"flag": "y"}), e(11, "flag", {"flag": "y"}, reason=" ")])
    assert [x["error"] for x in out] == [None, "retention_active", None, "handling_relaxation_requires_review", None, "legal_hold", None, "confirmation_required", None, "source_removed", "invalid_policy_reason"]
    assert out[4]["retain_until"] == 9.0 and out[-1]["handling"] == "revoked" and out[2]["flags"] == ["z"]


def test_reports(spark):
    rows = [("https://e.x/1", "captured", 200, 5, 9, "a" * 64), ("https://e.x/2", "captured", 200, 5, 1, "a" * 64), ("https://e.x/3", "captured", 302, 0, None, "b" * 64), ("https://e.x/4", "failed", 403, None, 8, None), ("https://e.x/5", "pending", None, None, None, None), ("https://e.x/6", "unsupported", None, None, 0, None)]
    df = spark.createDataFrame(rows, "url string, state string, status int, bytes long, declared_bytes long, sha256 string")
    r = reports.reconciled(df, {"captured": 3, "failed": 1, "pending": 1, "unsupported": 1}).first()
    assert (r.captured, r.captured_payload_bytes, r.declared_payload_bytes, r.unknown_estimate_resources, r.redirects, r.missing, r.consistent) == (3, 10, 18, 2, 1, 3, True)
    assert not reports.reconciled(df.unionByName(df.limit(1))).first().consistent
    assert reports.duplicate_groups(df.where("state = 'captured'")).count() == 1
    states = spark.createDataFrame([("saved",), ("failed",), ("excluded",), ("pending",)], "state string")
    s = reports.capture_summary(states).first()
    assert (s.attempted, s.saved, s.excluded, s.status) == (2, 1, 1, "partial")
    bad = spark.createDataFrame([(2**53,), (1,)], "n long")
    with pytest.raises(Exception, match="safe integer"):
        bad.agg(reports.safe_sum("n")).collect()
    audit = spark.createDataFrame([("https://e.x/", 0, None, None)] * 5, "url string, status int, digest string, latency_ms double")
    h = reports.health(audit).first()
    assert (h.pages, h.attempts, h.capture_errors, h.verdict[:7]) == (0, 5, 5, "Unknown")


def test_findings_count_a_report_once(spark):
    fresh = spark.createDataFrame([("f", "fetch", "HTTPError", 2)], "fingerprint string, stage string, error_type string, occurrences long")
    ledger = spark.createDataFrame([("f", "fetch", "HTTPError", "verified", 3, ["h0"], False)], "fingerprint string, stage string, error_type string, state string, occurrences long, report_hashes array<string>, recurrence boolean")
    once = reports.merged_findings(ledger, fresh, "h1")
    r = reports.merged_findings(once, fresh, "h1").first()
    assert (r.occurrences, r.report_hashes, r.recurrence) == (5, ["h0", "h1"], True)


def test_sorted_json(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": [2, {"d": null, "c": "\u00e9"}]}',), ("[3, 1]",), ("{",)], "t string")
    assert [r[0] for r in rows.select(X.sorted_json("t")["value"]).collect()][:2] == ['{"a":[2,{"c":"\\u00e9","d":null}],"b":1}', "[3,1]"]


def test_permission():
    c = pacing.Config(rpm=30, burst=5)
    p, waits = pacing.Pace(tokens=5.0), []
    for _ in range(7):
        p, wait = pacing.permission(p, "h", 0.0, 100.0, c)
        waits.append(wait)
    assert waits == [100.0] * 5 + [2100.0, 4100.0] and p.tokens == 0 and p.refilled_ms == 4000
    p, wait = pacing.permission(pacing.Pace(circuit="TRIPPED", tripped_ms=0.0), "h", 20_000.0, 100.0, c)
    assert (p.circuit, wait) == ("HALF_OPEN", 40_100.0)
    p, wait = pacing.permission(pacing.Pace(cooldowns={"h": 5000.0, "g": 9000.0}), "h", 1000.0, 100.0, c)
    assert (wait, p.cooldowns) == (4100.0, {"g": 9000.0})
    p, wait = pacing.permission(pacing.Pace(ewma=200.0, baseline=100.0, backoff=150.0), None, 0.0, 100.0, c)
    assert (p.circuit, wait) == ("THROTTLED", 200.0)


def test_waits_hold_one_batch():
    import pyarrow as pa

    asks = [("a", 1, 0.0, "h"), ("a", 2, 5.0, "h"), ("a", 3, 6.0, None), ("a", 4, 7.0, "g"), ("a", 5, 8.0, "h"), ("a", 6, 9.0, "h"), ("a", 7, 90_000.0, "h"), ("b", 1, 3.0, "h"), (None, 1, 4.0, None)]
    want, last = [], {}
    for engine, seq, at, host in asks:
        p, late = last.get(engine, (pacing.Pace(), 0.0))
        p, wait = pacing.permission(p, host, max(at, late), 0.0, pacing.Config())
        last[engine] = p, max(at, late) + wait
        want.append((engine, seq, max(at, late) + wait - at))
    read = []

    def batches():
        for lo in range(0, len(asks), 2):
            read.append(lo)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*asks[lo : lo + 2])], names=["engine", "seq", "at", "host"])

    got = []
    for k, b in enumerate(pacing.waits(batches())):
        assert len(read) == k + 1
        got += zip(*(c.to_pylist() for c in b.columns))
    assert got == want and want[5][2] > 0


def test_arrow_columns_become_objects_by_slices(monkeypatch):
    import pyarrow as pa

    most = []

    class Column(list):
        def slice(self, lo, n):
            most.append(n)
            return pa.array(self[lo : lo + n], pa.string())

    monkeypatch.setattr(X, "SLICE", 3)
    texts = ["a", None, "é", "", "b", "c", "d"]
    assert X.by_slices(lambda a, b: (a or "-") + (b or "-"), pa.string(), Column(texts), Column(texts[::-1])).to_pylist() == [(a or "-") + (b or "-") for a, b in zip(texts, texts[::-1])]
    assert set(most) == {3} and X.by_slices(len, pa.int64(), Column()).to_pylist() == []


def test_markup_events():
    from lakeleaf.functions import markup

    seen = []
    markup.read("<p a=1>x<br/><![if IE]>y<![endif]></p", lambda *e: seen.append(e[:2]), strict=True)
    assert seen[:5] == [("open", "p"), ("text", "x"), ("open", "br"), ("close", "br"), ("text", "y")]
    with pytest.raises(markup.MalformedMarkup):
        markup.read("<![what[x]]>", print, strict=True)
    markup.read("<![what[x]]>", print)


def test_entity_decode(spark):
    cases = {"&amp;lt; &LT;": "&lt; <", "&#65;&#x1F642;&#xe9;": "A\U0001f642é", "&#0;&#xD800;&#99999999999;": "\ufffd" * 3, "&nbsp; & &#;": "&nbsp; & &#;", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", X.entity_decode("t").alias("d")).collect()
    assert {r.t: r.d for r in rows} == {**cases, None: None}


def test_pacing():
    c, p = pacing.Config(), pacing.Pace()
    for x in [5.0] + [300.0] * 9:
        assert p.baseline is None
        p = pacing.succeeded(p, x, c)
    assert p.baseline == 300
    assert pacing.succeeded(p, 1000.0, c).baseline == 314
    p = pacing.Pace()
    for _ in range(3):
        p = pacing.failed(p, 404, None, "h", 0.0, 0.5, c)
    assert (p.circuit, p.errors) == ("NOMINAL", 0)
    for k in range(3):
        p = pacing.failed(p, 503, 999_999_000, "h", 0.0, 0.5, c)
        assert p.circuit == ("TRIPPED" if k == 2 else "THROTTLED")
    assert p.cooldowns["h"] == 600_000
    assert pacing.half_even(2.5) == 2
    saved = {"version": 1, "tokens": 1.0, "circuit": "THROTTLED", "backoff": 2000, "warmup": [], "baseline": None, "cooldowns": {"h": 5000.0}, "saved_at_ms": 1000.0}
    own = {"tokens": 3.0, "circuit": "NOMINAL", "backoff": 1200, "errors": 0, "cooldowns": {"h": 4000.0}}
    merged = pacing.restored(own, saved, 500.0, c)
    assert (merged["tokens"], merged["circuit"], merged["cooldowns"]["h"]) == (1.0, "THROTTLED", 5000.0)
    with pytest.raises(ValueError):
        pacing.restored(own, {**saved, "circuit": "TRIPPED"}, 500.0, c)


def test_containers(spark, tmp_path):
    body = b"x" * 600
    rows = [("a.warc", 1, "https://e.x/1", body), ("a.warc", 2, "https://e.x/2", body), ("a.warc", 3, "https://e.x/3", b"short"), ("a.warc", 4, "https://e.x/4", b"short")]
    df = spark.createDataFrame([(f, s, u, "2024-01-01T00:00:00Z", 200, "text/html", {"Content-Type": "text/html", "Content-Length": "1"}, b) for f, s, u, b in rows], "file string, seq long, url string, ts string, status int, mime string, headers map<string,string>, body binary")
    sinks.write_containers(sinks.container_rows(df), str(tmp_path))
    records = warc_files.scan(spark, f"file://{tmp_path}/a.warc")
    assert [r.type for r in records.orderBy("offset").collect()] == ["response", "revisit", "response", "response"]
    assert A.type_counts(records).first().passed and A.resolved_revisits(records).first().unresolved is False
    cdx = A.parsed_cdx(spark.read.text(f"file://{tmp_path}/a.cdx"))
    assert cdx.count() == 4 and A.bad_spans(cdx, records).count() == 0 and A.bad_spans(cdx.withColumn("offset", F.col("offset") + 1), records).count() == 4
    data = (tmp_path / "a.warc").read_bytes()
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data[:900]) + gzip.compress(data[900:]))
    (tmp_path / "c.warc").write_bytes(data.replace(b"short", b"shorT", 1))
    (tmp_path / "d.warc").write_bytes(data[:-10])
    (tmp_path / "._e.warc").write_bytes(b"side file")
    got = {r.file: r for r in Engine(spark).verify(f"file://{tmp_path}").collect()}
    assert set(got) == {"a.warc", "b.warc.gz", "c.warc", "d.warc"}
    assert got["b.warc.gz"].passed and not got["c.warc"].passed and got["d.warc"].corrupt == 1
    page = [("https://e.x/", b"1"), ("https://e.x/q?a=1", b"2")]
    pages = spark.createDataFrame(page, "url string, payload binary")
    for name in ("x.zip", "y.zip"):
        assert sinks.export_zip(pages, str(tmp_path / name)) == 2
    assert (tmp_path / "x.zip").read_bytes() == (tmp_path / "y.zip").read_bytes()
    clash = spark.createDataFrame([("https://a.x/", b"1"), ("https://b.x/", b"2")], "url string, payload binary")
    with pytest.raises(ValueError):
        sinks.export_directory(clash, str(tmp_path / "out"))
    assert len(sinks.export_directory(clash, str(tmp_path / "out2"), by_host=True)) == 2
    index = f"file://{tmp_path}/a.cdx"
    answer = json.loads(dispatch(Engine(spark), json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "search_archive", "arguments": {"query": "X/2", "path": index}}})))
    assert json.loads(answer["result"]["content"][0]["text"])["total"] == 1


def test_containers_in_parts(spark, tmp_path):
    """Containers cut anywhere are scanned as whole ones are, damaged and compressed ones too."""
    record = lambda i, body: b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: %d\r\nContent-Length: %d\r\n\r\n" % (i, len(body)) + body + b"\r\n\r\n"
    data = b"".join(record(i, b"\r\n\r\nx" * (i % 7)) for i in range(40))
    whole = {"a.warc": data, "b.warc": data[:-3], "c.warc": data + b"WARC/1.1\r\nContent-Length: 9", "d.warc": data + b"WARC/2\r\n\r\n" + data, "e.warc": b""}
    packed = gzip.compress(data[:900]) + gzip.compress(data[900:])
    whole |= {"f.warc.gz": packed, "g.warc.gz": packed[:-5], "h.warc.gz": b"no", "i.warc.gz": gzip.compress(b""), "j.warc.gz": packed + b"\0" * 9, "k.warc.gz": packed + b"junk"}
    parts = [(n, k, d[at : at + 13]) for n, d in whole.items() for k, at in enumerate(range(0, max(1, len(d)), 13))]
    random.Random(3).shuffle(parts)
    one = warc_files.parsed(spark.createDataFrame(list(whole.items()), "path string, content binary"))
    cut = warc_files.parsed(spark.createDataFrame(parts, "path string, part long, content binary"))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(one) == rows(cut)
    errors = {r.file: (r.offset, r.length, r.error) for r in cut.where("error is not null").collect()}
    last = len(data) - len(record(39, b"\r\n\r\nx" * 4))
    assert errors == {
        "b.warc": (last, len(data) - 3 - last, "truncated or unterminated"), "c.warc": (len(data), 27, "incomplete header"), "d.warc": (len(data), 10 + len(data), "bad version or length"), "e.warc": (0, 0, "empty container"),
        "g.warc.gz": (0, len(packed) - 5, "unreadable container"), "h.warc.gz": (0, 2, "unreadable container"), "i.warc.gz": (0, 0, "empty container"), "k.warc.gz": (0, len(packed) + 4, "unreadable container"),
    }
    members = warc_files.zipped(spark.createDataFrame([("a.warc", k, data[at : at + 50]) for k, at in enumerate(range(0, len(data), 50))], "path string, part long, content binary"))
    assert warc_files.parsed(members).where("error is null and file = 'a.warc.gz'").count() == 40


def test_a_scan_holds_one_record():
    import tracemalloc

    body = b"y" * 100_000
    record = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    tracemalloc.start()
    assert sum(1 for _ in warc_files.rows_of("a.warc", (record for _ in range(300)))) == 300
    assert tracemalloc.get_traced_memory()[1] < 2 << 20
    tracemalloc.stop()


def test_checks(spark):
    assert V.state_problem({"a": [{"tokens": 1}]}) is None and V.state_problem({"x_auth": 1}) == "credential name"
    lease = spark.createDataFrame([("j", 1, 0.0), ("j", 2, 100.0), ("j", 3, 301.0), ("j", 4, 400.0)], "job string, seq long, at double")
    assert [r.granted for r in V.leases(lease).orderBy("seq").collect()] == [True, False, True, False]


def test_crawl(spark):
    seeds = spark.createDataFrame([("https://e.x/",)], "url string")
    links = spark.createDataFrame([("https://e.x/", "https://e.x/a"), ("https://e.x/a", "https://e.x/b"), ("https://e.x/", "https://o.y/"), ("https://e.x/b", "https://e.x/")], "source string, target string")
    got = {r.url: (r.depth, r.state, r.reason) for r in crawl.frontier(seeds, links, 1, ["e.x"]).collect()}
    assert got == {"https://e.x/": (0, "queued", None), "https://e.x/a": (1, "queued", None), "https://o.y/": (1, "excluded", "out_of_scope"), "https://e.x/b": (2, "excluded", "depth_limit")}
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "source int, target int")
    assert {r.id: (r.final, r.hops) for r in A.redirect_chains(chain).collect()} == {1: (3, 2), 2: (1, 2), 3: (2, 2), 5: (6, 1)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(i % 3), i, float(i * 100), "h", float(i % 50), 503 if i % 6 == 0 else 200, None, 0.5) for i in range(60)]
    schema = "engine string, seq long, ts_ms double, host string, latency_ms double, status int, retry_after_ms double, chance double"
    df = spark.createDataFrame(rows, schema)
    for k in range(4):
        df.where(f"seq >= {k * 15} and seq < {k * 15 + 15}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = pacing.stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("pace").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.engine: r.r for r in spark.table("pace").groupBy("engine").agg(F.max_by(F.struct("circuit", "errors"), "seq").alias("r")).collect()}
    assert set(last) == {"0", "1", "2"}
    beyond = journal.heads(df, "engine", "status", "ts_ms", "seq").count()
    assert beyond == 3
