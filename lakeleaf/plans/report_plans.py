"""Report, archive, crawl, rule and parser queries."""

from pyspark.sql import functions as F

from lakeleaf.functions import http, urls
from lakeleaf.operators import archive as A
from lakeleaf.operators import checks as V
from lakeleaf.operators import crawl as K
from lakeleaf.operators import discover as D
from lakeleaf.operators import extract as X
from lakeleaf.operators import reports as R
from lakeleaf.operators import rules as U
from lakeleaf.operators import windows as W
from lakeleaf.plans.base import AUDIT, OUTCOMES, PAGES, Plans

P = Plans()


# --- reports --------------------------------------------------------------------
@P.add("agg_coverage_counts", f"WITH o AS ({OUTCOMES}) SELECT s.state, count(o.state) AS n FROM (VALUES ('captured'),('excluded'),('failed'),('pending'),('unsupported')) s(state) LEFT JOIN o ON o.state = s.state GROUP BY s.state")
def _(t):
    return R.coverage_counts(t.outcomes())


@P.add("agg_report_reconcile", f"WITH o AS ({OUTCOMES}) SELECT count(*) AS discovered, count(*) FILTER (state = 'captured') AS captured, count(*) FILTER (state = 'failed') AS failed, CAST(sum(bytes) FILTER (state = 'captured') AS BIGINT) AS captured_payload_bytes, CAST(sum(declared_bytes) AS BIGINT) AS declared_payload_bytes, count(*) FILTER (declared_bytes IS NULL) AS unknown_estimate_resources, count(*) FILTER (state = 'captured' AND status BETWEEN 300 AND 399) AS redirects, count(*) FILTER (state IN ('failed','pending','unsupported')) AS missing, true AS consistent FROM o")
def _(t):
    return R.reconciled(t.outcomes()).select("discovered", "captured", "failed", "captured_payload_bytes", "declared_payload_bytes", "unknown_estimate_resources", "redirects", "missing", "consistent")


@P.add("agg_duplicate_groups", "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return R.duplicate_groups(t.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256")), name="doc_id")


@P.add("agg_safe_sum", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(38,0))) AS BIGINT) AS total FROM lineitem")
def _(t):
    return t.lineitem.agg(R.safe_sum("l_extendedprice").alias("total"))


@P.add("agg_capture_summary", "SELECT count(*) FILTER (event_type NOT IN ('signup', 'purchase')) AS attempted, count(*) FILTER (event_type = 'view') AS saved, count(*) FILTER (event_type = 'purchase') AS excluded, count(*) FILTER (event_type IN ('click', 'error')) AS failed, count(*) FILTER (event_type = 'signup') AS pending, 'partial' AS status FROM events")
def _(t):
    e = F.col("event_type")
    return R.capture_summary(t.events.select(F.when(e == "view", "saved").when(e == "purchase", "excluded").when(e == "signup", "pending").otherwise("failed").alias("state")))


_YIELD = f"WITH a AS ({AUDIT}), p AS (SELECT section, count(*) AS pages, avg(CASE WHEN latency_ms <> 0 THEN latency_ms END) AS lat FROM a GROUP BY section), d AS (SELECT section, count(*) AS docs FROM a WHERE event_type = 'view' AND seq % 3 = 0 GROUP BY section)"


def _yield(t):
    a = t.audit()
    return R.route_yield(a, a.where("event_type = 'view' and seq % 3 = 0").select("url"))


@P.add("agg_route_yield", _YIELD + ' SELECT section, pages, coalesce(docs, 0) AS docs, round(100.0 * coalesce(docs, 0) / pages, 1) AS yield, CAST(round(coalesce(lat, 0)) AS BIGINT) AS avg_latency FROM p LEFT JOIN d USING (section)')
def _(t):
    return _yield(t)


@P.add("join_route_docs", _YIELD + " SELECT section, coalesce(docs, 0) AS docs FROM p LEFT JOIN d USING (section)")
def _(t):
    return _yield(t).select("section", "docs")


@P.add("sort_yield", _YIELD + ' SELECT section, round(100.0 * coalesce(docs, 0) / pages, 1) AS yield FROM p LEFT JOIN d USING (section) ORDER BY 100.0 * coalesce(docs, 0) / pages DESC, section')
def _(t):
    return _yield(t).orderBy(F.desc(F.col("docs") / F.col("pages")), "section").select("section", "yield")


@P.add("agg_low_yield", _YIELD + " SELECT section, pages, 'Zero documents found across traversed branch. Consider pruning scope to preserve server resources.' AS reason FROM p LEFT JOIN d USING (section) WHERE pages >= 5 AND docs IS NULL")
def _(t):
    return R.low_yield(_yield(t))


_PCT = f"WITH a AS ({AUDIT}), r AS (SELECT event_type, latency_ms, row_number() OVER (PARTITION BY event_type ORDER BY latency_ms) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM a WHERE latency_ms > 0) SELECT event_type, max(latency_ms) FILTER (k = floor(n * 0.5) + 1) AS p50, max(latency_ms) FILTER (k = floor(n * 0.9) + 1) AS p90, max(latency_ms) FILTER (k = floor(n * 0.99) + 1) AS p99, CAST(round(avg(latency_ms)) AS BIGINT) AS mean, max(latency_ms) AS max FROM r GROUP BY event_type"


@P.add("agg_latency_percentiles", _PCT)
def _(t):
    return R.latency(t.audit(), ["event_type"])


@P.add("agg_distinct_pages", f"WITH a AS ({AUDIT}) SELECT count(DISTINCT url) AS pages FROM a WHERE digest IS NOT NULL AND status BETWEEN 200 AND 399")
def _(t):
    return R.health(t.audit()).select("pages")


@P.add("agg_attempts_errors", f"WITH a AS ({AUDIT}) SELECT count(*) AS attempts, count(*) FILTER (status = 0) AS capture_errors, count(*) FILTER (status = 429 OR status >= 500) AS server_errors, count(*) FILTER (status BETWEEN 400 AND 499 AND status <> 429) AS client_errors FROM a")
def _(t):
    return R.health(t.audit()).select("attempts", "capture_errors", "server_errors", "client_errors")


@P.add("agg_health_verdict", f"WITH a AS ({AUDIT}) SELECT CASE WHEN count(*) FILTER (status = 0) > 0 THEN 'Unknown' WHEN avg(latency_ms) > 2000 THEN 'Strained (High Latency)' WHEN count(*) FILTER (status = 429 OR status >= 500) > 0 THEN 'Degraded (Server Errors Detected)' ELSE 'Optimal' END AS verdict FROM a")
def _(t):
    return R.health(t.audit()).select("verdict")


@P.add("agg_rate", "SELECT round(count(*) / greatest(0.1, (epoch_ms(max(ts)) - epoch_ms(min(ts))) / 60000.0), 1) AS rate FROM events")
def _(t):
    return R.request_rate(t.audit().withColumn("ts", F.col("ts").cast("timestamp")))


_CATS = [{"code": "T1", "label": "one", "keywords": ["erth", "ingsh"]}, {"code": "T2", "label": "two", "keywords": ["ción"]}, {"code": "T3", "label": "none", "keywords": ["zzzzzz"]}]
_CAT_SQL = "WITH c(code, label, ks) AS (VALUES ('T1', 'one', ['erth', 'ingsh']), ('T2', 'two', ['ción']), ('T3', 'none', ['zzzzzz'])), m AS (SELECT code, doc_id FROM c, documents d WHERE len(list_filter(ks, lambda k: contains(lower(d.text), k))) > 0)"


def _taxonomy(t):
    return R.taxonomy(t.documents.where("text is not null"), _CATS, F.col("text"), F.concat(F.lit("d"), F.col("doc_id").cast("string")), "doc_id")


@P.add("agg_taxonomy", _CAT_SQL + " SELECT c.code, c.label, count(m.doc_id) AS n FROM c LEFT JOIN m USING (code) GROUP BY c.code, c.label")
def _(t):
    return _taxonomy(t).select("code", "label", "n")


@P.add("limit_samples", _CAT_SQL + ", r AS (SELECT code, doc_id, row_number() OVER (PARTITION BY code ORDER BY doc_id) AS k FROM m) SELECT code, string_agg('d' || doc_id, ',' ORDER BY doc_id) AS samples FROM r WHERE k <= 3 GROUP BY code")
def _(t):
    return _taxonomy(t).where(F.size("samples") > 0).select("code", F.array_join("samples", ",").alias("samples"))


_LINKS = "SELECT DISTINCT url AS source, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages"


def _links(t):
    return t.pages.select(F.col("url").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


@P.add("agg_link_graph", _LINKS)
def _(t):
    return R.link_graph(_links(t)).select("source", "target")


@P.add("limit_display_edges", f"WITH e AS ({_LINKS}) SELECT least(count(*), 500) AS shown, greatest(count(*) - 500, 0) AS clipped FROM e")
def _(t):
    return R.link_graph(_links(t)).agg(F.count("*").alias("n")).select(F.least("n", F.lit(500)).cast("long").alias("shown"), F.greatest(F.col("n") - 500, F.lit(0)).cast("long").alias("clipped"))


@P.add("limit_edges", f"WITH e AS (SELECT role AS source, 't' || turn AS target, min(conv_id * 1000 + turn) AS seq FROM conversations GROUP BY 1, 2) SELECT source, target FROM e ORDER BY seq, source, target LIMIT 10000")
def _(t):
    c = t.conversations.select(F.col("role").alias("source"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("target"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    return R.capped_edges(c).select("source", "target")


@P.add("join_graph_membership", "SELECT count(*) AS dangling FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3)")
def _(t):
    edges = t.nation.select(F.col("n_name").alias("source"), F.col("n_regionkey").cast("string").alias("target"))
    known = t.nation.select(F.col("n_name").alias("url")).unionByName(t.region.where("r_regionkey < 3").select(F.col("r_regionkey").cast("string").alias("url")))
    return R.dangling_edges(edges, known).agg(F.count("*").alias("dangling"))


_FIND = "SELECT 'fetch' AS stage, CASE WHEN event_type = 'error' THEN 'HTTPError' ELSE 'unknown' END AS error_type FROM events WHERE event_type IN ('error', 'signup')"


def _events(t):
    e = F.col("event_type")
    return t.events.select(F.when(e == "error", 503).alias("status"), F.when(e == "signup", "error").alias("level"), F.lit(None).cast("string").alias("outcome"), F.when(e == "signup", "Odd").alias("error_type"), F.lit("fetch").alias("stage"), "event_id")


@P.add("agg_findings", f"WITH f AS ({_FIND}) SELECT sha256('{{\"error_type\":\"' || error_type || '\",\"stage\":\"' || stage || '\"}}') AS fingerprint, stage, error_type, count(*) AS occurrences FROM f GROUP BY stage, error_type")
def _(t):
    return R.findings(_events(t), ["fetch", "archive"], ["HTTPError", "TimeoutError", "network_error"])


@P.add("filter_failed_event", "SELECT count(*) AS n FROM events WHERE event_type IN ('error', 'signup')")
def _(t):
    return _events(t).where(R.failed_event()).agg(F.count("*").alias("n"))


@P.add("ledger_digest", f"WITH f AS ({_FIND}) SELECT DISTINCT sha256('{{\"error_type\":\"' || error_type || '\",\"stage\":\"' || stage || '\"}}') AS fingerprint FROM f")
def _(t):
    return R.findings(_events(t), ["fetch"], ["HTTPError"]).select("fingerprint")


@P.add("ledger_validate", f"WITH f AS ({_FIND}) SELECT count(DISTINCT error_type) AS findings, count(*) AS occurrences FROM f")
def _(t):
    fresh = R.findings(_events(t), ["fetch"], ["HTTPError"])
    empty = t.spark.createDataFrame([], "fingerprint string, stage string, error_type string, state string, occurrences long, report_hashes array<string>, recurrence boolean")
    once = R.merged_findings(empty, fresh, "a" * 64)
    return R.merged_findings(once, fresh, "a" * 64).agg(F.count("*").alias("findings"), F.sum("occurrences").alias("occurrences"))


@P.add("sink_receipt", f"WITH o AS ({OUTCOMES}) SELECT count(*) AS discovered, count(*) FILTER (state = 'captured') AS captured, false AS complete FROM o")
def _(t):
    import json

    from lakeleaf.sources.sinks import receipt

    r = json.loads(receipt(t.outcomes(), [], {}))
    return t.spark.createDataFrame([(r["discovered"], r["counts"]["captured"], r["complete"])], "discovered long, captured long, complete boolean")


@P.add("sink_failure_report", f"WITH o AS ({OUTCOMES}) SELECT state, count(*) AS n, 'timeout' AS cause FROM o GROUP BY state")
def _(t):
    from lakeleaf.sources.sinks import failure_report

    return failure_report(t.outcomes(), "TimeoutError")


@P.add("sink_report_md", f"WITH a AS ({AUDIT}) SELECT '| attempts | ' || count(*) || ' |' AS line FROM a")
def _(t):
    row = R.health(t.audit()).first().asDict()
    return t.spark.createDataFrame([(x,) for x in R.markdown(row).split("\n") if x.startswith("| attempts")], "line string")


@P.add("sink_report_json", f"WITH p AS ({PAGES}) SELECT page_id, scheme || '://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END AS url FROM p")
def _(t):
    rows = t.pages.select("page_id", F.to_json(F.struct(urls.redacted("url").alias("url"))).alias("j"))
    return rows.select("page_id", F.get_json_object("j", "$.url").alias("url"))


@P.add("sink_graph_svg", f"WITH e AS ({_LINKS}) SELECT least(count(*), 500) AS rows FROM e")
def _(t):
    edges = [(r.source, r.target) for r in R.link_graph(_links(t)).orderBy("source", "target").limit(501).collect()]
    return t.spark.createDataFrame([(R.graph_svg(edges).count("→"),)], "rows long")


@P.add("agg_progress", f"WITH a AS ({AUDIT}) SELECT count(*) AS audit, count(DISTINCT url) AS visited, count(*) FILTER (digest IS NOT NULL) AS docs FROM a")
def _(t):
    return R.progress(t.audit())


@P.add("agg_ocr_confidence", "SELECT l_orderkey % 100 AS page, round(avg(CASE WHEN l_quantity * 3 - 20 BETWEEN 0 AND 100 THEN l_quantity * 3 - 20 END), 6) AS confidence FROM lineitem GROUP BY 1")
def _(t):
    return R.ocr_confidence(t.lineitem.select((F.col("l_orderkey") % 100).alias("page"), (F.col("l_quantity") * 3 - 20).cast("double").alias("confidence")))


# --- package and manifest joins ---------------------------------------------------
@P.add("join_package_files", "WITH a AS (SELECT s_name AS path, s_acctbal FROM supplier WHERE s_suppkey % 10 <> 1), b AS (SELECT s_name AS path, CASE WHEN s_suppkey % 10 = 2 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 10 <> 3) SELECT path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' WHEN a.s_acctbal = b.s_acctbal THEN 'ok' ELSE 'changed' END AS status FROM a FULL JOIN b USING (path)")
def _(t):
    a = t.supplier.where("s_suppkey % 10 <> 1").select(F.col("s_name").alias("path"), "s_acctbal")
    b = t.supplier.where("s_suppkey % 10 <> 3").select(F.col("s_name").alias("path"), F.when(F.col("s_suppkey") % 10 == 2, 0.0).otherwise(F.col("s_acctbal")).alias("s_acctbal"))
    return R.package_check(a, b, columns=("s_acctbal",))


def _files(t):
    return t.supplier.select(F.col("s_name").alias("path"), F.sha2("s_name", 256).alias("sha256"), F.length("s_name").cast("long").alias("size"), "s_suppkey")


@P.add("join_manifest_files", "SELECT s_name AS path, CASE WHEN s_suppkey % 4 = 0 THEN 'missing' WHEN s_suppkey % 4 = 1 THEN 'mismatch' ELSE 'ok' END AS status FROM supplier")
def _(t):
    f = _files(t)
    have = f.where("s_suppkey % 4 <> 0").select("path", F.when(F.col("s_suppkey") % 4 == 1, "0").otherwise(F.col("sha256")).alias("sha256"))
    return R.manifest_check(f.select("path", "sha256"), have)


@P.add("join_lock_audit", "SELECT s_name AS path, CASE s_suppkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'size' WHEN 2 THEN 'digest' WHEN 3 THEN 'symlink' ELSE 'verified' END AS status FROM supplier")
def _(t):
    f = _files(t)
    k = F.col("s_suppkey") % 5
    have = f.where(k != 0).select("path", F.when(k == 1, 0).otherwise(F.col("size")).alias("size"), F.when(k == 2, "0").otherwise(F.col("sha256")).alias("sha256"), (k == 3).alias("symlink"))
    return R.lock_audit(f.select("path", "size", "sha256"), have)


@P.add("scan_manifest", "SELECT sha256(s_name) AS sha256, s_name AS path FROM supplier")
def _(t):
    from lakeleaf.sources.files import manifest_lines

    lines = _files(t).select(F.concat_ws("  ", "sha256", "path").alias("value")).unionByName(t.spark.createDataFrame([("# comment",), ("",)], "value string"))
    return manifest_lines(lines)


@P.add("sink_manifest", "SELECT sha256(s_name) || '  ' || s_name AS value FROM supplier")
def _(t):
    from lakeleaf.sources.files import manifest_text

    return manifest_text(_files(t))


@P.add("files_inventory", "SELECT s_name AS path, sha256(s_name) AS sha256, CAST(length(s_name) AS BIGINT) AS size FROM supplier")
def _(t):
    return V.inventory(t.supplier.select(F.col("s_name").alias("path"), F.col("s_name").cast("binary").alias("content")))


@P.add("lock_inventory", "SELECT s_nationkey AS role, count(*) AS entries, CAST(sum(length(s_name)) AS BIGINT) AS bytes FROM supplier GROUP BY 1")
def _(t):
    return V.lock_inventory(t.supplier.select(F.col("s_nationkey").alias("role"), F.length("s_name").alias("size")))


# --- archive ------------------------------------------------------------------------
_RECORDS = "WITH r AS (SELECT doc_id AS seq, sha256(text) AS digest, octet_length(encode(text)) AS size, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL)"


def _records(t):
    return t.documents.where("text is not null").select(F.col("doc_id").alias("seq"), F.col("text").cast("binary").alias("body"), "source")


@P.add("agg_dedupe_payload", _RECORDS + " SELECT seq AS doc_id, digest, seq > first AND size > 512 AS is_revisit, CASE WHEN seq > first AND size > 512 THEN first END AS refers_to FROM r")
def _(t):
    return A.deduplicated(_records(t)).select(F.col("seq").alias("doc_id"), "digest", "is_revisit", "refers_to")


@P.add("agg_lineage", _RECORDS + " SELECT seq, seq > first AS revisit FROM r")
def _(t):
    return A.lineage(_records(t).select(F.col("seq").alias("sequence"), F.sha2("body", 256).alias("sha256"), F.octet_length("body").alias("bytes"))).select(F.col("sequence").alias("seq"), "revisit")


_OFFSETS = "SELECT source AS file, doc_id AS seq, octet_length(encode(text)) + 100 AS length, coalesce(sum(octet_length(encode(text)) + 100) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\" FROM documents WHERE text IS NOT NULL"


def _index_rows(t):
    return _records(t).select(F.col("source").alias("file"), "seq", (F.octet_length("body") + 100).cast("long").alias("length"))


@P.add("win_running_offset", f'WITH o AS ({_OFFSETS}) SELECT file, seq, CAST("offset" AS BIGINT) AS "offset" FROM o')
def _(t):
    return W.running_offset(_index_rows(t), "file", "seq", "length").select("file", "seq", "offset")


@P.add("sink_cdx", f"""WITH o AS ({_OFFSETS}) SELECT file, seq, 'com,example)/' || seq || ' 20240101000000 https://example.com/' || seq || ' text/html 200 ' || sha256(CAST(seq AS VARCHAR)) || ' - - ' || length || ' ' || CAST("offset" AS BIGINT) || ' ' || file AS line FROM o""")
def _(t):
    seq = F.col("seq").cast("string")
    rows = _index_rows(t).select("*", F.concat(F.lit("https://example.com/"), seq).alias("url"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("text/html; charset=x").alias("mime"), F.lit(200).alias("status"), F.sha2(seq, 256).alias("digest"))
    return A.cdx_lines(rows).select("file", "seq", "line")


@P.add("scan_cdx", "SELECT doc_id, 'https://example.com/' || doc_id AS url, CAST(100 + doc_id AS BIGINT) AS length FROM documents WHERE doc_id % 3 <> 0")
def _(t):
    seq = F.col("doc_id").cast("string")
    full = F.concat_ws(" ", F.concat(F.lit("com,example)/"), seq), F.lit("20240101000000"), F.concat(F.lit("https://example.com/"), seq), F.lit("text/html 200 d - -"), (F.col("doc_id") + 100).cast("string"), F.lit("0 f.warc"))
    lines = t.documents.select(F.when(F.col("doc_id") % 3 == 0, F.lit("too short")).otherwise(full).alias("value")).unionByName(t.spark.createDataFrame([(A.CDX_HEADER,), ("",)], "value string"))
    return A.parsed_cdx(lines).select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("doc_id"), "url", "length")


@P.add("join_cdx_spans", "SELECT count(*) AS bad FROM documents WHERE text IS NOT NULL AND doc_id % 50 = 7")
def _(t):
    rows = W.running_offset(_index_rows(t), "file", "seq", "length")
    cdx = rows.select(F.col("file").alias("filename"), F.when(F.col("seq") % 50 == 7, F.col("offset") + 1).otherwise(F.col("offset")).alias("offset"), "length")
    return A.bad_spans(cdx, rows).agg(F.count("*").alias("bad"))


@P.add("sink_consolidate", "SELECT count(DISTINCT text) AS payloads, count(*) AS manifest FROM documents WHERE text IS NOT NULL")
def _(t):
    payloads, manifest = A.consolidated(_records(t))
    return payloads.agg(F.count("*").alias("payloads")).crossJoin(manifest.agg(F.count("*").alias("manifest")))


@P.add("sink_export_dir", f"""WITH p AS ({PAGES}), n AS (SELECT page_id, ltrim(CASE WHEN path = '' THEN '/index.html' WHEN ends_with(path, '/') THEN path || 'index.html' ELSE path END, '/') || CASE WHEN query = '' THEN '' ELSE '__q_' || left(sha256(query), 12) END AS path FROM p)
 SELECT page_id, path, count(*) OVER (PARTITION BY path) > 1 AS collision FROM n""")
def _(t):
    return A.export_paths(t.pages.select("page_id", "url")).select("page_id", "path", "collision")


def _container(t, above=A.REVISIT_ABOVE):
    """Response and revisit records of documents in one container a source, as a scan gives them; later copies of more than ``above`` bytes are revisits."""
    rows = A.deduplicated(_records(t), above=above)
    rows = W.running_offset(rows.withColumn("length", F.col("size") + 100), "source", "seq", "length")
    rid = lambda c: F.concat(F.lit("<r"), F.col(c).cast("string"), F.lit(">"))
    uri = lambda c: F.concat(F.lit("https://example.com/"), F.col(c).cast("string"))
    return rows.select(F.lit("all.warc").alias("file"), F.col("seq").alias("offset"), F.when(F.col("is_revisit"), "revisit").otherwise("response").alias("type"), rid("seq").alias("record_id"), uri("seq").alias("target_uri"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), rid("refers_to").alias("refers_to"), uri("refers_to").alias("refers_uri"), (F.sha2("body", 256) == F.col("digest")).alias("payload_ok"), F.lit(None).cast("string").alias("error"))


@P.add("join_revisit", _RECORDS + " SELECT seq AS \"offset\", first AS source_offset, false AS unresolved FROM r WHERE seq > first AND size > 512")
def _(t):
    return A.resolved_revisits(_container(t)).select("offset", "source_offset", "unresolved")


@P.add("agg_warc_types", _RECORDS + " SELECT count(*) AS records, count(*) FILTER (NOT (seq > first AND size > 512)) AS response, count(*) FILTER (seq > first AND size > 512) AS revisit, 0 AS corrupt, true AS passed FROM r")
def _(t):
    return A.type_counts(_container(t)).select("records", "response", "revisit", F.col("corrupt").cast("int").alias("corrupt"), "passed")


@P.add("agg_payload_verify", "WITH r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL) SELECT 'https://example.com/' || doc_id AS target_uri FROM r WHERE doc_id = first AND doc_id % 7 = 3")
def _(t):
    rows = _container(t, above=-1)  # every seventh payload is damaged; later copies of any size, empty ones too, are revisits, which do not count
    return A.payload_mismatches(rows.withColumn("payload_ok", F.col("payload_ok") & (F.col("offset") % 7 != 3))).select("target_uri")


@P.add("agg_archive_digest", "SELECT sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS digest FROM documents WHERE text IS NOT NULL")
def _(t):
    return A.ordered_digest(_records(t), "seq", "body")


@P.add("scan_warc_js", f"WITH p AS ({PAGES}) SELECT count(DISTINCT scheme || '://' || lower(host) || path || '?' || query) AS addresses FROM p")
def _(t):
    rows = t.pages.select(F.lit("f").alias("file"), F.col("page_id").alias("offset"), F.lit("response").alias("type"), F.col("url").alias("target_uri"))
    return A.last_by_url(rows).agg(F.count("*").alias("addresses"))


@P.add("join_redirect_chain", "WITH RECURSIVE l AS (SELECT n_nationkey AS s, n_nationkey // 2 AS t FROM nation WHERE n_nationkey > 1), c(id, final, hops) AS (SELECT s, t, 1 FROM l UNION ALL SELECT c.id, l.t, c.hops + 1 FROM c JOIN l ON l.s = c.final) SELECT id, arg_max(final, hops) AS final, max(hops) AS hops FROM c GROUP BY id")
def _(t):
    links = t.nation.where("n_nationkey > 1").select(F.col("n_nationkey").alias("source"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("target"))
    return A.redirect_chains(links, 6)


# --- crawl --------------------------------------------------------------------------
@P.add("win_attempt", f"WITH a AS (SELECT event_id AS seq, user_id FROM events) SELECT seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS attempt FROM a")
def _(t):
    rows = t.events.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("url"))
    return A.attempts(rows).select("seq", F.col("attempt").cast("long").alias("attempt"))


@P.add("stream_retry", f"WITH a AS ({AUDIT}), r AS (SELECT seq, status, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM a) SELECT count(*) AS requeued FROM r WHERE (status = 429 OR status >= 500) AND k <= 3")
def _(t):
    return K.with_attempts(t.audit().withColumn("url", F.col("user_id").cast("string"))).where("requeue").agg(F.count("*").alias("requeued"))


@P.add("filter_retryable", f"WITH a AS ({AUDIT}) SELECT url FROM a WHERE status IN (429, 503) ORDER BY seq LIMIT 3")
def _(t):
    a = t.audit()
    return K.retryable(a.select("url", "status", F.lit(None).cast("string").alias("error_type")), a.select("seq", "url")).select("url")


@P.add("sort_frontier", "SELECT event_id, row_number() OVER (ORDER BY user_id % 3, user_id % 5, event_id) AS rank FROM events")
def _(t):
    return K.ordered_frontier(t.events.select((F.col("user_id") % 3).alias("tier"), (F.col("user_id") % 5).alias("depth"), F.col("event_id").alias("seq"))).select(F.col("seq").alias("event_id"), "rank")


@P.add("sort_fifo", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rank FROM events")
def _(t):
    return K.fifo(t.events.select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "rank")


@P.add("win_first_seen", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def _(t):
    return W.first_seen(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


_TREE = "WITH RECURSIVE l AS (SELECT 'https://example.com/p' || doc_id AS s, 'https://example.com/p' || (doc_id * 2 + k) AS t FROM documents, (VALUES (1), (2)) v(k) WHERE doc_id * 2 + k < (SELECT count(*) FROM documents)), f(url, depth) AS (SELECT 'https://example.com/p0', 0 UNION ALL SELECT l.t, f.depth + 1 FROM f JOIN l ON l.s = f.url WHERE f.depth <= 4)"


def _tree(t):
    n = t.documents.count()
    kids = t.documents.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("doc_id", (F.col("doc_id") * 2 + F.col("k")).alias("c")).where(F.col("c") < n)
    at = lambda c: F.concat(F.lit("https://example.com/p"), F.col(c).cast("string"))
    return kids.select(at("doc_id").alias("source"), at("c").alias("target"))


@P.add("stream_frontier", _TREE + " SELECT url, depth, CASE WHEN depth > 4 THEN 'excluded' ELSE 'queued' END AS state FROM f")
def _(t):
    seeds = t.spark.createDataFrame([("https://example.com/p0",)], "url string")
    return K.frontier(seeds, _tree(t), 4, ["example.com"]).select("url", "depth", "state")


@P.add("stream_enqueue", _TREE + " SELECT depth, count(*) AS n FROM f WHERE depth <= 4 GROUP BY depth")
def _(t):
    seeds = t.spark.createDataFrame([("https://EXAMPLE.com:443/p0#x",)], "url string")
    return K.frontier(seeds, _tree(t), 4, ["example.com"]).where("state = 'queued'").groupBy("depth").agg(F.count("*").alias("n"))


@P.add("filter_max_pages", _TREE + " SELECT least(count(*), 20) AS queued, greatest(count(*) - 20, 0) AS pending FROM f WHERE depth <= 4")
def _(t):
    seeds = t.spark.createDataFrame([("https://example.com/p0",)], "url string")
    return K.frontier(seeds, _tree(t), 4, ["example.com"], max_pages=20).agg(F.count_if(F.col("state") == "queued").alias("queued"), F.count_if(F.col("state") == "pending").alias("pending"))


# --- rules --------------------------------------------------------------------------
RULES = {
    "version": 1,
    "rules": [
        {"id": "no-html", "match": {"kind": "asset"}, "decision": {"download": False}},
        {"id": "small", "match": {"path_prefix": "/en/", "max_bytes": 5000}, "decision": {"traverse": False}},
        {"id": "deep", "match": {"min_depth": 4}, "decision": {"discover": False}},
        {"id": "typed", "match": {"mime": "text/html", "host": "m.example.org"}, "decision": {"traverse": True}},
    ],
}


def _resources(t):
    p = t.pages
    return p.select("page_id", "url", F.when(urls.is_asset("url", [".html"]), "asset").otherwise("page").alias("kind"), (F.col("page_id") % 6).cast("long").alias("depth"), F.lit(None).cast("string").alias("mime"), F.when(F.col("page_id") % 5 != 0, F.length("html").cast("long")).alias("bytes"))


_RULED = f"""WITH p AS ({PAGES}), r AS (SELECT page_id, host = 'example.com' OR ends_with(host, '.example.com') AS ok, CASE WHEN ends_with(path, '.html') THEN 1 WHEN starts_with(path, '/en/') AND page_id % 5 = 0 THEN 20 WHEN starts_with(path, '/en/') AND length(html) <= 5000 THEN 2 WHEN page_id % 6 >= 4 THEN 3 ELSE 0 END AS k FROM p)
 SELECT page_id, CASE WHEN NOT ok THEN NULL ELSE CASE k WHEN 1 THEN 'no-html' WHEN 2 THEN 'small' WHEN 20 THEN 'small' WHEN 3 THEN 'deep' END END AS rule_id, CASE WHEN NOT ok THEN 'out_of_scope' WHEN k = 20 THEN 'needs_metadata' ELSE 'decided' END AS state,
 ok AND k <> 3 AS discover, ok AND k NOT IN (1, 3, 20) AS download, ok AND k NOT IN (1, 2, 3, 20) AS traverse FROM r"""


@P.add("rules_first_match", _RULED)
def _(t):
    r = _resources(t)
    d = r.select("page_id", U.decision(RULES, urls.in_scope("url", ["example.com"])).alias("d"))
    return d.select("page_id", "d.rule_id", "d.state", "d.discover", "d.download", "d.traverse")


@P.add("rules_preview", f"WITH x AS ({_RULED}) SELECT state, count(*) AS n FROM x GROUP BY state")
def _(t):
    return U.preview(_resources(t), RULES, ["example.com"]).groupBy("decision.state").agg(F.count("*").alias("n"))


@P.add("join_rule_match", f"WITH x AS ({_RULED}) SELECT coalesce(rule_id, 'none') AS rule_id, count(*) AS n FROM x GROUP BY 1")
def _(t):
    d = _resources(t).select(U.decision(RULES, urls.in_scope("url", ["example.com"])).alias("d"))
    return d.groupBy(F.coalesce("d.rule_id", F.lit("none")).alias("rule_id")).agg(F.count("*").alias("n"))


@P.add("rules_validate", "SELECT unnest(['no-html', 'small', 'deep', 'typed']) AS id")
def _(t):
    return t.spark.createDataFrame([(r["id"],) for r in U.validated(RULES)], "id string")


@P.add("schema_check", "SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN '$.k: out of range' END AS error FROM events")
def _(t):
    schema = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 50}}}
    return t.events.select("event_id", X.schema_check("props", schema).alias("error"))


# --- parsers ------------------------------------------------------------------------
@P.add("html_discover_links")
def _(t):
    return D.link_rows(t.pages).select("source", "position", "target", "kind")


@P.add("udtf_discover", f"WITH p AS ({PAGES}), l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href=\"(/[^\"#?&]*)\"', 1)) AS href FROM p) SELECT page_id, count(*) AS n FROM l GROUP BY page_id")
def _(t):
    nav = t.pages.select("page_id", "url", F.array_join(F.regexp_extract_all("html", F.lit('(<a href="/[^"#?&]*")'), F.lit(1)), ">").alias("html"))
    rows = nav.select("page_id", F.explode(D.links(F.concat("html", F.lit(">")), F.lit("text/html"), F.col("url"))["resources"]).alias("r"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n"))


@P.add("css_urls", f"WITH p AS ({PAGES}) SELECT page_id, scheme || '://' || host || unnest(['/i/' || page_id || '.png', '/s' || (page_id % 5) || '.css', '/q(' || page_id || ').gif']) AS url FROM p")
def _(t):
    css = F.concat(F.lit("/* url(no) */ a{background:url('/i/"), F.col("page_id").cast("string"), F.lit(".png')} b{content:\"url(no)\"} @import \"/s"), (F.col("page_id") % 5).cast("string"), F.lit(".css\"; c{background:url(/q\\28 "), F.col("page_id").cast("string"), F.lit("\\29.gif)}"))
    return t.pages.select("page_id", F.explode(D.links(css, F.lit("text/css"), F.col("url"))["resources"]).alias("r")).select("page_id", F.col("r.url").alias("url"))


@P.add("srcset_parse", f"WITH p AS ({PAGES}) SELECT page_id, scheme || '://' || host || unnest(['/a' || page_id || '.png', '/b' || (page_id % 3) || '.png']) AS url, 'asset' AS kind FROM p")
def _(t):
    html = F.concat(F.lit('<img srcset="/a'), F.col("page_id").cast("string"), F.lit(".png 1x, /b"), (F.col("page_id") % 3).cast("string"), F.lit('.png 2x, data:image/png;base64,AA== 3x">'))
    return t.pages.select("page_id", F.explode(D.links(html, F.lit("text/html"), F.col("url"))["resources"]).alias("r")).select("page_id", "r.url", "r.kind")


@P.add("html_visible_text")
def _(t):
    return t.pages.select("page_id", F.sha2(X.visible("html"), 256).alias("text_sha256"))


@P.add("udf_extract")
def _(t):
    return t.pages.select("page_id", X.extract(F.col("html").cast("binary"), F.lit("text/html")).alias("x")).select("page_id", "x.status", "x.output_hash", F.size("x.locators").alias("lines"))


@P.add("stream_sitemap", "SELECT doc_id, 'https://example.com/p' || doc_id AS url, 'page' AS kind FROM documents")
def _(t):
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://example.com/p'), F.col("doc_id").cast("string"), F.lit("#x</loc></url></urlset>"))
    rows = t.documents.select("doc_id", F.explode(D.sitemap(xml, F.lit("https://example.com/sitemap.xml"), ["example.com"])["entries"]).alias("e"))
    return rows.select("doc_id", "e.url", "e.kind")


@P.add("udtf_sitemap", "SELECT doc_id % 3 AS k, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    host = F.when(F.col("doc_id") % 3 == 0, "other.example").otherwise("example.com")
    xml = F.concat(F.lit("<sitemapindex><sitemap><loc>https://"), host, F.lit("/s.xml</loc></sitemap></sitemapindex>"))
    return t.documents.select((F.col("doc_id") % 3).alias("k"), F.explode(D.sitemap(xml, F.lit("https://example.com/x.xml"), ["example.com"])["entries"]).alias("e")).groupBy("k").agg(F.count("*").alias("n"))


@P.add("parse_robots", "SELECT event_id, ['/x', '/u' || user_id] AS rules FROM events")
def _(t):
    text = F.concat(F.lit("User-agent: *\nDisallow: /x # no\nDisallow: /u"), F.col("user_id").cast("string"), F.lit("\nUser-agent: other\nDisallow: /\n"))
    return t.events.select("event_id", D.robots_rules_col(text).alias("rules"))


@P.add("filter_robots", f"WITH p AS ({PAGES}) SELECT page_id, starts_with(path, '/en/') OR (starts_with(path, '/') AND contains(path || CASE WHEN query = '' THEN '' ELSE '?' || query END, 'ref=')) AS denied FROM p")
def _(t):
    robots = t.pages.select(F.concat(urls.parts("url")["scheme"], F.lit("://"), urls.parts("url")["netloc"]).alias("origin")).distinct().withColumn("rules", F.array(F.lit("/en/"), F.lit("/*ref=")))
    return K.robots_gate(t.pages.select("page_id", "url"), robots).select("page_id", F.col("robots_denied").alias("denied"))


@P.add("scan_robots", "SELECT event_type AS origin, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 0 ELSE 1 END AS rules FROM (SELECT DISTINCT event_type FROM events)")
def _(t):
    e = F.col("event_type")
    fetches = t.events.select("event_type").distinct().select(e.alias("origin"), F.when(e == "view", 200).when(e == "click", 404).otherwise(500).alias("status"), F.lit("User-agent: *\nDisallow: /a").alias("body"))
    return D.robots_table(fetches).select("origin", F.size("rules").alias("rules"))


@P.add("canonical_json")
def _(t):
    return t.events.select("event_id", X.canonical_json("props")["value"].alias("json"))


@P.add("json_validate", "SELECT event_id, event_id % 2 = 0 AS ok FROM events")
def _(t):
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise('{"k":9007199254740993}')
    return t.events.select("event_id", X.canonical_json(text)["ok"].alias("ok"))


@P.add("json_equal", "SELECT event_id, event_id % 2 = 0 AS same FROM events")
def _(t):
    other = F.when(F.col("event_id") % 2 == 0, F.lit('{"a":1.0,"b":[true]}')).otherwise('{"a":true,"b":[true]}')
    return t.events.select("event_id", X.json_same(F.lit('{"b":[true],"a":1}'), other).alias("same"))


@P.add("scan_receipt_strict", "SELECT event_id, event_id % 2 = 0 AS ok, CASE WHEN event_id % 2 = 0 THEN sha256(props) END AS sha256 FROM events")
def _(t):
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise('{"k":1,"k":2}')
    r = t.events.select("event_id", X.receipt_identity(text).alias("r"))
    return r.select("event_id", "r.ok", F.col("r.value").alias("sha256"))


@P.add("profile_render", "SELECT event_id, props AS json FROM events")
def _(t):
    return t.events.select("event_id", F.regexp_replace(X.sorted_json("props")["value"], ":", ": ").alias("json"))


@P.add("find_sequence", "SELECT page_id, CAST(CASE WHEN instr(html, '</head>') > 0 THEN octet_length(encode(left(html, instr(html, '</head>') - 1))) + 1 ELSE 0 END AS INTEGER) AS at FROM pages")
def _(t):
    return t.pages.select("page_id", A.find_sequence("html", b"</head>").alias("at"))


@P.add("html_rewrite_replay", "SELECT page_id, len(regexp_extract_all(html, '<a href=\"/[^\"#?&]*\"')) AS links FROM pages")
def _(t):
    from lakeleaf.operators.replay import rewritten

    rows = t.pages.select("page_id", rewritten("html").alias("h"))
    return rows.select("page_id", F.size(F.regexp_extract_all("h", F.lit('(<a data-archive-href="/[^"#?&]*")'), F.lit(1))).cast("long").alias("links"))


@P.add("api_modes", "SELECT unnest(['offline_reading', 'preservation', 'rendered_optional']) AS mode")
def _(t):
    from lakeleaf.engine import MODES

    return t.spark.createDataFrame([(m,) for m in sorted(MODES)], "mode string")


@P.add("lock_validate", "SELECT s_name AS path, CASE s_suppkey % 4 WHEN 0 THEN 'scheme' WHEN 1 THEN 'digest' WHEN 2 THEN 'size' END AS problem FROM supplier WHERE s_suppkey % 4 <> 3")
def _(t):
    k = F.col("s_suppkey") % 4
    lock = t.supplier.select(F.col("s_name").alias("role"), F.col("s_name").alias("path"), F.when(k == 0, "http://x").otherwise("https://x").alias("url"), F.when(k == 1, "0").otherwise(F.sha2("s_name", 256)).alias("sha256"), F.when(k == 2, 0).otherwise(9).alias("size"))
    return V.lock_problems(lock)


@P.add("acceptance_status", "SELECT s_nationkey AS grp, CASE WHEN min(s_acctbal) < 0 THEN 'failed' WHEN min(s_acctbal) < 2000 THEN 'pending' ELSE 'passed' END AS status FROM supplier GROUP BY 1")
def _(t):
    m = t.supplier.select(F.col("s_nationkey").alias("grp"), F.when(F.col("s_acctbal") < 0, "failed").when(F.col("s_acctbal") < 2000, "pending").otherwise("passed").alias("status"))
    return V.acceptance(m)


@P.add("receipt_bind", "SELECT s_name AS path, s_suppkey % 3 <> 0 AS bound FROM supplier")
def _(t):
    f = _files(t)
    return V.bound(f.select("path", "sha256", "size"), f.select("path", F.when(F.col("s_suppkey") % 3 == 0, "0").otherwise(F.col("sha256")).alias("sha256"), "size"))


def _coverage(t):
    """Coverage of line items as if quantities were pages."""
    gone = F.when(F.col("l_linenumber") > 1, F.sequence(F.lit(1), F.col("l_linenumber") - 1)).otherwise(F.array().cast("array<int>"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.struct(F.lit("text_layer").alias("scope"), F.lit(40).alias("total"), F.col("l_quantity").cast("int").alias("visited"), (F.col("l_quantity").cast("int") - F.col("l_linenumber") + 1).alias("filled"), gone.alias("missing"), (F.col("l_quantity") * 2_000_000).cast("long").alias("pixels")).alias("c"))


@P.add("validate_text_coverage", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity <= 40 AND l_quantity - l_linenumber + 1 >= 0 AS good FROM lineitem")
def _(t):
    return _coverage(t).select("l_orderkey", "l_linenumber", "l_partkey", V.text_coverage_ok(F.col("c")).alias("good"))


@P.add("validate_ocr_coverage", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity <= 16 AND l_quantity >= l_linenumber AS good FROM lineitem WHERE l_quantity >= l_linenumber")
def _(t):
    c = F.col("c")
    pages = F.when(c["filled"] > 0, F.sequence(F.col("l_linenumber"), F.col("l_linenumber") + c["filled"] - 1)).otherwise(F.array().cast("array<int>"))
    return _coverage(t).where("c.filled > 0").select("l_orderkey", "l_linenumber", "l_partkey", V.ocr_coverage_ok(c, pages, F.lit("partial")).alias("good"))


QUERIES, ORACLE_SQL = P.queries, P.sql
