"""URL, header and text function queries."""

from pyspark.sql import functions as F

from lakeleaf.functions import http, urls
from lakeleaf.operators import extract as X
from lakeleaf.operators.crawl import unvisited
from lakeleaf.plans.base import ACQUISITIONS, AUDIT, PAGES, Plans

P = Plans()
_SORTED = "array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: [split_part(x, '=', 1), x])), lambda p: p[2]), '&')"
_KEPT = "array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')), lambda x: [split_part(x, '=', 1), x])), lambda p: p[2]), '&')"


def _q(expr: str) -> str:
    return f"scheme || '://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN {expr} = '' THEN '' ELSE '?' || {expr} END"


@P.add("url_canonicalize", f"WITH p AS ({PAGES}) SELECT page_id, {_q(_KEPT)} AS canonical FROM p")
def _(t):
    return t.pages.select("page_id", urls.canonical("url").alias("canonical"))


@P.add("url_normalize_replay", f"WITH p AS ({PAGES}) SELECT page_id, {_q(_SORTED)} AS key FROM p")
def _(t):
    return t.pages.select("page_id", urls.replay_key("url").alias("key"))


@P.add("url_to_surt", f"WITH p AS ({PAGES}) SELECT page_id, array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS surt FROM p")
def _(t):
    return t.pages.select("page_id", urls.surt("url").alias("surt"))


@P.add("url_sitemap_identity", f"WITH p AS ({PAGES}) SELECT page_id, {_q('query')} AS identity FROM p")
def _(t):
    return t.pages.select("page_id", urls.sitemap_identity("url").alias("identity"))


@P.add("url_http_identity", "SELECT page_id, length(url) <= 8192 AND regexp_matches(url, '^https?://[^/?#@]+') AND NOT regexp_matches(url, '[\\x00-\\x20\\x7F]') AS good FROM pages")
def _(t):
    return t.pages.select("page_id", urls.is_http_identity("url").alias("good"))


@P.add("url_is_asset", f"WITH p AS ({PAGES}) SELECT page_id, regexp_matches(lower(path), '\\.(html|pdf)$') AS asset FROM p")
def _(t):
    return t.pages.select("page_id", urls.is_asset("url", [".html", ".pdf"]).alias("asset"))


@P.add("url_redact", f"WITH p AS ({PAGES}) SELECT page_id, scheme || '://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END AS redacted FROM p")
def _(t):
    return t.pages.select("page_id", urls.redacted("url").alias("redacted"))


_SECTION = "CASE WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) = 0 THEN '/root' ELSE '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:2], '/') END"


@P.add("url_top_section", f"WITH p AS ({PAGES}) SELECT {_SECTION} AS section, count(*) AS n FROM p GROUP BY 1")
def _(t):
    return t.pages.groupBy(urls.top_section("url").alias("section")).agg(F.count("*").alias("n"))


@P.add("url_resolve", f"WITH p AS ({PAGES}), l AS (SELECT page_id, scheme, host, unnest(regexp_extract_all(html, '<a href=\"(/[^\"#?&]*)\"', 1)) AS href FROM p) SELECT DISTINCT page_id, scheme || '://' || host || href AS target FROM l")
def _(t):
    links = t.pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"#?&]*)"'), F.lit(1))).alias("href"))
    return links.select("page_id", urls.resolved("href", "url").alias("target")).distinct()


@P.add("url_resolve_archive", f"WITH p AS ({PAGES}) SELECT page_id, scheme || '://' || host || '/x?a=1&b=2' AS target FROM p")
def _(t):
    return t.pages.select("page_id", urls.resolved_in_archive(F.lit("/x?b=2&a=1#f"), F.col("url")).alias("target"))


@P.add("safe_path", f"""WITH p AS ({PAGES}), n AS (SELECT page_id, query, CASE WHEN path = '' THEN '/index.html' WHEN ends_with(path, '/') THEN path || 'index.html' ELSE path END AS f FROM p)
 SELECT page_id, left(ltrim(f, '/') || CASE WHEN query = '' THEN '' ELSE '__q_' || left(sha256(query), 12) END, 240) AS path FROM n""")
def _(t):
    return t.pages.select("page_id", urls.safe_path("url").alias("path"))


@P.add("filter_scope", f"WITH p AS ({PAGES}) SELECT page_id, url FROM p WHERE host = 'example.com' OR ends_with(host, '.example.com')")
def _(t):
    return t.pages.where(urls.in_scope("url", ["example.com"])).select("page_id", "url")


@P.add("filter_auth_scope", f"WITH p AS ({PAGES}) SELECT count(*) AS n FROM p WHERE ends_with(host, '.example.org') OR ends_with(host, '.example.net')")
def _(t):
    return t.pages.where(urls.in_scope("url", ["example.org", "example.net"])).agg(F.count("*").alias("n"))


@P.add("filter_path_literals", f"WITH p AS ({PAGES}) SELECT page_id FROM p WHERE NOT contains(lower(path), '.html') AND (contains(lower(path), '/en/') OR contains(lower(path), '/de/'))")
def _(t):
    return t.pages.where(urls.path_allowed("url", [".html"], ["/en/", "/de/"])).select("page_id")


@P.add("filter_trap", f"WITH p AS ({PAGES}), s AS (SELECT page_id, list_filter(string_split(path || path || path, '/'), lambda x: x <> '') AS g FROM p) SELECT page_id, len(list_filter(g, lambda x: len(list_filter(g, lambda y: y = x)) >= 3)) > 0 AS trapped FROM s")
def _(t):
    p = urls.parts("url")
    return t.pages.select("page_id", urls.is_trap(F.concat(F.lit("https://e.x"), p["path"], p["path"], p["path"])).alias("trapped"))


@P.add("filter_url_list", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'blog')")
def _(t):
    return t.pages.where(urls.text_contains("url", "blog")).select("page_id", "url")


@P.add("filter_depth", f"WITH p AS ({PAGES}) SELECT page_id FROM p WHERE len(list_filter(string_split(path, '/'), lambda x: x <> '')) <= 2")
def _(t):
    depth = F.size(F.filter(F.split(urls.parts("url")["path"], "/"), lambda x: x != ""))
    return t.pages.where(depth <= 2).select("page_id")


@P.add("scope_hosts", f"WITH p AS ({PAGES}), h AS (SELECT DISTINCT lower(host) AS host FROM p ORDER BY 1 LIMIT 9) SELECT host FROM h UNION SELECT 'www.' || min(host) FROM h")
def _(t):
    hosts = sorted(r.host for r in t.pages.select(urls.host("url").alias("host")).distinct().orderBy("host").limit(9).collect())  # a crawl's hosts are parameters, 32 at most
    return t.spark.createDataFrame([(h,) for h in urls.scope_hosts(hosts[::-1], {hosts[0]: ["www." + hosts[0]]})], "host string")


@P.add("set_union_hosts", f"WITH p AS ({PAGES}), h AS (SELECT array_agg(DISTINCT host) AS a FROM p) SELECT unnest(list_sort(list_distinct(list_concat(a, ['extra.example'])))) AS host FROM h")
def _(t):
    hosts = t.pages.select(urls.host("url").alias("host")).distinct()
    return hosts.agg(F.collect_set("host").alias("a")).select(F.explode(F.array_sort(F.array_union("a", F.array(F.lit("extra.example"))))).alias("host"))


@P.add("set_union_flags", "SELECT doc_id, CASE WHEN toxic = 1 THEN ['low', 'toxic'] ELSE ['low'] END AS flags FROM labels WHERE quality = 0")
def _(t):
    return t.labels.where("quality = 0").select("doc_id", urls.union_flags(F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))), F.array(F.lit("low"))).alias("flags"))


@P.add("set_difference_keys", "SELECT event_id, list_sort(list_filter(json_keys(props), lambda x: x NOT IN ('v', 'w'))) AS unknown FROM events")
def _(t):
    return t.events.select("event_id", urls.unknown_keys("props", ("v", "w")).alias("unknown"))


@P.add("set_known_minus_backlog", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return unvisited(t.documents.select(F.col("doc_id").alias("url")), t.labels.select(F.col("doc_id").alias("url"))).select(F.col("url").alias("doc_id"))


@P.add("set_visited_minus", f"WITH p AS ({PAGES}), l AS (SELECT DISTINCT scheme || '://' || host || unnest(regexp_extract_all(html, '<a href=\"(/[^\"#?&]*)\"', 1)) AS url FROM p) SELECT url FROM l WHERE url NOT IN (SELECT url FROM pages)")
def _(t):
    links = t.pages.select("url", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"#?&]*)"'), F.lit(1))).alias("href"))
    return unvisited(links.select(urls.resolved("href", "url").alias("url")).distinct(), t.pages)


# --- headers, statuses, dates ---------------------------------------------------
@P.add("retry_classify", f"WITH a AS ({AUDIT}) SELECT CASE WHEN status IN (0,408,425,429,500,502,503,504) THEN 'transient' WHEN status IN (401,403) THEN 'access_denied' WHEN status = 404 THEN 'not_found' WHEN status BETWEEN 400 AND 499 THEN 'permanent_client' ELSE 'unknown' END AS class, count(*) AS n FROM a GROUP BY 1")
def _(t):
    return t.audit().groupBy(http.retry_class("status").alias("class")).agg(F.count("*").alias("n"))


@P.add("failure_countable", f"WITH a AS ({AUDIT}) SELECT status = 0 OR status = 429 OR status BETWEEN 500 AND 599 AS countable, count(*) AS n FROM a GROUP BY 1")
def _(t):
    return t.audit().groupBy(http.is_countable_failure("status").alias("countable")).agg(F.count("*").alias("n"))


@P.add("error_classify", "SELECT CASE event_type WHEN 'view' THEN 'timeout' WHEN 'click' THEN 'connection' WHEN 'error' THEN 'tls' WHEN 'signup' THEN 'dns' ELSE 'unclassified' END AS class, count(*) AS n FROM events GROUP BY 1")
def _(t):
    e = F.col("event_type")
    cause = F.when(e == "view", "TimeoutError").when(e == "click", "ConnectionResetError").when(e == "error", "SSLError").when(e == "signup", "gaierror").otherwise("ValueError")
    return t.events.groupBy(http.error_class(cause).alias("class")).agg(F.count("*").alias("n"))


@P.add("date_warc", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date FROM events")
def _(t):
    return t.events.select("event_id", http.warc_date("ts").alias("date"))


@P.add("date_cdx", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS date FROM events")
def _(t):
    return t.events.select("event_id", http.cdx_date("ts").alias("date"))


@P.add("retry_after_parse", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 100) * 1000 WHEN event_id % 3 = 1 THEN greatest(1000, 60000 - (event_id % 120) * 1000) END AS wait FROM events")
def _(t):
    e = t.events.select("event_id", F.timestamp_seconds(F.lit(1704067200) + F.col("event_id") % 120).alias("now"))
    value = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 100).cast("string")).when(F.col("event_id") % 3 == 1, "Mon, 01 Jan 2024 00:01:00 GMT").otherwise("soon")
    return e.select("event_id", http.retry_after_ms(value, F.col("now")).alias("wait"))


@P.add("retry_delay", "SELECT event_id, greatest(least(power(2.0, event_id % 9), 60.0), CASE WHEN event_id % 2 = 0 THEN 45.0 ELSE 0.0 END) AS delay FROM events")
def _(t):
    return t.events.select("event_id", http.retry_delay_s(F.col("event_id") % 9, F.when(F.col("event_id") % 2 == 0, 45.0)).alias("delay"))


@P.add("parse_headers", "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who FROM events")
def _(t):
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nX-Kind: first\r\nx-kind:  "), F.col("event_type"), F.lit(" \r\nX-Who: "), F.col("user_id").cast("string"))
    h = t.events.select("event_id", http.header_map(block).alias("h"))
    return h.select("event_id", F.col("h")["x-kind"].alias("kind"), F.col("h")["x-who"].alias("who"))


@P.add("header_normalize", "SELECT event_id, event_type AS value FROM events")
def _(t):
    return t.events.select("event_id", http.lower_names(F.create_map(F.lit("X-Kind"), F.col("event_type")))["x-kind"].alias("value"))


@P.add("header_single", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS value FROM events")
def _(t):
    return t.events.select("event_id", http.single_value(F.array("event_type", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("other"))).alias("value"))


@P.add("header_rule_metadata", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'text/html' END AS mime, CASE WHEN event_id % 2 = 0 THEN user_id END AS bytes FROM events")
def _(t):
    types = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("text/html"), F.lit("image/png"))).otherwise(F.array(F.lit("Text/HTML; charset=x"), F.lit("text/html")))
    sizes = F.array(F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("-1"))
    m = t.events.select("event_id", http.rule_metadata(F.create_map(F.lit("content-type"), types, F.lit("content-length"), sizes)).alias("m"))
    return m.select("event_id", "m.mime", "m.bytes")


@P.add("header_redact", "SELECT event_id, '[REDACTED]' AS cookie, event_type AS other FROM events")
def _(t):
    h = t.events.select("event_id", http.redacted_headers(F.create_map(F.lit("Cookie"), F.lit("a=1"), F.lit("Other"), F.col("event_type"))).alias("h"))
    return h.select("event_id", F.col("h")["Cookie"].alias("cookie"), F.col("h")["Other"].alias("other"))


@P.add("parse_http_block", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 200 + CAST(user_id % 300 AS INTEGER) ELSE 200 END AS status FROM events")
def _(t):
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("HTTP/1.1 "), (200 + F.col("user_id") % 300).cast("string"), F.lit(" Response\r\nA: 1"))).otherwise("A: 1")
    return t.events.select("event_id", http.http_status(line).alias("status"))


@P.add("mime_clean", "SELECT event_id, 'text/' || event_type AS mime FROM events")
def _(t):
    return t.events.select("event_id", http.mime(F.concat(F.lit(" Text/"), F.upper("event_type"), F.lit(" ; charset=utf-8"))).alias("mime"))


@P.add("mime_guess", f"WITH p AS ({PAGES}) SELECT page_id, CASE WHEN ends_with(path, '.html') THEN 'text/html' ELSE 'application/octet-stream' END AS mime FROM p")
def _(t):
    return t.pages.select("page_id", http.guessed_mime(urls.parts("url")["path"]).alias("mime"))


@P.add("decode_payload", "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN sha256(text) END AS digest, doc_id % 5 = 0 AS refused FROM documents WHERE text IS NOT NULL")
def _(t):
    @F.udf("binary", useArrow=True)
    def packed(text):
        import gzip
        import zlib

        return zlib.compress(gzip.compress(text.encode(), mtime=0))

    rows = t.documents.where("text is not null").select("doc_id", http.decoded_payload(packed("text"), F.when(F.col("doc_id") % 5 == 0, "deflate, gzip").otherwise("gzip, deflate")).alias("d"))
    return rows.select("doc_id", F.when(F.col("d.error").isNull(), F.sha2("d.body", 256)).alias("digest"), F.col("d.error").isNotNull().alias("refused"))


@P.add("decode_text_utf8", "SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'partial' ELSE 'complete' END AS status FROM documents WHERE text IS NOT NULL")
def _(t):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("text").cast("binary"))
    rows = t.documents.where("text is not null").select("doc_id", http.strict_text(raw).alias("d"))
    return rows.select("doc_id", F.rtrim("d.text", F.lit("�")).alias("text"), "d.status")


@P.add("sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@P.add("robots_fingerprint", "SELECT user_id, sha256(string_agg('Disallow: /' || event_id, chr(10) ORDER BY event_id)) AS fingerprint FROM events GROUP BY user_id")
def _(t):
    g = t.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: F.concat(F.lit("Disallow: /"), x.cast("string"))).alias("lines"))
    return g.select("user_id", http.robots_fingerprint("lines").alias("fingerprint"))


@P.add("label_classify", "SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unknown' END AS label, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(http.known_label("event_type", ["view", "click"]).alias("label")).agg(F.count("*").alias("n"))


@P.add("label_filter", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.element_at(urls.kept_labels("props", ("k", "n")), "k").alias("k"))


@P.add("html_escape", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')) AS digest FROM pages")
def _(t):
    return t.pages.select("page_id", F.sha2(X.html_escape("html"), 256).alias("digest"))


@P.add("text_locators", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL AND text <> '' AND NOT ends_with(text, chr(10))) SELECT doc_id, CAST(len(p) AS BIGINT) AS places, CAST(length(p[len(p)]) AS BIGINT) AS last FROM l")
def _(t):
    rows = t.documents.where("text is not null and text <> ''").where(~F.endswith("text", F.lit("\n"))).select("doc_id", X.locators("text").alias("p"))
    last = F.element_at("p", -1)
    return rows.select("doc_id", F.size("p").cast("long").alias("places"), (last["end"] - last["start"]).cast("long").alias("last"))


@P.add("udtf_locators", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL AND text <> '' AND NOT ends_with(text, chr(10))), u AS (SELECT doc_id, unnest(p) AS x FROM l) SELECT doc_id, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS chars FROM u GROUP BY doc_id")
def _(t):
    rows = t.documents.where("text is not null and text <> ''").where(~F.endswith("text", F.lit("\n"))).select("doc_id", F.explode(X.locators("text")).alias("p"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("p.end") - F.col("p.start")).cast("long").alias("chars"))


@P.add("sort_utf16", "SELECT source, min(doc_id) AS first FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.min("doc_id").alias("first")).orderBy(urls.utf16_key("source"))


@P.add("filter_cdx_search", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'blog') OR contains('text/html', 'blog')")
def _(t):
    from lakeleaf.operators.archive import searched_cdx

    return searched_cdx(t.pages.select("page_id", "url", F.lit("text/html").alias("mime")), "Blog").select("page_id", "url")


@P.add("join_taxonomy", "SELECT doc_id, code FROM documents, (VALUES ('T1', 'erth'), ('T2', 'ción'), ('T3', 'zzzz')) c(code, k) WHERE contains(lower(text), k)")
def _(t):
    from lakeleaf.operators.reports import taxonomy_matches

    return taxonomy_matches(t.documents, [("T1", "erth"), ("T2", "ción"), ("T3", "zzzz")])


@P.add("uuid", f"WITH a AS ({ACQUISITIONS}) SELECT acquisition_id, sha256(url || ':' || acquisition_id) AS id FROM a")
def _(t):
    return t.acquisitions().select("acquisition_id", F.sha2(F.concat_ws(":", "url", F.col("acquisition_id").cast("string")), 256).alias("id"))


QUERIES, ORACLE_SQL = P.queries, P.sql
