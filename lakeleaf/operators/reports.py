"""Coverage, latency, yield, taxonomy, link-graph and defect reports as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeleaf.functions import http, urls
from lakeleaf.operators.windows import floor_percentiles

# Resource states, patterns of routes that rarely hold documents, report texts.
STATES = ("captured", "excluded", "failed", "pending", "unsupported")
LOW_YIELD = (
    (r"(?i)/calendar\b", "Calendar, schedule, and date-loop traps"),
    (r"(?i)/events\b", "Ephemeral event notices without archival policy content"),
    (r"(?i)/login\b|/auth\b", "Authentication gateways"),
    (r"(?i)/search\b", "Dynamic search query pages"),
    (r"(?i)/tag\b|/tags\b", "Tag taxonomies with duplicate link loops"),
)
NO_DOCUMENTS = "Zero documents found across traversed branch. Consider pruning scope to preserve server resources."
VERDICTS = ("Optimal", "Degraded (Server Errors Detected)", "Strained (High Latency)", "Unknown — capture failures or no saved responses")


def coverage_counts(outcomes: DataFrame, state: str = "state") -> DataFrame:
    """(state, n) of the five states, zeros too."""
    spark = outcomes.sparkSession
    every = spark.createDataFrame([(s,) for s in STATES], "state string")
    counts = outcomes.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("n"))
    return every.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def is_complete(outcomes: DataFrame, limitations: int = 0) -> DataFrame:
    """One row: all captured, some there, and no limitation."""
    return outcomes.agg(((F.count("*") > 0) & (F.count_if(~F.col("state").eqNullSafe("captured")) == 0) & F.lit(limitations == 0)).alias("complete"))


def safe_sum(value: str) -> Column:
    """Sum as a long that JSON numbers hold exactly; anything beyond raises. Added up as decimals, so it cannot wrap."""
    total = F.sum(F.col(value).cast("decimal(38,0)"))
    return F.when((total < 0) | (total > http.SAFE_INTEGER), F.raise_error(F.lit("aggregate exceeds safe integer range")).cast("long")).otherwise(F.coalesce(total, F.lit(0)).cast("long"))


def reconciled(resources: DataFrame, declared: dict[str, int] | None = None) -> DataFrame:
    """One row of totals over receipt resources; ``consistent`` is false where rows break the receipt's rules or differ from the declared counts."""
    digest_ok = F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    good_captured = F.col("status").between(200, 399) & (F.col("bytes") >= 0) & digest_ok
    broken = ~urls.is_http_identity("url") | ~F.col("state").isin(*STATES) | ((F.col("state") == "captured") & ~F.coalesce(good_captured, F.lit(False)))
    repeated = resources.groupBy("url").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("repeated"))
    out = resources.agg(
        F.count("*").alias("discovered"),
        *[F.count_if(F.col("state") == s).alias(s) for s in STATES],
        F.coalesce(F.sum(F.when(F.col("state") == "captured", F.col("bytes"))), F.lit(0)).cast("long").alias("captured_payload_bytes"),
        F.coalesce(F.sum("declared_bytes"), F.lit(0)).cast("long").alias("declared_payload_bytes"),
        F.count_if(F.col("declared_bytes").isNull()).alias("unknown_estimate_resources"),
        F.count_if((F.col("state") == "captured") & F.col("status").between(300, 399)).alias("redirects"),
        F.count_if(F.col("state").isin("failed", "pending", "unsupported")).alias("missing"),
        F.count_if(broken).alias("broken"),
    ).crossJoin(F.broadcast(repeated))
    same = F.lit(True)
    for s in STATES if declared else ():
        same = same & (F.col(s) == declared.get(s, 0))
    return out.withColumn("consistent", (F.col("broken") == 0) & (F.col("repeated") == 0) & same)


def duplicate_groups(resources: DataFrame, digest: str = "sha256", name: str = "url") -> DataFrame:
    """(digest, n, first, last) of digests that several captured rows share; the members stay in the input, by a join on the digest."""
    return resources.groupBy(digest).agg(F.count("*").alias("n"), F.min(name).alias("first"), F.max(name).alias("last")).where("n > 1")


def capture_summary(outcomes: DataFrame) -> DataFrame:
    """attempted, saved, excluded, failed, pending and status. Counts the state ``saved``, so a receipt's ``captured`` rows are not saved ones."""
    n = lambda s: F.count_if(F.coalesce(F.col("state"), F.lit("unknown")) == s).alias(s)
    out = outcomes.agg(F.count_if(~F.coalesce(F.col("state"), F.lit("unknown")).isin("excluded", "pending")).alias("attempted"), *[n(s) for s in ("saved", "excluded", "failed", "pending")])
    return out.withColumn("status", F.when((F.col("attempted") > 0) & (F.col("saved") == F.col("attempted")), "complete").when(F.col("saved") > 0, "partial").otherwise("unknown"))


def route_yield(audit: DataFrame, documents: DataFrame) -> DataFrame:
    """(section, pages, docs, yield, avg_latency) of every section of the audit; documents elsewhere do not count."""
    pages = audit.groupBy(urls.top_section("url").alias("section")).agg(F.count("*").alias("pages"), F.avg(F.when(F.col("latency_ms") != 0, F.col("latency_ms"))).alias("lat"))
    docs = documents.groupBy(urls.top_section("url").alias("section")).agg(F.count("*").alias("docs"))
    out = pages.join(docs, "section", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    return out.select("section", "pages", "docs", F.round(100.0 * F.col("docs") / F.col("pages"), 1).alias("yield"), F.round(F.coalesce("lat", F.lit(0.0)), 0).cast("long").alias("avg_latency"))


def latency(audit: DataFrame, group: list[str] | None = None, value: str = "latency_ms") -> DataFrame:
    """p50, p90 and p99 (element floor(n p) of the sorted positive values), mean and max."""
    group = group or []
    some = audit.where(F.col(value) > 0)
    ranks = floor_percentiles(some, group, value, {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    rest = some.groupBy(*group).agg(F.round(F.avg(value), 0).cast("long").alias("mean"), F.max(value).alias("max"))
    return ranks.join(rest, group) if group else ranks.crossJoin(F.broadcast(rest))


def health(audit: DataFrame) -> DataFrame:
    """One row: pages, attempts, errors by class, mean latency and the verdict; the last rule that applies wins."""
    s = F.col("status")
    out = audit.agg(
        F.count_distinct(F.when(F.col("digest").isNotNull() & s.between(200, 399), F.col("url"))).alias("pages"),
        F.count_if(s >= 0).alias("attempts"),
        F.count_if(s == 0).alias("capture_errors"),
        F.count_if((s == 429) | (s >= 500)).alias("server_errors"),
        F.count_if(s.between(400, 499) & (s != 429)).alias("client_errors"),
        F.coalesce(F.round(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), 0), F.lit(0)).cast("long").alias("avg_latency"),
    )
    verdict = F.when((F.col("capture_errors") > 0) | (F.col("pages") == 0), VERDICTS[3]).when(F.col("avg_latency") > 2000, VERDICTS[2]).when(F.col("server_errors") > 0, VERDICTS[1]).otherwise(VERDICTS[0])
    return out.withColumn("verdict", verdict)


def request_rate(audit: DataFrame, ts: str = "ts") -> DataFrame:
    """Attempts per minute over at least a tenth of a minute."""
    minutes = F.greatest(F.lit(0.1), (F.unix_millis(F.max(ts)) - F.unix_millis(F.min(ts))) / 60000.0)
    return audit.agg(F.round(F.count_if(F.col("status") >= 0) / minutes, 1).alias("rate"))


def low_yield(yields: DataFrame) -> DataFrame:
    """Sections of five pages or more without a document, with a likely reason."""
    reason = F.when(F.lit(False), "")
    for pattern, text in LOW_YIELD:
        reason = reason.when(F.col("section").rlike(pattern), text)
    return yields.where("pages >= 5 and docs = 0").select("section", "pages", reason.otherwise(NO_DOCUMENTS).alias("reason"))


def taxonomy(documents: DataFrame, categories: list[dict], text: Column, title: Column, seq: str) -> DataFrame:
    """(code, label, n, samples): documents of each category by its keywords, zeros kept, with the first three titles. One scan; categories become columns."""
    low = F.lower(text)
    marks = [F.when(F.reduce(F.array(*[F.contains(low, F.lit(k.lower())) for k in c.get("keywords", [])] or [F.lit(False)]), F.lit(False), lambda a, x: a | x), F.lit(c["code"])) for c in categories]
    hits = documents.select(F.col(seq).alias("seq"), title.alias("title"), F.explode(F.array_compact(F.array(*marks))).alias("code"))
    w = Window.partitionBy("code").orderBy("seq")
    counts = hits.groupBy("code").agg(F.count("*").alias("n"))
    firsts = hits.withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "title"))), lambda x: x["title"]).alias("samples"))
    spark = documents.sparkSession
    every = spark.createDataFrame([(c["code"], c.get("label", c["code"])) for c in categories], "code string, label string")
    return every.join(counts, "code", "left").join(firsts, "code", "left").select("code", "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def link_graph(edges: DataFrame, hosts: list[str] | None = None, only: str | None = None) -> DataFrame:
    """Distinct edges (source, target, internal), all, internal or external ones."""
    distinct = edges.select("source", "target").distinct()
    out = distinct.withColumn("internal", urls.in_scope("target", hosts) if hosts else urls.host("source") == urls.host("target"))
    return out if only is None else out.where(F.col("internal") if only == "internal" else ~F.col("internal"))


def dangling_edges(edges: DataFrame, resources: DataFrame) -> DataFrame:
    """Edges with an end that is no known resource."""
    known = resources.select(F.col("url").alias("known")).distinct()
    bad = edges.join(known, edges.source == known.known, "left_anti").unionByName(edges.join(known, edges.target == known.known, "left_anti"))
    return bad.distinct()


def capped_edges(edges: DataFrame, most: int = 10_000, order: str = "seq") -> DataFrame:
    """The first distinct edges in order of first sight, and whether more were left out."""
    firsts = edges.groupBy("source", "target").agg(F.min(order).alias(order))
    return firsts.orderBy(order, "source", "target").limit(most)


def failed_event() -> Column:
    """An event that reports a failure by status, level, outcome or error."""
    none = F.lit(False)
    return F.coalesce(F.col("status") >= 400, none) | F.coalesce(F.col("status") == 0, none) | F.coalesce(F.col("level") == "error", none) | F.coalesce(F.col("outcome") == "failed", none) | F.coalesce(F.col("error_type") != "", none)


def finding_identity(stage, error) -> Column:
    """Digest of the compact JSON of stage and error type (both are plain labels)."""
    return F.sha2(F.concat(F.lit('{"error_type":"'), error, F.lit('","stage":"'), stage, F.lit('"}')), 256)


def findings(events: DataFrame, stages: list[str], errors: list[str]) -> DataFrame:
    """(fingerprint, stage, error_type, occurrences) of failed events by known labels."""
    kind = F.coalesce(F.when(F.col("error_type") != "", F.col("error_type")), F.when(F.col("status") == 0, "network_error"), F.when(F.col("status") >= 400, "HTTPError"))
    rows = events.where(failed_event()).select(http.known_label(F.coalesce("stage", F.lit("")), stages).alias("stage"), http.known_label(F.coalesce(kind, F.lit("")), errors).alias("error_type"))
    counts = rows.groupBy("stage", "error_type").agg(F.count("*").alias("occurrences"))
    return counts.select(finding_identity(F.col("stage"), F.col("error_type")).alias("fingerprint"), "stage", "error_type", "occurrences")


def merged_findings(ledger: DataFrame, fresh: DataFrame, report_hash: str) -> DataFrame:
    """Ledger after a report: a report already counted changes nothing; a verified finding that recurs is marked."""
    new = fresh.select("fingerprint", F.col("stage").alias("s"), F.col("error_type").alias("e"), F.col("occurrences").alias("k"))
    both = ledger.join(new, "fingerprint", "full")
    counted = F.coalesce(F.array_contains("report_hashes", report_hash), F.lit(False))
    adds = F.col("k").isNotNull() & ~counted
    none = F.array().cast("array<string>")
    hashes = F.coalesce("report_hashes", none)
    return both.select(
        "fingerprint",
        F.coalesce("stage", "s").alias("stage"),
        F.coalesce("error_type", "e").alias("error_type"),
        F.coalesce("state", F.lit("proposed")).alias("state"),
        (F.coalesce("occurrences", F.lit(0)) + F.when(adds, F.col("k")).otherwise(0)).cast("long").alias("occurrences"),
        F.when(adds, F.concat(hashes, F.array(F.lit(report_hash)))).otherwise(hashes).alias("report_hashes"),
        (F.coalesce("recurrence", F.lit(False)) | (adds & F.coalesce(F.col("state") == "verified", F.lit(False)))).alias("recurrence"),
    )


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status): ok, missing or mismatch for every manifest line; files that no line names are ignored."""
    have = files.select(F.col("path"), F.col("sha256").alias("found"))
    out = manifest.join(have, "path", "left")
    return out.select("path", F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "ok").otherwise("mismatch").alias("status"))


def package_check(expected: DataFrame, actual: DataFrame, key: str = "path", columns: tuple[str, ...] = ("sha256", "size")) -> DataFrame:
    """(key, status) of a full comparison: ok, missing, extra or changed."""
    a = expected.select(key, F.struct(*columns).alias("want"))
    b = actual.select(key, F.struct(*columns).alias("have"))
    out = a.join(b, key, "full")
    return out.select(key, F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") == F.col("have"), "ok").otherwise("changed").alias("status"))


def lock_audit(lock: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, status) of lock entries (path, size, sha256) against cached files (path, size, sha256, symlink)."""
    have = cache.select("path", F.col("size").alias("f_size"), F.col("sha256").alias("f_sha"), "symlink")
    out = lock.join(have, "path", "left")
    escape = F.col("path").rlike(r"(^|/)\.\.(/|$)|^/|\\")
    status = F.when(escape, "escape").when(F.col("f_sha").isNull(), "missing").when(F.col("symlink"), "symlink").when(F.col("f_size") != F.col("size"), "size").when(F.col("f_sha") != F.col("sha256"), "digest").otherwise("verified")
    return out.select("path", status.alias("status"))


def markdown(summary: dict, title: str = "Capture report") -> str:
    """A short report of an aggregate's row."""
    return "\n".join([f"# {title}", "", "| measure | value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in summary.items()], ""])


def graph_svg(edges: list[tuple[str, str]], most: int = 500, label: int = 60) -> str:
    """A plain two-column drawing of at most ``most`` edges; the rest is counted."""
    from xml.sax.saxutils import escape

    shown = edges[:most]
    rows = [f'<text x="10" y="{20 + 18 * i}">{escape(a[:label])} → {escape(b[:label])}</text>' for i, (a, b) in enumerate(shown)]
    note = f'<text x="10" y="{20 + 18 * len(shown)}">{len(edges) - len(shown)} more</text>' if len(edges) > most else ""
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="1200" height="{40 + 18 * (len(shown) + 1)}">{"".join(rows)}{note}</svg>'


def progress(audit: DataFrame) -> DataFrame:
    """One row: requests, distinct addresses, captured documents of a ledger (url, digest)."""
    return audit.agg(F.count("*").alias("audit"), F.count_distinct("url").alias("visited"), F.count_if(F.col("digest").isNotNull()).alias("docs"))


def ocr_confidence(words: DataFrame) -> DataFrame:
    """(page, confidence): mean confidence of each page's words (page, confidence from 0 to 100), rounded; values outside count for nothing, a page without any has null."""
    good = F.when(F.col("confidence").between(0, 100), F.col("confidence"))
    return words.groupBy("page").agg(F.round(F.avg(good), 6).alias("confidence"))


def taxonomy_matches(docs: DataFrame, categories: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, code) of every category (code, keyword) whose keyword a text holds, whatever its case; categories are parameters, tested in one scan."""
    text = F.lower(F.col(text_col))
    found = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(k.lower())), F.lit(c)) for c, k in categories]))
    return docs.select(id_col, F.explode(found).alias("code"))
