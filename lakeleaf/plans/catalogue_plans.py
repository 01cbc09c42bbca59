"""Catalogue, policy and derivative queries."""

import hashlib

from pyspark.sql import functions as F

from lakeleaf.operators import catalogue as C
from lakeleaf.operators import extract as X
from lakeleaf.plans.base import ACQUISITIONS, Plans

P = Plans()


def _policy(t):
    """Events from ``labels``: toxic documents are flagged, bad ones restricted, some held, some removed."""
    l = t.labels.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), "doc_id", "quality", "toxic")
    action = F.when(F.col("toxic") == 1, "flag").when(F.col("quality") == 0, "handling").when(F.col("doc_id") % 7 == 0, "retention").when(F.col("doc_id") % 5 == 0, "remove").otherwise("handling")
    confirm = F.concat(F.lit('{"confirm":"d'), F.col("doc_id").cast("string"), F.lit('"}'))
    details = F.when(action == "flag", '{"flag":"toxic"}').when(action == "retention", '{"legal_hold":true}').when(action == "remove", confirm).when(F.col("quality") == 0, '{"handling":"restricted"}').otherwise('{"handling":"public"}')
    one = l.select("source_id", (F.col("doc_id") * 2).alias("event_id"), action.alias("action"), F.lit("review").alias("reason"), F.lit(10.0).alias("recorded"), details.alias("details"))
    # a second request on every source: withdrawal of held ones is refused, the rest goes through
    two = l.where("doc_id % 3 = 0").select("source_id", (F.col("doc_id") * 2 + 1).alias("event_id"), F.lit("remove").alias("action"), F.lit("request").alias("reason"), F.lit(11.0).alias("recorded"), confirm.alias("details"))
    return one.unionByName(two)


def _sources(t):
    return t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.lit("public").alias("handling"))


_STATE = """SELECT 'd' || d.doc_id AS source_id, l.toxic, l.quality, d.doc_id,
 l.doc_id IS NOT NULL AND l.toxic <> 1 AND l.quality <> 0 AND d.doc_id % 7 = 0 AS legal_hold,
 coalesce((l.toxic <> 1 AND l.quality <> 0 AND d.doc_id % 7 <> 0 AND d.doc_id % 5 = 0) OR (l.doc_id IS NOT NULL AND d.doc_id % 3 = 0 AND NOT (l.toxic <> 1 AND l.quality <> 0 AND d.doc_id % 7 = 0)), false) AS removed
 FROM documents d LEFT JOIN labels l USING (doc_id)"""
_HANDLING = "CASE WHEN removed THEN 'revoked' WHEN toxic = 1 THEN 'quarantined' WHEN quality = 0 THEN 'restricted' ELSE 'public' END"


@P.add("policy_set_handling", f"WITH s AS ({_STATE}) SELECT source_id, {_HANDLING} AS handling FROM s")
def _(t):
    return C.policy_state(_policy(t), _sources(t)).select("source_id", "handling")


@P.add("policy_flag", f"WITH s AS ({_STATE}) SELECT source_id, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS flags FROM s WHERE toxic = 1")
def _(t):
    return C.policy_state(_policy(t), _sources(t)).where(F.size("flags") > 0).select("source_id", F.size("flags").alias("flags"))


@P.add("policy_retention", f"WITH s AS ({_STATE}) SELECT source_id FROM s WHERE legal_hold")
def _(t):
    return C.policy_state(_policy(t), _sources(t)).where("legal_hold").select("source_id")


@P.add("policy_remove", f"WITH s AS ({_STATE}) SELECT removed, count(*) AS n FROM s GROUP BY removed")
def _(t):
    return C.policy_state(_policy(t), _sources(t)).groupBy("removed").agg(F.count("*").alias("n"))


@P.add("policy_history", f"WITH s AS ({_STATE}) SELECT count(*) AS refused FROM s WHERE doc_id % 3 = 0 AND toxic IS NOT NULL AND (legal_hold OR (toxic <> 1 AND quality <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 = 0))")
def _(t):
    return C.policy_history(_policy(t), _sources(t)).agg(F.count_if(F.col("error").isNotNull()).alias("refused"))


# --- acquisitions ---------------------------------------------------------------
_REV = f"WITH a AS ({ACQUISITIONS})"


@P.add("stateful_register", _REV + """, h AS (SELECT *, max({'t': acquired, 'i': acquisition_id, 'r': revision_id, 'h': content_hash}) OVER (PARTITION BY url ORDER BY acquisition_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head, min(acquisition_id) OVER (PARTITION BY content_hash) AS stored FROM a)
 SELECT acquisition_id, source_id, revision_id AS after_revision_id, head.r AS before_revision_id, head.h <> content_hash AS content_changed, stored < acquisition_id AS duplicate_content, head IS NULL OR acquired >= head.t AS advances_url_head FROM h""")
def _(t):
    return C.register(t.acquisitions()).select("acquisition_id", "source_id", "after_revision_id", "before_revision_id", "content_changed", "duplicate_content", "advances_url_head")


@P.add("win_head_before", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type AS content_changed FROM events")
def _(t):
    from lakeleaf.operators.windows import head_before

    return head_before(t.events, "user_id", ["ts", "event_id"], "event_type").select("event_id", "before", "content_changed")


@P.add("read_receipt", _REV + " SELECT count(*) AS receipts, count(*) AS valid FROM a")
def _(t):
    return C.verified_receipts(C.register(t.acquisitions())).agg(F.count("*").alias("receipts"), F.count_if("valid").alias("valid"))


@P.add("sort_receipts", _REV + " SELECT acquisition_id, source_id, row_number() OVER (ORDER BY acquisition_id) AS rank FROM a")
def _(t):
    from lakeleaf.operators.windows import global_rank

    return global_rank(C.register(t.acquisitions()).select("acquisition_id", "source_id"), [F.asc("acquisition_id")])


@P.add("read_revisions", _REV + ", f AS (SELECT DISTINCT ON (revision_id) revision_id, url, content_hash, acquired FROM a WHERE url = 'https://example.com/u/3' ORDER BY revision_id, acquisition_id) SELECT revision_id, content_hash, acquired FROM f")
def _(t):
    rows = C.acquisitions(t.acquisitions())
    return C.history(C.revisions(rows), C.url_heads(rows), "https://example.com/u/3").select("revision_id", "content_hash", "acquired")


@P.add("sort_history", _REV + " SELECT acquisition_id, acquired FROM a WHERE url = 'https://example.com/u/3'")
def _(t):
    rows = C.acquisitions(t.acquisitions())
    own = C.url_heads(rows).where("url = 'https://example.com/u/3'").select("source_id")
    return rows.join(own, "source_id").orderBy("acquired", "acquisition_id").select("acquisition_id", "acquired")


@P.add("join_acquisitions_by_url", _REV + " SELECT url, count(*) AS n FROM a GROUP BY url")
def _(t):
    rows = C.acquisitions(t.acquisitions())
    return rows.select("source_id").join(C.url_heads(rows).select("url", "source_id"), "source_id").groupBy("url").agg(F.count("*").alias("n"))


@P.add("late_data", _REV + " SELECT url, arg_max(revision_id, {'t': acquired, 'i': acquisition_id}) AS revision_id, min(acquired) AS first_seen, max(acquired) AS last_seen FROM a GROUP BY url")
def _(t):
    return C.url_heads(C.acquisitions(t.acquisitions())).select("url", "revision_id", "first_seen", "last_seen")


@P.add("join_latest_restriction", _REV + " SELECT source_id, arg_max(handling, {'t': acquired, 'i': acquisition_id}) AS handling FROM a WHERE handling <> 'public' GROUP BY source_id")
def _(t):
    return C.latest_restriction(C.acquisitions(t.acquisitions()))


@P.add("join_original", _REV + " SELECT DISTINCT revision_id, true AS intact FROM a")
def _(t):
    rows = C.acquisitions(t.acquisitions())
    return C.originals(C.revisions(rows), C.content_objects(rows)).select("revision_id", "intact")


@P.add("join_original_available", _REV + " SELECT DISTINCT revision_id, content_hash <> sha256('view') AS available FROM a")
def _(t):
    rows = C.acquisitions(t.acquisitions())
    there = C.content_objects(rows.where("content <> cast('view' as binary)")).select("content_hash", F.lit(True).alias("_t"))
    return C.revisions(rows).join(there, "content_hash", "left").select("revision_id", F.coalesce("_t", F.lit(False)).alias("available"))


@P.add("join_move_origin", _REV + ", m AS (SELECT DISTINCT url FROM a) SELECT 'moved/' || url AS url, sha256(url) AS source_id FROM m")
def _(t):
    log = t.acquisitions()
    moves = log.select("url").distinct()
    last = 10_000_000_000
    moved = moves.select((F.lit(last) + F.abs(F.xxhash64("url") % 1_000_000_000)).alias("acquisition_id"), F.concat(F.lit("moved/"), F.col("url")).alias("url"), F.lit("x").cast("binary").alias("content"), F.lit("text/plain").alias("mime"), F.lit("public").alias("handling"), F.lit(2e9).alias("acquired"), F.col("url").alias("moved_from"))
    both = log.withColumn("moved_from", F.lit(None).cast("string")).unionByName(moved)
    return C.register(both, moves=True).where("moved").select("url", "source_id")


@P.add("join_compare_revisions", _REV + ", r AS (SELECT DISTINCT revision_id, content_hash, size FROM a WHERE url = 'https://example.com/u/3') SELECT 'content_changed' AS relation, (SELECT size FROM r WHERE content_hash = sha256('view')) - (SELECT size FROM r WHERE content_hash = sha256('click')) AS size_delta")
def _(t):
    revs = C.revisions(C.acquisitions(t.acquisitions()))
    one = revs.where(F.col("url") == "https://example.com/u/3")
    pick = lambda kind: one.where(F.col("content_hash") == F.sha2(F.lit(kind), 256)).select("revision_id").first()[0]
    return C.compared(revs, pick("click"), pick("view")).select("relation", "size_delta")


@P.add("join_duplicates", "WITH r AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class, count(*) OVER (PARTITION BY h) AS members FROM r QUALIFY members > 1")
def _(t):
    rows = t.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return C.duplicates(rows, key="doc_id").withColumnRenamed("key", "doc_id")


@P.add("join_duplicates_of", "WITH r AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL) SELECT a.doc_id, b.doc_id AS other_id FROM r a JOIN r b ON a.h = b.h AND a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0")
def _(t):
    """The surveyed search for the stated documents, those whose number is divisible by 100."""
    rows = t.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return C.duplicates_of(rows, rows.where("doc_id % 100 = 0"), key="doc_id").select(F.col("key").alias("doc_id"), F.col("other").alias("other_id"))


# --- eligibility ------------------------------------------------------------------
def _eligible_inputs(t):
    """Documents as revisions of their source: bad labels flag, events acquire, some derivatives are restricted."""
    d = t.documents
    revs = d.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("revision_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("https://e.com/"), F.col("doc_id").cast("string")).alias("url"))
    policy = C.policy_state(_policy(t), _sources(t))
    acquired = d.where("doc_id % 4 <> 0").select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("revision_id"), F.when(F.col("doc_id") % 9 == 0, "restricted").otherwise("public").alias("handling"))
    derived = d.select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("derivative_id"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("revision_id"), "text", F.sha2("text", 256).alias("output_hash"), F.when(F.col("doc_id") % 13 == 0, "failed").otherwise("complete").alias("status"), F.when(F.col("doc_id") % 10 == 0, "restricted").otherwise("public").alias("handling"), F.lit("text").alias("kind"), F.lit("builtin-2").alias("extractor"), F.lit("[]").alias("locator_json"))
    return revs, policy, acquired, derived


_ELIGIBLE = f"s AS ({_STATE}), el AS (SELECT doc_id FROM s WHERE {_HANDLING} = 'public' AND doc_id % 4 <> 0 AND doc_id % 9 <> 0 AND doc_id % 10 <> 0)"


@P.add("filter_eligible_revision", f"WITH {_ELIGIBLE} SELECT doc_id FROM el")
def _(t):
    revs, policy, acquired, derived = _eligible_inputs(t)
    return C.eligible_revisions(revs, policy, acquired, derived).select(F.regexp_replace("revision_id", "^r", "").cast("long").alias("doc_id"))


@P.add("filter_eligible_derivative", f"WITH {_ELIGIBLE} SELECT 'x' || doc_id AS derivative_id FROM el JOIN documents USING (doc_id) WHERE doc_id % 13 <> 0 AND length(trim(text)) > 0")
def _(t):
    revs, policy, acquired, derived = _eligible_inputs(t)
    return C.eligible_derivatives(derived, C.eligible_revisions(revs, policy, acquired, derived)).select("derivative_id")


@P.add("join_semi_policy", f"WITH s AS ({_STATE}) SELECT 'r' || doc_id AS revision_id FROM s WHERE {_HANDLING} = 'public'")
def _(t):
    revs, policy, _, _ = _eligible_inputs(t)
    return C.with_open_source(revs, policy).select("revision_id")


@P.add("join_semi_acquired", "SELECT 'r' || doc_id AS revision_id FROM documents WHERE doc_id % 4 <> 0")
def _(t):
    revs, _, acquired, _ = _eligible_inputs(t)
    return C.with_acquisition(revs, acquired).select("revision_id")


@P.add("join_anti_restricted", "SELECT 'r' || doc_id AS revision_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 9 <> 0")
def _(t):
    revs, _, acquired, _ = _eligible_inputs(t)
    return C.without_restricted(revs, acquired).select("revision_id")


@P.add("join_anti_derivative", "SELECT 'r' || doc_id AS revision_id FROM documents WHERE doc_id % 10 <> 0")
def _(t):
    revs, _, _, derived = _eligible_inputs(t)
    return C.without_restricted(revs, derived).select("revision_id")


@P.add("join_cache_purge", f"WITH {_ELIGIBLE}, k AS (SELECT doc_id FROM el JOIN documents USING (doc_id) WHERE doc_id % 13 <> 0 AND length(trim(text)) > 0) SELECT count(*) AS purged FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k)")
def _(t):
    revs, policy, acquired, derived = _eligible_inputs(t)
    live = C.eligible_derivatives(derived, C.eligible_revisions(revs, policy, acquired, derived))
    return derived.join(live, "derivative_id", "left_anti").agg(F.count("*").alias("purged"))


@P.add("export_original", f"WITH {_ELIGIBLE} SELECT 'r' || doc_id AS revision_id, sha256(text) AS content_hash FROM el JOIN documents USING (doc_id) WHERE text IS NOT NULL")
def _(t):
    revs, policy, acquired, derived = _eligible_inputs(t)
    objects = t.documents.where("text is not null").select(F.sha2("text", 256).alias("content_hash"), F.col("text").cast("binary").alias("content")).dropDuplicates(["content_hash"])
    return C.exported_originals(revs, policy, acquired, derived, objects).select("revision_id", "content_hash")


_VISIBLE = f"WITH {_ELIGIBLE}, v AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS t FROM el JOIN documents USING (doc_id) WHERE doc_id % 13 <> 0 AND length(trim(text)) > 0)"
_SCORED = """, c AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS words, CAST(len(list_filter(t, lambda x: x = 'the')) AS DOUBLE) AS tf FROM v), s2 AS (SELECT CAST(count(*) AS DOUBLE) AS docs, avg(words) AS mean, CAST(count(*) FILTER (tf > 0) AS DOUBLE) AS df FROM c)
 SELECT 'x' || doc_id AS derivative_id, round(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / mean)), 9) AS score FROM c, s2 WHERE tf > 0 ORDER BY greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / mean)) DESC, 1 LIMIT 20"""


@P.add("join_search_five_way", _VISIBLE + _SCORED)
def _(t):
    revs, policy, acquired, derived = _eligible_inputs(t)
    objects = t.documents.select(F.sha2("text", 256).alias("content_hash")).distinct()
    return C.search_hits("the", derived, revs, policy, acquired, objects).select("derivative_id", F.round("score", 9).alias("score"))


@P.add("filter_search_args", _VISIBLE + " SELECT 'x' || doc_id AS derivative_id FROM v WHERE doc_id = (SELECT min(doc_id) FROM v WHERE list_contains(t, 'the'))")
def _(t):
    revs, policy, acquired, derived = _eligible_inputs(t)
    objects = t.documents.select(F.sha2("text", 256).alias("content_hash")).distinct()
    least = C.search_hits("the", derived, revs, policy, acquired, objects, limit=None).agg(F.min(F.regexp_replace("source_id", "^d", "").cast("long"))).first()[0]
    return C.search_hits("the", derived, revs, policy, acquired, objects, limit=None, source_id=f"d{least}", kind="text").select("derivative_id")


def _results(t):
    d = t.documents.where("text is not null")
    places = X.locators("text")
    return d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("revision_id"), "text", F.lit("complete").alias("status"), F.lit("builtin-2").alias("extractor"), F.when(F.col("doc_id") % 17 == 0, "0").otherwise(F.sha2("text", 256)).alias("output_hash"), F.lit(None).cast("string").alias("source_hash"), F.lit("text").alias("kind"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("reason"), places.alias("locators"), F.lit(None).cast("string").alias("handling"))


@P.add("index_add", "SELECT count(*) AS rows, count(*) AS ids FROM documents WHERE text IS NOT NULL AND doc_id % 17 <> 0")
def _(t):
    revs, policy, _, _ = _eligible_inputs(t)
    once = _results(t)
    added = C.index_add(once.unionByName(once), revs, policy.select("source_id", "handling"))
    return added.agg(F.count("*").alias("rows"), F.count_distinct("derivative_id").alias("ids"))


@P.add("index_hits", "SELECT count(*) AS checked FROM documents WHERE text IS NOT NULL AND doc_id % 17 <> 0")
def _(t):
    revs, policy, _, _ = _eligible_inputs(t)
    rows = C.index_add(_results(t), revs, policy.select("source_id", "handling"))
    good = (F.col("derivative_id") == C.derivative_identity("revision_id", "extraction_json", "locator_json")) & (F.sha2("text", 256) == F.col("output_hash"))
    return rows.where(good).agg(F.count("*").alias("checked"))


@P.add("index_export", f"WITH s AS ({_STATE}) SELECT {_HANDLING} AS handling, count(*) AS n FROM s JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL AND doc_id % 17 <> 0 GROUP BY 1")
def _(t):
    revs, policy, _, _ = _eligible_inputs(t)
    return C.index_add(_results(t), revs, policy.select("source_id", "handling")).groupBy("handling").agg(F.count("*").alias("n"))


@P.add("derivative_json")
def _(t):
    return t.events.select("event_id", X.sorted_json("props")["value"].alias("json"))


@P.add("join_compare_derivatives")
def _(t):
    """Each derivative of a document's text with that of the stated document a hundred numbers on."""
    a = t.documents.where("text is not null").select(F.col("doc_id").alias("a_id"), F.col("text").alias("a_text"))
    b = a.select(F.col("a_id").alias("b_id"), F.col("a_text").alias("b_text"))
    pairs = a.join(b, F.col("b_id") == F.col("a_id") + 100)
    return pairs.select("a_id", "b_id", X.text_difference("a_text", "b_text", F.col("a_id").cast("string"), F.col("b_id").cast("string")).alias("d")).select("a_id", "b_id", "d.status", F.length("d.diff").alias("chars"))


@P.add("text_unified_diff")
def _(t):
    d = t.documents.where("text is not null")
    changed = F.regexp_replace("text", "the", "THE")
    return d.select("doc_id", X.text_difference("text", changed, F.lit("before"), F.lit("after")).alias("d")).select("doc_id", "d.status", F.sha2("d.diff", 256).alias("diff_sha256"))


# --- jobs and findings ------------------------------------------------------------
@P.add("job_start", "SELECT event_id, left(sha256('{\"profile_id\":\"' || event_type || '\",\"user\":' || user_id || '}'), 32) AS id FROM events")
def _(t):
    spec = F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("profile_id")))
    return t.events.select("event_id", C.job_identity(spec).alias("id"))


@P.add("job_transition", "WITH e AS (SELECT user_id, event_type, min(event_id) AS i FROM events WHERE event_type IN ('view') GROUP BY user_id, event_type) SELECT user_id, 'running' AS state FROM e")
def _(t):
    requests = t.events.where("event_type = 'view'").select("user_id", "event_id", F.lit("running").alias("state"))
    return C.folded_states(requests, "user_id", "event_id", "state", C.JOB_STEPS, "queued").select("user_id", "state")


@P.add("job_lease", "WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t0, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), r(user_id, k, till, granted) AS (SELECT user_id, k, t0 + 86400, 1 FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, CASE WHEN e.t0 >= r.till THEN e.t0 + 86400 ELSE r.till END, CASE WHEN e.t0 >= r.till THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT user_id, CAST(sum(granted) AS BIGINT) AS granted FROM r GROUP BY user_id")
def _(t):
    from lakeleaf.operators.checks import leases

    requests = t.events.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return leases(requests, 86400).groupBy(F.col("job").alias("user_id")).agg(F.count_if("granted").alias("granted"))


@P.add("job_notification", "SELECT event_id AS id, event_type AS state, 'job' AS kind FROM events")
def _(t):
    from lakeleaf.operators.checks import notification

    return notification(t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("state"), F.col("props").alias("spec")))


@P.add("finding_transition", "SELECT user_id, CASE least(count(*), 4) WHEN 1 THEN 'reproduced' WHEN 2 THEN 'fixed' WHEN 3 THEN 'verified' ELSE 'verified' END AS state FROM events WHERE event_type = 'error' GROUP BY user_id")
def _(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    asked = F.when(n == 1, "reproduced").when(n == 2, "fixed").otherwise("verified")
    requests = t.events.where("event_type = 'error'").select("user_id", "event_id", asked.alias("state"))
    return C.folded_states(requests, "user_id", "event_id", "state", {k: (v,) for k, v in C.FINDING_STEPS.items()}, "proposed").select("user_id", "state")


QUERIES, ORACLE_SQL = P.queries, P.sql


@P.add("read_receipts", _REV + " SELECT acquisition_id, source_id, row_number() OVER (ORDER BY acquisition_id) AS rank FROM a WHERE url = 'https://example.com/u/3'")
def _(t):
    return C.ordered_receipts(C.register(t.acquisitions()), hashlib.sha256(b"https://example.com/u/3").hexdigest()).select("acquisition_id", "source_id", "rank")


@P.add("durable_job", """WITH e AS (SELECT user_id AS job, count(*) FILTER (event_type = 'view') AS generation FROM events GROUP BY 1)
 SELECT job, CASE job % 4 WHEN 2 THEN 'completed' WHEN 3 THEN 'cancelled' ELSE 'running' END AS state, generation FROM e""")
def _(t):
    from lakeleaf.streaming import journal as J

    state = F.element_at(F.array(*map(F.lit, ("queued", "paused", "completed", "cancelled"))), (F.col("job") % 4).cast("int") + 1)
    states = t.events.select(F.col("user_id").alias("job")).distinct().withColumn("state", state)
    chain = J.numbered(t.events.where("event_type = 'view'"), "user_id", ["event_id"]).select(F.col("user_id").alias("archive_id"), F.col("sequence").alias("generation"), (F.col("sequence") - 1).alias("expected"), (F.col("sequence") * 10).alias("prefix_bytes"))
    return C.resumed(states, J.checkpoint_chain(chain).withColumnRenamed("archive_id", "job"))


@P.add("udf_embed", "SELECT doc_id AS id, CASE WHEN vec_id IS NULL THEN 'unsupported' ELSE 'complete' END AS status, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * 0 + 1, 6) AS norm FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def _(t):
    from lakeleaf.operators.retrieval import embedded

    norm = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 6)
    return embedded(t.documents, t.embeddings).select("id", "status", norm.alias("norm"))


@P.add("entity_decode", """SELECT event_id, '<b> ' || chr(CAST(event_id % 2000 + 32 AS INTEGER)) || chr(CAST(event_id % 700 + 128512 - 690 AS INTEGER)) || ' &bad; ' || chr(65533) || chr(65533) || '&lt;' AS text FROM events""")
def _(t):
    code = F.concat(F.lit("&lt;b&GT; &#"), (F.col("event_id") % 2000 + 32).cast("string"), F.lit(";&#x"), F.hex(F.col("event_id") % 700 + 128512 - 690), F.lit("; &bad; &#0;&#x110000;&amp;lt;"))
    return t.events.select("event_id", X.entity_decode(code).alias("text"))


@P.add("udf_callbacks", "SELECT 'audit' AS event, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events")
def _(t):
    from lakeleaf.engine import observed

    told = []
    rows, tell = observed(t.events, told.append, n=F.count("*"), failed=F.count_if(F.col("event_type") == "error"))
    rows.write.format("noop").mode("overwrite").save()
    tell()
    return t.spark.createDataFrame([("audit", told[0]["n"], told[0]["failed"])], "event string, n long, failed long")
