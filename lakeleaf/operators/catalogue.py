"""A document catalogue as a pure function of append-only logs.

Nothing is updated in place: acquisitions, policy events and derivative results are appended, and every other
table (sources, revisions, URL heads, receipts, eligibility) is recomputed from them, so "strictest" and
"latest" cannot be lost by a missed trigger.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeleaf.functions import http
from lakeleaf.operators.extract import by_slices, sorted_json
from lakeleaf.operators.tables import kept

# Labels and states.
HANDLING = ("public", "unknown", "restricted", "quarantined", "revoked")
PROCESSING = ("pending", "complete", "partial", "failed", "encrypted", "unsupported")
RECEIPT = "schema_version string, acquisition_id long, source_id string, acquired double, url string, handling string, before_revision_id string, before_url string, after_revision_id string, before_content_hash string, after_content_hash string, moved_from string, moved boolean, content_changed boolean, duplicate_content boolean, advances_url_head boolean, comparison_basis string"


def source_identity(url: str | Column) -> Column:
    return F.sha2(F.col(url) if isinstance(url, str) else url, 256)


def revision_identity(source: str, digest: str) -> Column:
    return F.sha2(F.concat(F.col(source), F.col(digest)), 256)


def valid_acquisition(url="url", acquired="acquired") -> Column:
    a = F.col(acquired)
    return F.coalesce((F.col(url) != "") & (a >= 0) & ~F.isnan(a) & (a < float("inf")), F.lit(False))


def acquisitions(log: DataFrame) -> DataFrame:
    """Log rows (acquisition_id, url, content, mime, handling, acquired[, moved_from]) with source, digest and cleaned type; the URL's own source, moves aside."""
    rows = log if "moved_from" in log.columns else log.withColumn("moved_from", F.lit(None).cast("string"))
    kind = F.coalesce(F.when(F.col("mime") != "", F.col("mime")), http.guessed_mime(F.regexp_extract("url", r"^[^?#]*", 0)))
    out = rows.where(valid_acquisition()).withColumn("mime", http.mime(kind)).withColumn("content_hash", F.sha2("content", 256)).withColumn("size", F.octet_length("content").cast("long"))
    return out.withColumn("source_id", source_identity("url")).withColumn("handling", F.coalesce("handling", F.lit("unknown")))


def with_moves(rows: DataFrame) -> DataFrame:
    """Replace source_id along declared moves (moved_from an earlier URL): a bounded recursion over the distinct moves only.

    A first registration of a URL that names a known origin takes the origin's source. Rows whose origin is
    unknown at that time, or whose URL already has another source, are marked in ``error``.
    """
    firsts = rows.groupBy("url").agg(F.min_by(F.struct("acquisition_id", "moved_from"), "acquisition_id").alias("f"))
    parent = firsts.select(F.col("url"), F.col("f.acquisition_id").alias("since"), F.when(F.col("f.moved_from") != F.col("url"), F.col("f.moved_from")).alias("parent"))
    known = parent.select(F.col("url").alias("p_url"), F.col("since").alias("p_since"))
    parent = parent.join(known, parent.parent == known.p_url, "left")
    bad = F.col("parent").isNotNull() & (F.col("p_since").isNull() | (F.col("p_since") >= F.col("since")))
    now = kept(parent.select("url", "since", bad.alias("bad"), F.when(~bad & F.col("parent").isNotNull(), F.col("parent")).otherwise(F.col("url")).alias("root")), "moves")
    for _ in range(40):  # doubles the followed distance, so chains of 2 ** 40 moves end
        up = now.select(F.col("url").alias("u"), F.col("root").alias("r"))
        after = kept(now.join(up, now.root == up.u).select("url", "since", "bad", F.col("r").alias("root"), (F.col("r") != F.col("root")).alias("_moved")), "moves")
        now = after.drop("_moved")
        if after.where("_moved").isEmpty():
            break
    roots = now.select(F.col("url").alias("r_url"), source_identity("root").alias("root_id"), "bad")
    origin = now.select(F.col("url").alias("o_url"), source_identity("root").alias("origin_id"), F.col("since").alias("o_since"))
    out = rows.drop("source_id").join(roots, rows.url == roots.r_url).join(origin, F.col("moved_from") == F.col("o_url"), "left")
    error = (
        F.when(F.col("moved_from").isNotNull() & (F.col("o_since").isNull() | (F.col("o_since") >= F.col("acquisition_id")) & (F.col("moved_from") != F.col("url"))), "unknown_move_origin")
        .when(F.col("moved_from").isNotNull() & (F.col("origin_id") != F.col("root_id")), "source_conflict")
        .otherwise(F.lit(None).cast("string"))
    )
    return out.select(*[c for c in rows.columns if c != "source_id"], F.col("root_id").alias("source_id"), error.alias("error"))


def register(log: DataFrame, moves: bool = False) -> DataFrame:
    """One receipt row for each valid acquisition, with its id over the canonical payload.

    The head of a URL is the acquisition with the greatest (acquired, acquisition_id) so far: a backdated one is
    recorded but does not advance it. Whether bytes were stored before is a minimum per digest joined back.
    """
    rows = acquisitions(log)
    rows = with_moves(rows).where("error is null").drop("error") if moves else rows
    rows = rows.withColumn("after_revision_id", revision_identity("source_id", "content_hash"))
    prior = Window.partitionBy("url").orderBy("acquisition_id").rowsBetween(Window.unboundedPreceding, -1)
    head = F.max(F.struct("acquired", "acquisition_id", F.col("after_revision_id").alias("rid"), F.col("content_hash").alias("hash"))).over(prior)
    rows = rows.withColumn("head", head)
    if moves:
        w = Window.partitionBy("url").orderBy("acquisition_id")
        first_move = rows.where(F.col("moved_from").isNotNull() & (F.col("moved_from") != F.col("url"))).select("acquisition_id", F.col("moved_from").alias("m"))
        heads = rows.select(F.col("url").alias("h_url"), F.col("acquisition_id").alias("h_id"), F.struct("acquired", "acquisition_id", F.col("after_revision_id").alias("rid"), F.col("content_hash").alias("hash")).alias("h"))
        found = first_move.join(heads, (F.col("m") == F.col("h_url")) & (F.col("h_id") < F.col("acquisition_id"))).groupBy("acquisition_id").agg(F.max("h").alias("origin_head"))
        rows = rows.join(found, "acquisition_id", "left").withColumn("known", F.row_number().over(w) > 1)
        base = F.coalesce("head", "origin_head")
    else:
        rows = rows.withColumn("known", F.col("head").isNotNull())
        base = F.col("head")
    firsts = rows.groupBy("content_hash").agg(F.min("acquisition_id").alias("stored_by"))
    rows = rows.join(firsts, "content_hash").withColumn("base", base)
    moved = F.col("moved_from").isNotNull() & (F.col("moved_from") != F.col("url"))
    payload = F.struct(
        F.lit("1.0").alias("schema_version"),
        "acquisition_id",
        "source_id",
        "acquired",
        "url",
        "handling",
        F.col("base.rid").alias("before_revision_id"),
        F.when(F.col("base").isNotNull(), F.when(F.col("known"), F.col("url")).otherwise(F.col("moved_from"))).alias("before_url"),
        "after_revision_id",
        F.col("base.hash").alias("before_content_hash"),
        F.col("content_hash").alias("after_content_hash"),
        "moved_from",
        moved.alias("moved"),
        F.when(F.col("base").isNotNull(), F.col("base.hash") != F.col("content_hash")).alias("content_changed"),
        (F.col("stored_by") < F.col("acquisition_id")).alias("duplicate_content"),
        (F.col("head").isNull() | (F.col("acquired") >= F.col("head.acquired"))).alias("advances_url_head"),
        F.lit("url_head_before_registration").alias("comparison_basis"),
    )
    out = rows.select(payload.alias("p"), "mime", "size").withColumn("payload_json", sorted_json(F.to_json("p", {"ignoreNullFields": "false"}))["value"])
    return out.select(F.sha2("payload_json", 256).alias("receipt_id"), "p.*", "mime", "size", "payload_json")


def verified_receipts(receipts: DataFrame) -> DataFrame:
    """Receipts whose id, acquisition and source agree with their payload; others have ``valid`` false."""
    p = F.from_json("payload_json", RECEIPT)
    return receipts.withColumn("valid", (F.sha2("payload_json", 256) == F.col("receipt_id")) & (p["acquisition_id"] == F.col("acquisition_id")) & (p["source_id"] == F.col("source_id")))


def revisions(rows: DataFrame) -> DataFrame:
    """Distinct (source, content) of acquisitions, as first acquired."""
    keyed = rows.withColumn("revision_id", revision_identity("source_id", "content_hash"))
    first = keyed.groupBy("revision_id").agg(F.min_by(F.struct("source_id", "url", "content_hash", "mime", "size", "acquired"), "acquisition_id").alias("r"))
    return first.select("revision_id", "r.*", F.lit("captured").alias("status"))


def url_heads(rows: DataFrame) -> DataFrame:
    """First and last sight of each URL and the revision that its head points to; late rows widen the span but move the head only if they are the latest."""
    keyed = rows.withColumn("revision_id", revision_identity("source_id", "content_hash"))
    return keyed.groupBy("url").agg(F.first("source_id").alias("source_id"), F.max_by("revision_id", F.struct("acquired", "acquisition_id")).alias("revision_id"), F.min("acquired").alias("first_seen"), F.max("acquired").alias("last_seen"))


def content_objects(rows: DataFrame) -> DataFrame:
    return rows.groupBy("content_hash").agg(F.first("content").alias("content"))


def history(revs: DataFrame, heads: DataFrame, url: str) -> DataFrame:
    """Revisions of the source behind a URL, by time."""
    source = heads.where(F.col("url") == url).select("source_id")
    own = heads.sparkSession.range(1).select(source_identity(F.lit(url)).alias("source_id"))
    return revs.join(source.unionByName(own).distinct(), "source_id", "left_semi").orderBy("acquired", "revision_id")


def duplicates(revs: DataFrame, by: str = "content_hash", key: str = "revision_id") -> DataFrame:
    """(key, class, members): every row that shares its content, with the least key of its class and the class's size; copies aren't expanded into pairs.
    Null keys are members, null contents are none."""
    classes = revs.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(key).alias("class"), F.count("*").alias("members")).where("members > 1")
    return revs.join(classes, by).select(F.col(key).alias("key"), "class", "members")


def duplicates_of(revs: DataFrame, wanted: DataFrame, by: str = "content_hash", key: str = "revision_id") -> DataFrame:
    """(key, other): for each stated key the other rows with the same content."""
    asked = revs.join(wanted.select(key), key, "left_semi").select(by, F.col(key).alias("key"))
    return asked.join(revs.select(by, F.col(key).alias("other")), by).where("key <> other").select("key", "other")


def compared(revs: DataFrame, before: str, after: str) -> DataFrame:
    """One row that relates two revisions by source and bytes."""
    pick = lambda rid, name: revs.where(F.col("revision_id") == rid).select(F.struct(*revs.columns).alias(name)).limit(1)
    both = pick(before, "before").crossJoin(pick(after, "after"))
    same_source, same_bytes = F.col("before.source_id") == F.col("after.source_id"), F.col("before.content_hash") == F.col("after.content_hash")
    relation = F.when(F.lit(before == after), "same_revision").when(same_source, "content_changed").when(same_bytes, "duplicate_content").otherwise("distinct_sources")
    return both.select("before", "after", same_source.alias("same_source"), same_bytes.alias("same_bytes"), F.when(same_source, ~same_bytes).alias("content_changed"), (F.col("after.size") - F.col("before.size")).alias("size_delta"), relation.alias("relation"))


# --- policy ---------------------------------------------------------------------
POLICY_OUT = "source_id string, event_id long, action string, reason string, error string, handling string, flags array<string>, retain_until double, legal_hold boolean, removed boolean"


def policy_fold(initial: str, events) -> list[dict]:
    return list(policy_steps(initial, events))


def policy_steps(initial: str, events):
    """Apply one source's ordered policy events, one at a time; an event that is refused has an error and changes nothing."""
    now = {"handling": initial, "flags": [], "retain_until": None, "legal_hold": False, "removed": False}
    for e in events:
        details = json.loads(e["details"] or "{}")
        reason, action = e["reason"] or "", e["action"]
        error, change = None, {}
        if not reason.strip() or len(reason) > 1000:
            error = "invalid_policy_reason"
        elif now["removed"]:
            error = "source_removed"
        elif action == "handling":
            label = details.get("handling")
            if label not in HANDLING:
                error = "invalid_handling"
            elif label == "public" and now["handling"] != "public":
                error = "handling_relaxation_requires_review"
            change = {"handling": label}
        elif action == "flag":
            flag = details.get("flag")
            if not isinstance(flag, str) or not flag.strip() or len(flag) > 100:
                error = "invalid_source_flag"
            else:
                change = {"flags": sorted({*now["flags"], flag}), "handling": "quarantined"}
        elif action == "retention":
            change = {k: details[k] for k in ("retain_until", "legal_hold") if k in details}
            until, hold = change.get("retain_until"), change.get("legal_hold", False)
            if not isinstance(hold, bool) or (until is not None and (isinstance(until, bool) or not isinstance(until, (int, float)) or not 0 <= until < float("inf"))):
                error = "invalid_retention"
            elif until is not None:
                change["retain_until"] = float(until)
        elif action == "remove":
            if details.get("confirm") != e["source_id"]:
                error = "confirmation_required"
            elif now["legal_hold"]:
                error = "legal_hold"
            elif now["retain_until"] is not None and now["retain_until"] > (e["recorded"] or 0):
                error = "retention_active"
            change = {"removed": True, "handling": "revoked"}
        else:
            error = "unknown_action"
        now |= {} if error else change
        yield {"source_id": e["source_id"], "event_id": e["event_id"], "action": action, "reason": reason, "error": error, **now}


def policy_history(events: DataFrame, sources: DataFrame) -> DataFrame:
    """State after each event (source_id, event_id, action, reason, recorded, details) of each source (source_id, handling).

    Events are sorted by source and number inside their partitions and folded as they stream by: only one source's state is
    held, whatever the number of its events."""
    from itertools import chain, groupby

    import pyarrow as pa

    schema = pa.schema([(n, t) for n, t in zip([c.split()[0] for c in POLICY_OUT.split(", ")], (pa.string(), pa.int64(), *[pa.string()] * 4, pa.list_(pa.string()), pa.float64(), pa.bool_(), pa.bool_()))])

    def run(batches):
        rows = chain.from_iterable(b.to_pylist() for b in batches)
        steps = (step for _, mine in groupby(rows, lambda r: r["source_id"]) for first in [next(mine)] for step in policy_steps(first["initial"], chain([first], mine)))
        while part := [x for _, x in zip(range(5000), steps)]:
            yield pa.RecordBatch.from_pylist(part, schema)

    joined = events.join(sources.select("source_id", F.col("handling").alias("initial")), "source_id").select("source_id", "event_id", "action", "reason", "recorded", "details", "initial")
    return joined.repartition("source_id").sortWithinPartitions("source_id", "event_id").mapInArrow(run, POLICY_OUT)


def policy_state(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Current policy of every source, those without events too."""
    last = policy_history(events, sources).groupBy("source_id").agg(F.max_by(F.struct("handling", "flags", "retain_until", "legal_hold", "removed"), "event_id").alias("s"))
    own = sources.select("source_id", F.col("handling").alias("initial")).join(last, "source_id", "left")
    none = F.array().cast("array<string>")
    return own.select("source_id", F.coalesce("s.handling", "initial").alias("handling"), F.coalesce("s.flags", none).alias("flags"), "s.retain_until", F.coalesce("s.legal_hold", F.lit(False)).alias("legal_hold"), F.coalesce("s.removed", F.lit(False)).alias("removed"))


def latest_restriction(rows: DataFrame, key: str = "source_id", label: str = "handling", order: tuple[str, ...] = ("acquired", "acquisition_id")) -> DataFrame:
    """The last label other than public of each source."""
    return rows.where(F.col(label) != "public").groupBy(key).agg(F.max_by(label, F.struct(*order)).alias(label))


def source_handling(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """(source_id, handling): the policy's label; where that is public, the last restricting acquisition counts."""
    strict = latest_restriction(rows).withColumnRenamed("handling", "acquired_as")
    out = policy.join(strict, "source_id", "left")
    return out.select("source_id", F.when((F.col("handling") == "public") & F.col("acquired_as").isNotNull(), F.col("acquired_as")).otherwise(F.col("handling")).alias("handling"))


def with_open_source(revs: DataFrame, policy: DataFrame) -> DataFrame:
    """Revisions whose source is public, unflagged and not removed."""
    return revs.join(policy.where((F.col("handling") == "public") & (F.size("flags") == 0) & ~F.col("removed")), "source_id", "left_semi")


def with_acquisition(revs: DataFrame, acquired: DataFrame) -> DataFrame:
    return revs.join(acquired, "revision_id", "left_semi")


def without_restricted(revs: DataFrame, holders: DataFrame) -> DataFrame:
    """Revisions that no row of ``holders`` (acquisitions or derivatives: revision_id, handling) restricts."""
    return revs.join(holders.where("handling <> 'public'"), "revision_id", "left_anti")


def eligible_revisions(revs: DataFrame, policy: DataFrame, acquired: DataFrame, derivatives: DataFrame) -> DataFrame:
    """Revisions that may leave: of an open source, acquired, and without any restricted acquisition or derivative. Semi and anti joins only."""
    return without_restricted(without_restricted(with_acquisition(with_open_source(revs, policy), acquired), acquired), derivatives)


def eligible_derivatives(derivatives: DataFrame, eligible: DataFrame) -> DataFrame:
    ready = F.col("status").isin("complete", "partial") & (F.length(F.trim("text")) > 0) & (F.col("handling") == "public")
    return derivatives.where(ready).join(eligible, "revision_id", "left_semi")


def originals(revs: DataFrame, objects: DataFrame) -> DataFrame:
    """Revisions with their bytes; ``intact`` says whether the bytes still have their digest."""
    return revs.join(objects, "content_hash").withColumn("intact", F.sha2("content", 256) == F.col("content_hash"))


def exported_originals(revs, policy, acquired, derivatives, objects) -> DataFrame:
    return originals(eligible_revisions(revs, policy, acquired, derivatives), objects).where("intact")


# --- derivatives ------------------------------------------------------------------
def derivative_problem() -> Column:
    """Why a derivative result (text, status, extractor, output_hash, source_hash, content_hash, kind, confidence, locators) is refused, or null."""
    places = F.col("locators")
    good_places = F.forall(places, lambda p: (p["start"] >= 0) & (p["start"] <= p["end"]) & (p["end"] <= F.length("text")))
    return (
        F.when(F.col("text").isNull() | (F.length("text") > 8 << 20) | ~F.col("status").isin(*PROCESSING) | (F.coalesce("extractor", F.lit("")) == "") | places.isNull() | (F.size(places) > 100_000), "invalid_derivative")
        .when(~F.col("output_hash").eqNullSafe(F.sha2("text", 256)), "output_hash_mismatch")
        .when(F.col("source_hash").isNotNull() & (F.col("source_hash") != F.col("content_hash")), "source_hash_mismatch")
        .when(~F.col("kind").isin("text", "ocr"), "invalid_derivative_kind")
        .when(~good_places, "invalid_derivative_locators")
        .when((F.trim("text") != "") & F.col("status").isin("complete", "partial") & (F.size(places) == 0), "missing_derivative_locators")
        .when((F.col("kind") == "ocr") & (F.col("text") != "") & ~F.coalesce(F.col("source_hash").isNotNull() & F.col("confidence").between(0, 100), F.lit(False)), "invalid_ocr_provenance")
    )


def derivative_identity(revision: str, metadata: str, places: str) -> Column:
    """``search:`` and the digest of the compact JSON list of revision, metadata text and locator text."""
    compact = json.JSONEncoder(separators=(",", ":")).encode

    @F.arrow_udf("string")
    def run(r: pa.Array, m: pa.Array, p: pa.Array) -> pa.Array:
        return by_slices(lambda *x: "search:" + hashlib.sha256(compact(list(x)).encode()).hexdigest(), pa.string(), r, m, p)

    return run(revision, metadata, places)


def index_add(results: DataFrame, revs: DataFrame, handling: DataFrame) -> DataFrame:
    """Derivative rows of valid results (with source_id, revision_id): each identity once, label inherited from a source that is not public."""
    known = revs.select("revision_id", "source_id", "content_hash")
    rows = results.join(known, ["revision_id", "source_id"]).join(handling.select("source_id", F.col("handling").alias("source_label")), "source_id")
    rows = rows.withColumn("error", derivative_problem()).where("error is null").drop("error")
    metadata = sorted_json(F.to_json(F.struct("extractor", "kind", "output_hash", "reason", "status"), {"ignoreNullFields": "false"}))["value"]
    places = sorted_json(F.to_json("locators"))["value"]
    rows = rows.withColumn("extraction_json", metadata).withColumn("locator_json", places)
    rows = rows.withColumn("derivative_id", derivative_identity("revision_id", "extraction_json", "locator_json"))
    label = F.when(F.col("source_label") != "public", F.col("source_label")).otherwise(F.coalesce("handling", "source_label"))
    out = rows.select("derivative_id", "revision_id", "kind", "extractor", "output_hash", "status", "text", "locator_json", "extraction_json", label.alias("handling"))
    return out.dropDuplicates(["derivative_id"])


def search_hits(query: str, derivatives: DataFrame, revs: DataFrame, policy: DataFrame, acquired: DataFrame, objects: DataFrame, limit: int | None = 20, source_id=None, revision_id=None, kind=None) -> DataFrame:
    """Cited hits: policy is applied before ranking and limiting, so hidden rows never crowd out others; without a limit all hits, in no order."""
    from lakeleaf.operators.retrieval import full_text

    if any(v is not None and (not isinstance(v, str) or not v) for v in (source_id, revision_id)) or kind not in (None, "text", "ocr"):
        raise ValueError("bad search filter")
    visible = eligible_derivatives(derivatives, eligible_revisions(revs, policy, acquired, derivatives)).where(F.sha2("text", 256) == F.col("output_hash"))
    scores = full_text(visible, query)
    out = scores.withColumnRenamed("id", "derivative_id").join(visible, "derivative_id").join(revs.select("revision_id", "source_id", "url", "content_hash"), "revision_id")
    for name, value in (("source_id", source_id), ("revision_id", revision_id), ("kind", kind)):
        if value is not None:
            out = out.where(F.col(name) == value)
    out = out.join(objects.select("content_hash", F.lit(True).alias("_there")), "content_hash", "left")
    out = out.select("derivative_id", "score", "source_id", "revision_id", "url", "kind", "status", "extractor", "text", "locator_json", F.coalesce("_there", F.lit(False)).alias("original_available"))
    return out if limit is None else out.orderBy(F.desc("score"), "derivative_id").limit(limit)


# --- jobs and findings --------------------------------------------------------------
# Which state follows which.
JOB_STEPS = {"queued": ("running", "cancelled"), "running": ("paused", "complete", "partial", "auth-required", "failed", "cancelled"), "paused": ("running", "cancelled")}
FINDING_STEPS = {"proposed": "reproduced", "reproduced": "fixed", "fixed": "verified", "verified": "proposed"}


def job_identity(spec_json: str | Column) -> Column:
    return F.substring(F.sha2(sorted_json(spec_json)["value"], 256), 1, 32)


def folded_states(events: DataFrame, key: str, order: str, state: str, steps: dict[str, tuple[str, ...]], first: str) -> DataFrame:
    """State of each key after its ordered requests; a request that the table of steps does not allow is counted, not applied."""
    allowed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(y) for y in x]) for kv in steps.items() for x in kv])
    ordered = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, state))).alias("e"))
    begin = F.struct(F.lit(first).alias("state"), F.lit(0).alias("refused"))

    def step(acc, x):
        good = F.coalesce(F.array_contains(F.element_at(allowed, acc["state"]), x[state]), F.lit(False))
        return F.struct(F.when(good, x[state]).otherwise(acc["state"]).alias("state"), (acc["refused"] + F.when(good, 0).otherwise(1)).alias("refused"))

    return ordered.select(key, F.aggregate("e", begin, step).alias("r")).select(key, "r.state", F.col("r.refused").cast("long").alias("refused"))


def ordered_receipts(receipts: DataFrame, source_id: str | None = None) -> DataFrame:
    """Receipts that verify, in the order of acquisition (``rank``), of one source or all; a receipt that doesn't verify raises."""
    from lakeleaf.operators.windows import global_rank

    rows = verified_receipts(receipts if source_id is None else receipts.where(F.col("source_id") == source_id))
    good = F.when(F.col("valid"), F.col("receipt_id")).otherwise(F.raise_error(F.lit("change_receipt_integrity")))
    return global_rank(rows.withColumn("receipt_id", good).drop("valid"), [F.asc("acquisition_id")])


def resumed(states: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(job, state, generation): jobs (job, state) joined with their last good checkpoint (job, generation, valid); a queued or paused job runs again, others stay as they are."""
    last = checkpoints.where("valid").groupBy("job").agg(F.max("generation").alias("generation"))
    return states.join(last, "job", "left").select("job", F.when(F.col("state").isin("queued", "paused"), "running").otherwise(F.col("state")).alias("state"), F.coalesce("generation", F.lit(0)).alias("generation"))
