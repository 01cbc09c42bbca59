"""Archive records: revisit marks, offsets, index lines, revisit resolution, verification, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeleaf.functions import http, urls
from lakeleaf.operators.windows import running_offset

# The index header and the size above which an equal payload is a revisit.
CDX_HEADER = " CDX N b a m s k r M S V g"
REVISIT_ABOVE = 512


def deduplicated(records: DataFrame, body: str = "body", seq: str = "seq", dedup: bool = True, above: int = REVISIT_ABOVE) -> DataFrame:
    """Records with digest, is_revisit and refers_to (seq of the first record of that payload); payloads of ``above`` bytes or less are never revisits. A minimum per digest joined back; no window over a hot digest."""
    rows = records.withColumn("digest", F.sha2(F.col(body), 256)).withColumn("size", F.octet_length(body).cast("long"))
    firsts = rows.groupBy("digest").agg(F.min(seq).alias("_first"))
    out = rows.join(firsts, "digest")
    again = F.lit(dedup) & (F.col(seq) > F.col("_first")) & (F.col("size") > above)
    return out.withColumn("is_revisit", again).withColumn("refers_to", F.when(again, F.col("_first"))).drop("_first")


def lineage(segments: DataFrame) -> DataFrame:
    """Segments with ``revisit``: an earlier one (by sequence) has the same digest and size."""
    firsts = segments.groupBy("sha256", "bytes").agg(F.min("sequence").alias("_first"))
    return segments.join(firsts, ["sha256", "bytes"]).withColumn("revisit", F.col("sequence") > F.col("_first")).drop("_first")


def cdx_lines(records: DataFrame) -> DataFrame:
    """(file, seq, offset, line) of index lines from records (file, seq, url, ts, mime, status, digest, length)."""
    rows = running_offset(records, "file", "seq", "length")
    line = F.concat_ws(" ", urls.surt("url"), http.cdx_date("ts"), "url", http.mime("mime"), F.col("status").cast("string"), "digest", F.lit("-"), F.lit("-"), F.col("length").cast("string"), F.col("offset").cast("string"), "file")
    return rows.select("file", "seq", "offset", line.alias("line"))


def parsed_cdx(lines: DataFrame, fields: int = 11) -> DataFrame:
    """Index rows of text lines; headers, blanks and short lines are left out."""
    t = F.trim(F.col("value"))
    p = F.split(t, r"\s+")
    rows = lines.where((t != "") & ~F.startswith(t, F.lit("CDX"))).select(p.alias("p")).where(F.size("p") >= fields)
    at = lambda i: F.get("p", F.lit(i))
    return rows.select(at(0).alias("surt"), at(1).alias("ts"), at(2).alias("url"), at(3).alias("mime"), at(4).try_cast("int").alias("status"), at(5).alias("digest"), at(8).try_cast("long").alias("length"), at(9).try_cast("long").alias("offset"), at(10).alias("filename"))


def searched_cdx(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose URL or type holds the query, in any case."""
    q = F.lit(query.lower())
    return rows.where(F.contains(F.lower("url"), q) | F.contains(F.lower("mime"), q))


def bad_spans(cdx: DataFrame, records: DataFrame) -> DataFrame:
    """Index rows whose offset and length are no record's; compressed files are skipped."""
    plain = cdx.where(~F.endswith("filename", F.lit(".gz")))
    return plain.join(records.select(F.col("file").alias("filename"), "offset", "length"), ["filename", "offset", "length"], "left_anti")


def resolved_revisits(records: DataFrame) -> DataFrame:
    """Revisits of a file joined to the earlier record they name: by record id, else payload digest, else target address; ``unresolved`` where there is none."""
    base = records.where("type = 'response' and target_uri is not null")
    keys = {"id": ("record_id", "refers_to"), "digest": ("payload_digest", "payload_digest"), "uri": (urls.replay_key("target_uri"), urls.replay_key("refers_uri"))}
    visits = records.where("type = 'revisit' and target_uri is not null").select("file", "offset", "target_uri", "refers_to", "refers_uri", "payload_digest")
    found = None
    for rank, (have, want) in enumerate(keys.values()):
        have = F.col(have) if isinstance(have, str) else have
        want = F.col(want) if isinstance(want, str) else want
        a = visits.select(F.col("file").alias("f"), F.col("offset").alias("o"), want.alias("k")).where("k is not null")
        b = base.select(F.col("file").alias("bf"), F.col("offset").alias("bo"), have.alias("bk"), F.col("target_uri").alias("found_uri"))
        hit = a.join(b, (F.col("f") == F.col("bf")) & (F.col("k") == F.col("bk")) & (F.col("bo") < F.col("o")))
        best = hit.groupBy("f", "o").agg(F.max_by(F.struct("bo", "found_uri"), "bo").alias("hit")).withColumn("rank", F.lit(rank))
        found = best if found is None else found.unionByName(best)
    first = found.groupBy(F.col("f").alias("file"), F.col("o").alias("offset")).agg(F.min_by("hit", "rank").alias("hit"))
    return visits.join(first, ["file", "offset"], "left").select("file", "offset", "target_uri", F.col("hit.bo").alias("source_offset"), F.coalesce("hit.found_uri", "refers_uri").alias("refers_to"), F.col("hit").isNull().alias("unresolved"))


def last_by_url(records: DataFrame) -> DataFrame:
    """The last record of each address of a file, as replay finds it."""
    rows = records.where("type in ('response', 'revisit') and target_uri is not null").withColumn("key", urls.replay_key("target_uri"))
    return rows.groupBy("file", "key").agg(F.max_by(F.struct("offset", "type", "target_uri"), "offset").alias("r")).select("file", "key", "r.*")


def type_counts(records: DataFrame) -> DataFrame:
    """Per file: records by type, corrupt ones and the verdict."""
    t = F.col("type")
    bad_payload = (t == "response") & F.startswith("payload_digest", F.lit("sha256:")) & ~F.col("payload_ok")
    return records.groupBy("file").agg(
        F.count_if(F.col("error").isNull()).alias("records"),
        *[F.count_if((t == k) & F.col("error").isNull()).alias(k) for k in ("warcinfo", "request", "response", "revisit")],
        (F.count_if(F.col("error").isNotNull()) + F.count_if(F.coalesce(bad_payload, F.lit(False)) & F.col("error").isNull())).alias("corrupt"),
    ).withColumn("passed", F.col("corrupt") == 0)


def payload_mismatches(records: DataFrame) -> DataFrame:
    """Responses whose payload does not have its SHA-256; revisits are not checked."""
    return records.where((F.col("type") == "response") & F.startswith("payload_digest", F.lit("sha256:")) & ~F.col("payload_ok")).select("file", "offset", "target_uri", "payload_digest")


def consolidated(records: DataFrame, body: str = "body", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(payloads by digest, manifest in input order)."""
    rows = records.withColumn("sha256", F.sha2(body, 256)).withColumn("bytes", F.octet_length(body).cast("long"))
    return rows.groupBy("sha256").agg(F.first(body).alias("body")), rows.drop(body).orderBy(seq)


def export_paths(records: DataFrame, by_host: bool = False) -> DataFrame:
    """Records with their export path; paths that several records share are marked ``collision`` (or told apart by host)."""
    path = urls.safe_path("url")
    path = F.concat(urls.host("url"), F.lit("/"), path) if by_host else path
    rows = records.withColumn("path", path)
    shared = rows.groupBy("path").agg(F.count("*").alias("_k"))
    return rows.join(shared, "path", "left").withColumn("collision", F.coalesce(F.col("_k") > 1, F.lit(False))).drop("_k")


def redirect_chains(links: DataFrame, most: int = 20) -> DataFrame:
    """(id, final, hops): each start followed through (source, target) links until there is none, a cycle, or ``most`` hops. Doubling joins: log2(most) rounds."""
    step = links.select(F.col("source").alias("s"), F.col("target").alias("t"))
    now = links.select(F.col("source").alias("id"), F.col("target").alias("final"), F.lit(1).alias("hops"), F.array("source", "target").alias("seen"))
    for _ in range(most - 1):
        nxt = now.join(step, now.final == step.s, "left")
        go = F.col("t").isNotNull() & ~F.array_contains("seen", F.col("t"))
        now = nxt.select("id", F.when(go, F.col("t")).otherwise(F.col("final")).alias("final"), (F.col("hops") + go.cast("int")).alias("hops"), F.when(go, F.concat("seen", F.array("t"))).otherwise(F.col("seen")).alias("seen"))
    return now.select("id", "final", "hops")


def attempts(audit: DataFrame, url: str = "url", seq: str = "seq") -> DataFrame:
    return audit.withColumn("attempt", F.row_number().over(Window.partitionBy(url).orderBy(seq)))


def revisit_ratio() -> Column:
    return F.count_if(F.col("is_revisit")) / F.count("*")


def ordered_digest(records: DataFrame, order: str, body: str) -> DataFrame:
    """One row: the digest of the records' digests in order. Only 64 characters a record meet in one place."""
    rows = records.select(F.col(order).alias("at"), F.sha2(body, 256).alias("d")).agg(F.array_sort(F.collect_list(F.struct("at", "d"))).alias("a"))
    return rows.select(F.sha2(F.array_join(F.transform("a", lambda x: x["d"]), ""), 256).alias("digest"))


def find_sequence(data: str | Column, wanted: bytes) -> Column:
    """Place from 1 of the first occurrence of a byte sequence in a binary or text column, 0 if there is none."""
    raw = F.hex((F.col(data) if isinstance(data, str) else data).cast("binary"))
    # every byte is two digits, so a hit at an odd place is a hit; others are looked for behind it
    digits = wanted.hex().upper()
    pairs = F.regexp_replace(raw, "(..)", "$1 ")
    at = F.instr(pairs, " ".join(digits[i : i + 2] for i in range(0, len(digits), 2)))
    return F.when(at > 0, ((at - 1) / 3).cast("int") + 1).otherwise(0)
