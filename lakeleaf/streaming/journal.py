"""Journals and event streams: exact-retry dedupe, gaps, late rows, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accepted(batches: DataFrame) -> DataFrame:
    """Journal rows (client, sequence, sha256, seen) once each: an exact retry is dropped, another digest under the same number is ``conflict``."""
    first = batches.groupBy("client", "sequence").agg(F.min_by("sha256", "seen").alias("_sha"), F.min("seen").alias("_seen"))
    rows = batches.join(first, ["client", "sequence"])
    state = F.when(F.col("seen") == F.col("_seen"), "accepted").when(F.col("sha256") == F.col("_sha"), "retry").otherwise("conflict")
    return rows.select("client", "sequence", "sha256", "seen", state.alias("state"))


def deduplicated_stream(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Exact retries of a journal stream dropped while their number may still recur."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["client", "sequence", "sha256"])


def numbered(rows: DataFrame, journal: str, order: list[str]) -> DataFrame:
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(journal).orderBy(*order)).cast("long"))


def gaps(rows: DataFrame) -> DataFrame:
    """(client, from_sequence, missing) where a client's numbers jump: rows its queue dropped."""
    w = Window.partitionBy("client").orderBy("sequence")
    out = rows.withColumn("_prev", F.lag("sequence").over(w))
    return out.where(F.col("sequence") - F.col("_prev") > 1).select("client", (F.col("_prev") + 1).alias("from_sequence"), (F.col("sequence") - F.col("_prev") - 1).alias("missing"))


def heads(events: DataFrame, key: str, value: str, time: str, tie: str) -> DataFrame:
    """First and last sight of each key and the value of its latest row, in batch or as a stream in update mode. Late rows widen the span; nothing is dropped."""
    return events.groupBy(key).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.max_by(value, F.struct(time, tie)).alias("head"))


def windowed_counts(events: DataFrame, ts: str, width: str, slide: str | None = None, keys: tuple[str, ...] = (), delay: str = "10 minutes") -> DataFrame:
    """Counts by time window with a watermark; an addition of this engine."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, delay).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions that end after an idle gap; an addition of this engine."""
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def checkpoint_chain(states: DataFrame) -> DataFrame:
    """Checkpoint rows (archive_id, generation, expected, prefix_bytes, prefix_sha256) that extend their predecessor: generations rise by one, the writer named the one it saw, prefixes do not shrink."""
    w = Window.partitionBy("archive_id").orderBy("generation")
    prev, size = F.lag("generation").over(w), F.lag("prefix_bytes").over(w)
    good = F.when(prev.isNull(), F.col("generation") == 1).otherwise((F.col("generation") == prev + 1) & (F.col("expected") == prev) & (F.col("prefix_bytes") >= size))
    return states.withColumn("valid", F.coalesce(good, F.lit(False)))


def appended_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk requests (stream, arrival, offset, size, sha256) against the stream's length so far: appended, an exact retry of the last chunk, or a mismatch. Sizes above 256 KiB are refused."""
    w = Window.partitionBy("stream").orderBy("arrival")
    first = chunks.groupBy("stream", "offset", "sha256").agg(F.min("arrival").alias("_first"))
    rows = chunks.join(first, ["stream", "offset", "sha256"])
    new = (F.col("arrival") == F.col("_first")) & (F.col("size") <= 262144) & (F.col("size") > 0)
    before = F.coalesce(F.sum(F.when(new, F.col("size"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    state = F.when(F.col("size") > 262144, "too_large").when(~new, "retry").when(before == F.col("offset"), "appended").otherwise("offset_mismatch")
    return rows.select("stream", "arrival", "offset", "size", state.alias("state"))


def status(rows: DataFrame) -> DataFrame:
    """(client, events, last, missing) of numbered journal rows (client, sequence): how many there are, the last number, how many numbers are missing."""
    out = rows.groupBy("client").agg(F.count_distinct("sequence").alias("events"), F.max("sequence").alias("last"))
    return out.withColumn("missing", F.col("last") - F.col("events"))


def idle_stops(events: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """(key, stops): how often a key was silent for longer than ``seconds`` between two events."""
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(Window.partitionBy(key).orderBy(ts)))
    return events.select(key, gap.alias("_gap")).groupBy(key).agg(F.count_if(F.col("_gap") > seconds * 1e6).alias("stops"))
