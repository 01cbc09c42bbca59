"""Validators of coverage claims, checkpoints, locks, acceptance results and schedules."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeleaf.functions.http import SAFE_INTEGER
from lakeleaf.operators.extract import strict_tree

# Limits and names of the checkpoint format.
KINDS = ("warc", "cdx")
CHUNK, STATE_BYTES, STATE_DEPTH = 262_144, 32 << 20, 64
SECRET_NAME = re.compile("token|credential|password|passphrase|cookie|authorization|secret|auth", re.I)
HEX64 = "^[0-9a-f]{64}$"
OCR_PAGES, OCR_PIXELS = 16, 64_000_000


def text_coverage_ok(c: Column) -> Column:
    """Arithmetic of a text coverage struct (scope, total, visited, filled, missing: array<int>): what was visited is split into filled and missing parts, and no more than the total."""
    total_ok = c["total"].isNull() | (c["visited"] <= c["total"])
    counts = (c["visited"] >= 0) & (c["filled"] >= 0) & F.coalesce(c["total"] >= 0, F.lit(True))
    missing = c["missing"]
    pages = (c["filled"] + F.size(missing) == c["visited"]) & F.forall(missing, lambda p: p.between(1, c["visited"])) & (F.size(F.array_distinct(missing)) == F.size(missing))
    parts = c["filled"] <= c["visited"]
    out = F.when(c["scope"] == "unassessed", F.lit(True)).when(c["scope"] == "text_layer", counts & total_ok & pages).when(c["scope"].isin("body_paragraphs", "stored_cells"), counts & total_ok & parts).otherwise(F.lit(False))
    return F.coalesce(out, F.lit(False))


def ocr_coverage_ok(c: Column, pages: Column, status: Column) -> Column:
    """OCR coverage (total, visited, filled, missing, pixels) against the pages its places name: bounded pages and pixels, every visited page read or missing, ``complete`` only if nothing is."""
    missing = c["missing"]
    distinct = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    within = lambda a: F.forall(a, lambda p: p.between(1, c["visited"]))
    good = (c["visited"].between(0, F.least(c["total"], F.lit(OCR_PAGES)))) & c["pixels"].between(0, OCR_PIXELS) & (c["filled"] == F.size(pages)) & (F.size(pages) + F.size(missing) == c["visited"])
    good = good & within(missing) & within(pages) & distinct(missing) & distinct(pages) & (F.size(F.array_intersect(pages, missing)) == 0)
    done = (status != "complete") | ((c["visited"] == c["total"]) & (c["total"] > 0) & (F.size(missing) == 0))
    return F.coalesce(good & done, F.lit(False))


def state_problem(state) -> str | None:
    """Why a checkpoint state cannot be kept: not plain JSON, too deep, too large, or a name that sounds like a credential."""
    if not isinstance(state, dict):
        return "not an object"
    stack = [(state, 0)]
    while stack:
        value, depth = stack.pop()
        if depth > STATE_DEPTH:
            return "too deep"
        if isinstance(value, dict):
            for name, child in value.items():
                if name == "tokens":  # the public balance of a token bucket
                    if isinstance(child, bool) or not isinstance(child, (int, float)) or not math.isfinite(child) or not 0 <= child <= SAFE_INTEGER:
                        return "tokens"
                elif not isinstance(name, str) or SECRET_NAME.search(name):
                    return "credential name"
                else:
                    stack.append((child, depth + 1))
        elif isinstance(value, list):
            stack += [(x, depth + 1) for x in value]
        elif value is not None and not isinstance(value, (str, int, float, bool)):
            return "not JSON"
    try:
        size = len(json.dumps(state, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode())
    except (ValueError, UnicodeError):
        return "not JSON"
    return "too large" if size > STATE_BYTES else None


def _count(v, least: int = 0) -> bool:
    return type(v) is int and least <= v <= SAFE_INTEGER


def metadata_problem(text: str, archive: str) -> str | None:
    """Why a checkpoint file is not acceptable: repeated keys, other fields, bad prefixes, or a last chunk that does not end at its prefix."""
    try:
        v = strict_tree(text)
    except (ValueError, RecursionError):
        return "not strict JSON"
    names = {"schema", "archive_id", "generation", "profile_hash", "state", "prefixes", "last_chunks"}
    if not isinstance(v, dict) or set(v) != names or v["archive_id"] != archive or not _count(v["generation"], 1):
        return "fields"
    if not isinstance(v["profile_hash"], str) or not re.match(HEX64, v["profile_hash"]):
        return "profile"
    if problem := state_problem(v["state"]):
        return f"state: {problem}"
    prefixes, chunks = v["prefixes"], v["last_chunks"]
    if not isinstance(prefixes, dict) or set(prefixes) != set(KINDS) or not isinstance(chunks, dict) or set(chunks) - set(KINDS):
        return "prefixes"
    sound = lambda d, fields: isinstance(d, dict) and set(d) == fields and isinstance(d["sha256"], str) and re.match(HEX64, d["sha256"])
    for p in prefixes.values():
        if not sound(p, {"bytes", "sha256"}) or not _count(p["bytes"]):
            return "prefix"
    for kind, c in chunks.items():
        if not sound(c, {"offset", "bytes", "sha256"}) or not _count(c["offset"]) or not _count(c["bytes"], 1) or c["bytes"] > CHUNK or c["offset"] + c["bytes"] != prefixes[kind]["bytes"]:
            return "last chunk"
    return None


def checkpoint_state(text: str | Column) -> Column:
    """The problem of a JSON state, null if there is none."""

    @F.udf("string", useArrow=True)
    def run(t):
        try:
            return state_problem(json.loads(t))
        except (TypeError, ValueError, RecursionError):
            return "not JSON"

    return run(text)


def checkpoint_metadata(text: str | Column, archive: str | Column) -> Column:
    @F.udf("string", useArrow=True)
    def run(t, a):
        return metadata_problem(t or "", a)

    return run(text, archive)


def open_archives(archives: DataFrame, receipts: DataFrame) -> DataFrame:
    """Archives that may be reopened: none that has a receipt."""
    return archives.join(receipts.select("archive_id"), "archive_id", "left_anti")


def lock_problems(lock: DataFrame) -> DataFrame:
    """(path, problem) of lock entries (role, path, url, sha256, size): repeated roles or paths, other schemes, bad digests or sizes."""
    roles = lock.groupBy("role").agg(F.count("*").alias("_r"))
    paths = lock.groupBy("path").agg(F.count("*").alias("_p"))
    rows = lock.join(roles, "role").join(paths, "path")
    problem = F.when(F.col("_r") > 1, "repeated role").when(F.col("_p") > 1, "repeated path").when(~F.startswith("url", F.lit("https://")), "scheme").when(~F.col("sha256").rlike(HEX64), "digest").when(~F.coalesce(F.col("size") > 0, F.lit(False)), "size")
    return rows.select("path", problem.alias("problem")).where("problem is not null")


def acceptance(measurements: DataFrame, group: str = "grp", status: str = "status") -> DataFrame:
    """Three-valued fold: a group failed if anything failed, is pending if anything is, else passed."""
    rank = F.max(F.when(F.col(status) == "failed", 2).when(F.col(status) == "pending", 1).otherwise(0))
    return measurements.groupBy(group).agg(F.when(rank == 2, "failed").when(rank == 1, "pending").otherwise("passed").alias("status"))


def bound(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """(path, bound): evidence (path, size, sha256) whose file still has that size and digest."""
    have = files.select("path", F.col("size").alias("_z"), F.col("sha256").alias("_s"))
    return evidence.join(have, "path", "left").select("path", F.coalesce((F.col("_z") == F.col("size")) & (F.col("_s") == F.col("sha256")), F.lit(False)).alias("bound"))


def leases(requests: DataFrame, seconds: int = 300) -> DataFrame:
    """Lease requests (job, seq, at seconds) with ``granted``: none is running. A fold in order, since a refused request does not extend the lease."""
    if seconds < 1:
        raise ValueError("bad lease")
    ordered = requests.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("seq", "at"))).alias("r"))
    begin = F.struct(F.lit(-1e18).alias("until"), F.array().cast("array<struct<seq:bigint,granted:boolean>>").alias("out"))

    def step(acc, x):
        ok = x["at"] >= acc["until"]
        return F.struct(F.when(ok, x["at"] + float(seconds)).otherwise(acc["until"]).alias("until"), F.concat(acc["out"], F.array(F.struct(x["seq"].cast("bigint").alias("seq"), ok.alias("granted")))).alias("out"))

    done = ordered.select("job", F.explode(F.aggregate("r", begin, step, lambda a: a["out"])).alias("o"))
    return done.select("job", "o.seq", "o.granted")


def notification(jobs: DataFrame) -> DataFrame:
    """What may be told of a job: its id, state and kind, never its specification."""
    return jobs.select("id", "state", F.lit("job").alias("kind"))


def inventory(files: DataFrame) -> DataFrame:
    """(path, sha256, size) of files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


def lock_inventory(entries: DataFrame) -> DataFrame:
    """(role, entries, bytes) of a lock's entries (role, size)."""
    return entries.groupBy("role").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))
