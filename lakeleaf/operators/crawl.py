"""Replay of a crawl over captured links: frontier rounds, retries, scope decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeleaf.functions import http, urls
from lakeleaf.operators.tables import kept
from lakeleaf.operators.windows import global_rank


def ordered_frontier(frontier: DataFrame) -> DataFrame:
    """Ranked by tier, then depth, then insertion."""
    return fifo(frontier, ["tier", "depth", "seq"])


def fifo(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank``, the gapless place of each row in the queue."""
    return global_rank(rows, [F.asc(c) for c in order])


def frontier(seeds: DataFrame, links: DataFrame, max_depth: int, domains: list[str], first_wins: bool = False, max_pages: int | None = None) -> DataFrame:
    """(url, depth, state) reached from seed addresses over (source, target) links, one round a depth.

    A page keeps its least depth; targets out of scope or beyond ``max_depth`` are ``excluded`` with a reason. Each
    round joins only the newest pages with the links and leaves out what was seen; rounds are at most max_depth + 1.
    ``max_pages`` bounds attempted pages, in order of depth and address.
    """
    canon = kept(links.select(urls.canonical("source").alias("source"), urls.canonical("target").alias("target")).where("source is not null and target is not null").distinct(), "links")
    fresh = seeds.select(urls.canonical("url").alias("url")).where("url is not null").distinct().withColumn("depth", F.lit(0))
    seen = fresh.withColumn("reason", F.when(~urls.in_scope("url", domains), "out_of_scope"))
    fresh = seen.where("reason is null").select("url", "depth")
    for depth in range(1, max_depth + 2):
        found = fresh.join(canon, fresh.url == canon.source).select(F.col("target").alias("url")).distinct()
        found = found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        reason = F.when(~urls.in_scope("url", domains), "out_of_scope").when(F.col("depth") > max_depth, "depth_limit")
        found = kept(found.withColumn("reason", reason), "frontier")  # else each round computes all before it twice
        if found.isEmpty():
            break
        seen = seen.unionByName(found)
        fresh = found.where("reason is null").select("url", "depth")
    out = seen.select("url", "depth", F.when(F.col("reason").isNull(), "queued").otherwise("excluded").alias("state"), "reason")
    if max_pages is not None:
        first = global_rank(out.where("state = 'queued'"), [F.asc("depth"), F.asc("url")], "n").select("url", "n")
        out = out.join(first, "url", "left").withColumn("state", F.when(F.col("n") > max_pages, "pending").otherwise(F.col("state"))).drop("n")
    return out


def with_attempts(audit: DataFrame, most: int = 3) -> DataFrame:
    """Audit rows with their attempt number and whether another try follows: countable failures only, at most ``most`` re-queues."""
    w = Window.partitionBy("url").orderBy("seq")
    rows = audit.withColumn("attempt", F.row_number().over(w))
    return rows.withColumn("requeue", http.is_countable_failure("status") & (F.col("attempt") <= most))


def retryable(outcomes: DataFrame, wanted: DataFrame, limit: int = 3) -> DataFrame:
    """The first ``limit`` wanted addresses (seq, url) whose outcome is transient or a network failure, in the caller's order."""
    joined = wanted.join(outcomes, "url", "left")
    kind = http.retry_class("status", "error_type")
    return joined.where(kind.isin("transient", "network")).orderBy("seq").select("url", kind.alias("class")).limit(max(0, limit))


def unvisited(found: DataFrame, visited: DataFrame) -> DataFrame:
    return found.join(visited.select("url"), "url", "left_anti")


def robots_gate(frontier_rows: DataFrame, robots: DataFrame) -> DataFrame:
    """Frontier rows with ``robots_denied``, by their origin's rules; an origin without rules is open."""
    from lakeleaf.operators.discover import robots_disallow

    p = urls.parts("url")
    rows = frontier_rows.withColumn("origin", F.concat(p["scheme"], F.lit("://"), p["netloc"])).withColumn("_target", F.concat(F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]), F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"]))))
    out = rows.join(robots, "origin", "left")
    return out.withColumn("robots_denied", F.coalesce(robots_disallow(F.col("_target"), F.col("rules")), F.lit(False))).drop("_target", "rules")
