"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Plans:
    """Queries of one module: ``add`` takes a function of (tables, F) and, where SQL can say it, the SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(Tables(spark, sf_dir))

            run.__name__ = name
            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return f

        return keep


class Tables:
    """The supplied tables and inputs shaped like a crawl's, derived from them in the same way as the SQL twins do."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def audit(self) -> DataFrame:
        """An audit ledger from ``events``: one request each, on a path of user and event type."""
        e = self.events
        status = F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 302).when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 404).otherwise(429)
        return e.select(
            F.col("event_id").alias("seq"),
            "ts",
            F.concat(F.lit("https://h"), (F.col("user_id") % 7).cast("string"), F.lit(".example.com/u"), (F.col("user_id") % 20).cast("string"), F.lit("/"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string")).alias("url"),
            status.alias("status"),
            F.col("value").alias("latency_ms"),
            F.when(status < 400, F.sha2("props", 256)).alias("digest"),
            "event_type",
            "user_id",
        )

    def outcomes(self) -> DataFrame:
        """Resource outcomes from ``events``."""
        t = F.col("event_type")
        state = F.when(t.isin("view", "click"), "captured").when(t == "error", "failed").when(t == "signup", "pending").otherwise("excluded")
        return self.events.select(F.concat(F.lit("https://example.com/r/"), F.col("event_id").cast("string")).alias("url"), state.alias("state"), F.when(t == "click", 302).when(t == "view", 200).when(t == "error", 503).alias("status"), F.when(t.isin("view", "click"), F.floor(F.col("value") * 100).cast("long")).alias("bytes"), F.when(F.col("event_id") % 5 != 0, F.floor(F.col("value") * 100).cast("long")).alias("declared_bytes"), F.when(t.isin("view", "click"), F.sha2("props", 256)).alias("sha256"), "event_id", "user_id")

    def acquisitions(self) -> DataFrame:
        """An acquisition log from ``events``: the URL is the user's, the content the event type, some rows backdated by a day."""
        back = F.when(F.col("event_id") % 11 == 0, 86400.0).otherwise(0.0)
        label = F.when(F.col("event_id") % 97 == 0, "restricted").otherwise("public")
        return self.events.select(F.col("event_id").alias("acquisition_id"), F.concat(F.lit("https://example.com/u/"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").cast("binary").alias("content"), F.lit("text/plain; charset=utf-8").alias("mime"), label.alias("handling"), (F.unix_seconds(F.col("ts").cast("timestamp")).cast("double") - back).alias("acquired"))


AUDIT = """SELECT event_id AS seq, ts, 'https://h' || (user_id % 7) || '.example.com/u' || (user_id % 20) || '/' || event_type || '/' || event_id AS url,
 CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 302 WHEN 'error' THEN 503 WHEN 'signup' THEN 404 ELSE 429 END AS status,
 value AS latency_ms, CASE WHEN event_type IN ('view','click') THEN sha256(props) END AS digest, event_type, user_id, '/u' || (user_id % 20) || '/' || event_type AS section FROM events"""
OUTCOMES = """SELECT 'https://example.com/r/' || event_id AS url, CASE WHEN event_type IN ('view','click') THEN 'captured' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'pending' ELSE 'excluded' END AS state,
 CASE event_type WHEN 'click' THEN 302 WHEN 'view' THEN 200 WHEN 'error' THEN 503 END AS status,
 CASE WHEN event_type IN ('view','click') THEN CAST(floor(value * 100) AS BIGINT) END AS bytes, CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value * 100) AS BIGINT) END AS declared_bytes,
 CASE WHEN event_type IN ('view','click') THEN sha256(props) END AS sha256, event_id, user_id FROM events"""
ACQUISITIONS = """SELECT event_id AS acquisition_id, 'https://example.com/u/' || user_id AS url, event_type AS content, 'text/plain' AS mime, CASE WHEN event_id % 97 = 0 THEN 'restricted' ELSE 'public' END AS handling,
 CAST(floor(epoch(ts)) AS DOUBLE) - CASE WHEN event_id % 11 = 0 THEN 86400.0 ELSE 0.0 END AS acquired, sha256('https://example.com/u/' || user_id) AS source_id, sha256(event_type) AS content_hash,
 sha256(sha256('https://example.com/u/' || user_id) || sha256(event_type)) AS revision_id, octet_length(encode(event_type)) AS size FROM events"""
#: Host, path and query of pages.url in SQL.
PAGES = """SELECT page_id, url, html, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
 regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages"""
