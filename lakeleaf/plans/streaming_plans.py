"""Streaming, stateful, source and sink queries."""

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeleaf.operators import archive as A
from lakeleaf.operators import checks as V
from lakeleaf.operators import windows as W
from lakeleaf.operators.tables import shared_folder
from lakeleaf.plans.base import Plans
from lakeleaf.sources import files, sinks, warc_files
from lakeleaf.streaming import journal as J
from lakeleaf.streaming import pacing as S

P = Plans()


def _stream(t) -> DataFrame:
    """``events`` as a stream of files."""
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


def _drained(t, df: DataFrame, mode: str) -> DataFrame:
    """Run a stream to its end and return what it holds, as written by tasks in the shared folder: every batch, or the last one of mode ``complete``."""
    path = _folder(t, "drained")
    t.spark.createDataFrame([], df.schema).write.parquet(f"{path}/batch=none")
    write = sinks.idempotent_batches(path)
    each = (lambda batch, number: write(batch, 0)) if mode == "complete" else write
    q = df.writeStream.option("checkpointLocation", _folder(t, "drained-state")).foreachBatch(each).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(path)


# --- folds over ordered samples ---------------------------------------------------
@P.add("win_ewma", "WITH l AS (SELECT user_id, list(CAST(floor(value * 10) AS DOUBLE) ORDER BY event_id) AS v FROM events GROUP BY user_id) SELECT user_id, list_reduce(v, lambda a, x: round_even(0.2 * x + 0.8 * a, 0)) AS ewma FROM l")
def _(t):
    from lakeleaf.operators.windows import ewma

    return ewma(t.events.withColumn("latency", F.floor(F.col("value") * 10)), "user_id", "event_id", "latency")


def _samples(t, engine="user_id"):
    e = t.events
    return e.select(F.col(engine).cast("string").alias("engine"), F.col("event_id").alias("seq"), (F.unix_millis(F.col("ts").cast("timestamp"))).cast("double").alias("ts_ms"), F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")).alias("host"), F.floor(F.col("value") * 10).cast("double").alias("latency_ms"), F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 404).otherwise(200).alias("status"), F.when(F.col("event_type") == "error", 5000.0).alias("retry_after_ms"), F.lit(0.5).alias("chance"))


@P.add("win_warmup_median", "WITH r AS (SELECT user_id, CAST(floor(value * 10) AS DOUBLE) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type NOT IN ('error', 'signup')), w AS (SELECT user_id, list_sort(list(x)) AS v FROM r WHERE k <= 10 GROUP BY user_id HAVING count(*) = 10) SELECT CAST(user_id AS VARCHAR) AS engine, v[6] AS baseline FROM w")
def _(t):
    rows = S.simulated(_samples(t).where("status = 200"))
    return rows.where("baseline is not null").groupBy("engine").agg(F.min_by("baseline", "seq").alias("baseline"))


@P.add("state_circuit")
def _(t):
    last = S.simulated(_samples(t)).groupBy("engine").agg(F.max_by(F.struct("circuit", "errors"), "seq").alias("s"))
    return last.select("engine", "s.circuit", "s.errors")


@P.add("state_backoff")
def _(t):
    return S.simulated(_samples(t)).groupBy("engine").agg(F.max("backoff").alias("most"), F.min("backoff").alias("least"))


@P.add("state_telemetry")
def _(t):
    last = S.simulated(_samples(t)).groupBy("engine").agg(F.max_by(F.struct("circuit", "errors", "ewma", "baseline"), "seq").alias("s"))
    return last.select("engine", "s.circuit", "s.errors", F.coalesce("s.ewma", F.lit(0.0)).alias("ewma"), F.coalesce("s.baseline", F.lit(0.0)).alias("baseline"))


@P.add("state_token_bucket")
def _(t):
    """Tokens left after each request of a fixed pace, by the permission step: a fold over each engine's rows in order, which holds one batch and one state."""
    rows = _samples(t).select("engine", "seq", F.col("ts_ms").alias("at"), "host")
    return rows.repartition("engine").sortWithinPartitions("engine", "seq", "at", "host").mapInArrow(S.waits, "engine string, seq long, wait double")


@P.add("state_acquire")
def _(t):
    c = S.Config()

    @F.udf("struct<wait:double,state:string>", useArrow=True)
    def ask(host, at, delay):
        p, wait = S.permission(S.Pace(circuit="TRIPPED", tripped_ms=at - 10_000, errors=3), host, at, delay, c)
        return {"wait": wait, "state": p.circuit}

    return _samples(t).select("seq", ask("host", "ts_ms", F.lit(2000.0)).alias("a")).select("seq", "a.wait", "a.state")


@P.add("state_cooldown", "SELECT 'h' || (user_id % 5) AS host, CAST(max(epoch_us(ts) // 1000) + 5000 AS DOUBLE) AS wake FROM events WHERE event_type = 'error' GROUP BY 1")
def _(t):
    return S.host_cooldowns(_samples(t))


@P.add("state_jitter", "SELECT event_id, 1200 + CAST(floor((event_id % 128) / 128.0 * 2300) AS BIGINT) AS even, CAST(greatest(1200, least(3500, round_even(2350 + ((event_id % 17) - 8) * 0.5 * 2300 / 6, 0))) AS BIGINT) AS normal FROM events")
def _(t):
    even, normal = (F.col("event_id") % 128) / 128.0, (F.col("event_id") % 17 - 8) * 0.5
    return t.events.select("event_id", S.jitter(even, 1200, 3500).alias("even"), S.jitter(normal, 1200, 3500, normal=True).alias("normal"))


@P.add("state_export_restore", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'tokens' END AS problem FROM events")
def _(t):
    @F.udf("string", useArrow=True)
    def check(n):
        state = {"version": 1, "tokens": 99.0 if n % 2 == 0 else 1.0, "circuit": "NOMINAL", "backoff": 1200, "warmup": [], "baseline": None, "cooldowns": {}}
        return S.state_problem(state, S.Config())

    return t.events.select("event_id", check("event_id").alias("problem"))


@P.add("frontier_pacing_js", "SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0 AS paced FROM events GROUP BY user_id")
def _(t):
    rows = S.simulated(_samples(t)).groupBy("engine").agg(F.count_if(F.col("errors") > 0).alias("n"))
    return rows.select(F.col("engine").cast("long").alias("user_id"), (F.col("n") > 0).alias("paced"))


# --- journals ---------------------------------------------------------------------
def _journal(t):
    e = t.events
    once = e.select(F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("client"), "event_id", "props").withColumn("sequence", F.row_number().over(Window.partitionBy("client").orderBy("event_id")).cast("long"))
    first = once.select("client", "sequence", F.sha2("props", 256).alias("sha256"), F.col("event_id").alias("seen"))
    again = once.where("event_id % 10 = 0").select("client", "sequence", F.sha2("props", 256).alias("sha256"), (F.col("event_id") + 1_000_000_000).alias("seen"))
    other = once.where("event_id % 25 = 0").select("client", "sequence", F.lit("0" * 64).alias("sha256"), (F.col("event_id") + 2_000_000_000).alias("seen"))
    return first.unionByName(again).unionByName(other)


@P.add("stream_journal", "SELECT 'accepted' AS state, count(*) AS n FROM events UNION ALL SELECT 'retry', count(*) FROM events WHERE event_id % 10 = 0 UNION ALL SELECT 'conflict', count(*) FROM events WHERE event_id % 25 = 0")
def _(t):
    return J.accepted(_journal(t)).groupBy("state").agg(F.count("*").alias("n"))


@P.add("stream_journal_dedupe", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events)")
def _(t):
    """The same retries dropped in a stream."""
    e = _stream(t).select(F.col("user_id").cast("string").alias("client"), F.col("event_type").alias("sha256"), F.unix_micros(F.col("ts").cast("timestamp")).alias("sequence"), F.col("ts").cast("timestamp").alias("ts"))
    return _drained(t, J.deduplicated_stream(e.unionByName(e)).select("client"), "append").agg(F.count("*").alias("n"))


@P.add("win_journal_sequence", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sequence FROM events")
def _(t):
    return J.numbered(t.events, "user_id", ["ts", "event_id"]).select("event_id", "sequence")


@P.add("stream_recorder", "WITH k AS (SELECT user_id % 4 AS c, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS s FROM events), g AS (SELECT c, s, lag(s) OVER (PARTITION BY c ORDER BY s) AS p FROM k WHERE event_id % 9 <> 0) SELECT 'c' || c AS client, sum(s - p - 1)::BIGINT AS missing FROM g WHERE s - p > 1 GROUP BY c")
def _(t):
    e = t.events.select(F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("client"), "event_id")
    rows = J.numbered(e, "client", ["event_id"]).where("event_id % 9 <> 0")
    return J.gaps(rows).groupBy("client").agg(F.sum("missing").alias("missing"))


@P.add("journal_status", "SELECT 'c' || (user_id % 4) AS client, count(DISTINCT event_id // 2) AS events, max(event_id // 2) AS last, max(event_id // 2) - count(DISTINCT event_id // 2) AS missing FROM events GROUP BY 1")
def _(t):
    return J.status(t.events.select(F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("client"), F.floor(F.col("event_id") / 2).alias("sequence")))


@P.add("late_data_stream", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(event_type, {'t': ts, 'i': event_id}) AS head FROM events GROUP BY user_id")
def _(t):
    """URL heads kept by a stream over all rows, late ones too."""
    return _drained(t, J.heads(_stream(t), "user_id", "event_type", "ts", "event_id"), "complete")


@P.add("stream_pacing", "SELECT CAST(user_id AS VARCHAR) AS engine, max(event_id) AS seq FROM events GROUP BY user_id")
def _(t):
    """Pacing state of each engine, kept by a stateful stream."""
    s = Tables_like(t, _stream(t))
    return _drained(t, S.stream(_samples(s)), "update").groupBy("engine").agg(F.max("seq").alias("seq"))


class Tables_like:
    """Tables whose events are a stream."""

    def __init__(self, t, events):
        self.spark, self.sf_dir, self.events = t.spark, t.sf_dir, events


@P.add("ext_window_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    """An addition: counts by day."""
    e = _stream(t).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return _drained(t, J.windowed_counts(e, "ts", "1 day", keys=("event_type",)), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@P.add("ext_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS largest FROM n GROUP BY user_id")
def _(t):
    """An addition: sessions of a user."""
    e = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return J.sessions(e, "ts", "user_id", "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("largest"))


@P.add("idle_timeout", "WITH g AS (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS d FROM events) SELECT user_id, count(*) FILTER (d > 86400) AS stops FROM g GROUP BY user_id")
def _(t):
    return J.idle_stops(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 86400)


# --- checkpoints and segments -----------------------------------------------------
def _generations(t):
    e = t.events.select(F.col("user_id").cast("string").alias("archive_id"), "event_id")
    rows = e.withColumn("generation", F.row_number().over(Window.partitionBy("archive_id").orderBy("event_id")))
    return rows.select("archive_id", "event_id", "generation", F.when(F.col("event_id") % 20 == 0, 0).otherwise(F.col("generation") - 1).alias("expected"), (F.col("generation") * 10).alias("prefix_bytes"))


@P.add("stream_checkpoint", "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) SELECT count(*) FILTER (g = 1 OR event_id % 20 <> 0) AS valid, count(*) FILTER (g > 1 AND event_id % 20 = 0) AS invalid FROM r")
def _(t):
    return J.checkpoint_chain(_generations(t)).agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


@P.add("sink_usb_chunk", "SELECT 'appended' AS state, count(*) AS n FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT 'too_large', count(*) FROM events WHERE event_id % 7 = 0")
def _(t):
    e = t.events.select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("arrival"), F.when(F.col("event_id") % 7 == 0, 262145).otherwise(100 + F.col("event_id") % 50).alias("size"), F.sha2(F.col("event_id").cast("string"), 256).alias("sha256"))
    good = F.when(F.col("size") <= 262144, F.col("size")).otherwise(0)
    before = F.coalesce(F.sum(good).over(Window.partitionBy("stream").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return J.appended_chunks(e.withColumn("offset", before)).groupBy("state").agg(F.count("*").alias("n"))


@P.add("limit_discover_archives", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS archive_id FROM events ORDER BY 1 LIMIT 128")
def _(t):
    from lakeleaf.sources.files import discovered

    return discovered(t.events.select(F.col("user_id").cast("string").alias("archive_id")))


@P.add("refuse_finalized", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 97 = 0)")
def _(t):
    archives = t.events.select(F.col("user_id").alias("archive_id")).distinct()
    receipts = t.events.where("event_type = 'purchase' and event_id % 97 = 0").select(F.col("user_id").alias("archive_id"))
    return V.open_archives(archives, receipts).select(F.col("archive_id").alias("user_id"))


@P.add("validate_checkpoint_state", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'credential name' WHEN 1 THEN 'tokens' END AS problem FROM events")
def _(t):
    k = F.col("event_id") % 3
    state = F.when(k == 0, '{"a":[{"authToken":1}]}').when(k == 1, '{"tokens":-1}').otherwise('{"tokens":2.5,"queue":["x"]}')
    return t.events.select("event_id", V.checkpoint_state(state).alias("problem"))


@P.add("validate_checkpoint_metadata", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'last chunk' END AS problem FROM events")
def _(t):
    h = "0" * 64
    text = {}
    for k, offset in ((0, 5), (1, 6)):
        text[k] = json.dumps({"schema": "v1", "archive_id": "a", "generation": 1, "profile_hash": h, "state": {}, "prefixes": {"warc": {"bytes": 10, "sha256": h}, "cdx": {"bytes": 0, "sha256": h}}, "last_chunks": {"warc": {"offset": offset, "bytes": 4, "sha256": h}}})
    return t.events.select("event_id", V.checkpoint_metadata(F.when(F.col("event_id") % 2 == 0, text[0]).otherwise(text[1]), F.lit("a")).alias("problem"))


@P.add("stream_mirror_checkpoint", "SELECT event_id, event_id % 2 = 1 AS good FROM events")
def _(t):
    return t.events.select("event_id", (V.checkpoint_state(F.when(F.col("event_id") % 2 == 0, '{"cookie":1}').otherwise('{"segments":[{"sha256":"0"}]}')).isNull()).alias("good"))


@P.add("stream_frontier_checkpoint", "SELECT event_id, user_id % 3 <> 0 AS good FROM events")
def _(t):
    state = F.to_json(F.struct(F.array(F.struct(F.col("props").alias("url"), F.col("user_id").alias("depth"), F.when(F.col("user_id") % 3 == 0, "x").alias("password"))).alias("queue"), F.array("event_type").alias("visited")))
    return t.events.select("event_id", V.checkpoint_state(state).isNull().alias("good"))


@P.add("stream_reopen", "SELECT user_id, count(*) AS rows FROM events GROUP BY user_id")
def _(t):
    """Recovery without loss or repeats: the stream is stopped half-way and goes on from its checkpoint."""
    root = _folder(t, "reopen")
    for _ in range(2):
        q = _stream(t).writeStream.option("checkpointLocation", root + "/state").foreachBatch(sinks.idempotent_batches(root + "/out")).trigger(availableNow=True).start()
        q.awaitTermination()
    return t.spark.read.schema(t.events.schema).option("recursiveFileLookup", "true").parquet(root + "/out").groupBy("user_id").agg(F.count("*").alias("rows"))


@P.add("sink_atomic_segment", "SELECT event_type, count(*) AS rows FROM events GROUP BY event_type")
def _(t):
    path = _folder(t, "segment")
    t.events.write.partitionBy("event_type").parquet(path)
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("rows"))


@P.add("sink_finalize", "SELECT count(*) AS files, true AS intact FROM (SELECT DISTINCT source FROM documents WHERE text IS NOT NULL)")
def _(t):
    """After publishing, containers are scanned again and all digests hold."""
    rec = warc_files.parsed(_containers(t))
    return A.type_counts(rec).agg(F.count("*").alias("files"), F.min("passed").alias("intact"))


# --- containers ---------------------------------------------------------------------
def _resources(t):
    return t.documents.where("text is not null").select(F.concat("source", F.lit(".warc")).alias("file"), F.col("doc_id").alias("seq"), F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("url"), F.lit("2024-01-01T00:00:00Z").alias("ts"), F.lit(200).alias("status"), F.lit("text/plain").alias("mime"), F.create_map(F.lit("Content-Type"), F.lit("text/plain; charset=utf-8"), F.lit("Content-Encoding"), F.lit("gzip")).alias("headers"), F.col("text").cast("binary").alias("body"))


def _containers(t):
    """(path, part, content): containers by the records that a writer appends to them, in the order of ``part``."""
    return sinks.container_rows(_resources(t)).select(F.col("file").alias("path"), F.col("seq").alias("part"), F.col("data").alias("content"))


_WARC = "WITH r AS (SELECT doc_id, source, octet_length(encode(text)) AS size, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL)"


@P.add("sink_warc", _WARC + " SELECT source || '.warc' AS file, count(*) AS records, count(*) FILTER (doc_id > first AND size > 512) AS revisits FROM r GROUP BY source")
def _(t):
    return sinks.container_rows(_resources(t)).groupBy("file").agg(F.count("*").alias("records"), F.count_if("is_revisit").alias("revisits"))


@P.add("sink_warc_js", _WARC + " SELECT count(*) AS records, 0 AS revisits FROM r")
def _(t):
    return sinks.container_rows(_resources(t), dedup=False).agg(F.count("*").alias("records"), F.count_if("is_revisit").cast("int").alias("revisits"))


@P.add("scan_warc", _WARC + " SELECT source || '.warc' AS file, count(*) AS records, count(*) FILTER (doc_id > first AND size > 512) AS revisit FROM r GROUP BY source")
def _(t):
    return warc_files.parsed(_containers(t)).groupBy("file").agg(F.count("*").alias("records"), F.count_if(F.col("type") == "revisit").alias("revisit"))


@P.add("scan_container", "SELECT count(*) AS bad FROM documents WHERE false")
def _(t):
    packed = warc_files.zipped(_containers(t))
    return warc_files.parsed(packed).where("error is not null").agg(F.count("*").alias("bad"))


def _folder(t, name: str) -> str:
    return shared_folder(t.spark, name)


@P.add("scan_jsonl_events", "SELECT event_type AS stage, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    path = _folder(t, "jsonl")
    t.events.select(F.lit("request").alias("event"), F.col("event_type").alias("stage"), F.col("value").alias("latency_ms")).write.json(path)
    stream = files.events(t.spark, path, stream=True)
    return _drained(t, stream.groupBy("stage").agg(F.count("*").alias("n")), "complete")


@P.add("scan_profiles", "SELECT r_name AS profile_id FROM region")
def _(t):
    path = _folder(t, "profiles")
    t.region.select(F.col("r_name").alias("profile_id"), F.lit("x").alias("name")).repartitionByRange(64, "profile_id").write.option("maxRecordsPerFile", 1).json(path)
    return files.profiles(t.spark, path).select("profile_id")


@P.add("scan_discover_inputs", "SELECT count(*) AS inputs FROM region WHERE false")
def _(t):
    path = _folder(t, "inputs")
    t.region.select(F.col("r_name").alias("value")).write.text(path)
    return warc_files.inputs(t.spark, path).agg(F.count("*").alias("inputs"))


@P.add("sink_ledger_atomic", "SELECT event_type, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids, max(props) AS last FROM events GROUP BY event_type")
def _(t):
    path = _folder(t, "ledger")
    for _ in range(2):
        t.events.write.mode("overwrite").parquet(path)
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"), F.max("props").alias("last"))


@P.add("sink_export_zip", "SELECT count(*) AS members FROM customer")
def _(t):
    import os
    import tempfile

    rows = t.customer.select(F.concat(F.lit("https://e.example/c/"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_name").cast("binary").alias("payload"))
    with tempfile.TemporaryDirectory() as folder:  # a driver-side file format
        n = sinks.export_zip(rows, os.path.join(folder, "x.zip"))
    return t.spark.createDataFrame([(n,)], "members long")


@P.add("rpc_dispatch", "SELECT unnest([-32700, -32600, -32601, -32601, -32602]) AS code")
def _(t):
    from lakeleaf.engine import Engine, dispatch

    e = Engine(t.spark)
    lines = ["{", "[]", '{"jsonrpc":"2.0","id":1,"method":"nope"}', '{"jsonrpc":"2.0","id":2,"method":"tools/call","params":{"name":"x"}}', '{"jsonrpc":"2.0","id":3,"method":"tools/call","params":{"name":"search_archive","arguments":{}}}']
    return t.spark.createDataFrame([(json.loads(dispatch(e, x))["error"]["code"],) for x in lines], "code int")


@P.add("api_rpc", "SELECT unnest(['list_profiles', 'search_archive', 'validate_profile']) AS tool")
def _(t):
    from lakeleaf.engine import Engine, dispatch

    answer = json.loads(dispatch(Engine(t.spark), '{"jsonrpc":"2.0","id":1,"method":"tools/list"}'))
    return t.spark.createDataFrame([(x["name"],) for x in answer["result"]["tools"]], "tool string")


@P.add("job_schedule", "SELECT event_id, ts + INTERVAL 60 SECOND AS next FROM events")
def _(t):
    from lakeleaf.engine import schedule

    return t.events.select("event_id", schedule("ts", 60).alias("next"))


@P.add("global_rank", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS rank FROM lineitem")
def _(t):
    rows = W.global_rank(t.lineitem, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("rank").cast("long").alias("rank"))


QUERIES, ORACLE_SQL = P.queries, P.sql
