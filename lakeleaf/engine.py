"""The façade: one object over a session, and the small JSON-RPC surface for tools."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeleaf.operators import archive, extract, reports, retrieval, rules
from lakeleaf.sources import files, warc_files

# Preservation modes and RPC error codes.
MODES = {
    "preservation": "archive every response as it was served",
    "offline_reading": "keep what a reader needs without a network",
    "rendered_optional": "also keep a rendered derivative where a browser is available",
}
PARSE, REQUEST, METHOD, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def records(self, path: str) -> DataFrame:
        return warc_files.scan(self.spark, path)

    def verify(self, path: str) -> DataFrame:
        return archive.type_counts(self.records(path))

    def search_index(self, query: str, path: str) -> DataFrame:
        return archive.searched_cdx(files.cdx(self.spark, path), query)

    def search(self, docs: DataFrame, query: str, embedding=None, store=None, limit: int = 10) -> DataFrame:
        return retrieval.hybrid(docs, query, embedding, store, limit)

    def preview(self, resources: DataFrame, config: dict, hosts: list[str]) -> DataFrame:
        return rules.preview(resources, config, hosts)

    def report(self, outcomes: DataFrame) -> DataFrame:
        return reports.reconciled(outcomes)

    def profiles(self, path: str) -> DataFrame:
        return files.profiles(self.spark, path)


def observed(df: DataFrame, callback, **metrics):
    """``df`` with metrics (name: aggregate) that are computed as its action runs; calling the second value then hands them to ``callback``."""
    from pyspark.sql import Observation

    watch = Observation()
    return df.observe(watch, *[m.alias(n) for n, m in metrics.items()]), lambda: callback(watch.get)


TOOLS = {
    "list_profiles": {"path"},
    "search_archive": {"query", "path"},
    "validate_profile": {"profile", "schema"},
}


def call(engine: Engine, name: str, args: dict):
    if name not in TOOLS:
        raise LookupError(name)
    if not isinstance(args, dict) or not TOOLS[name] <= set(args):
        raise TypeError(f"{name} needs {sorted(TOOLS[name])}")
    if name == "list_profiles":
        return [r.asDict(True) for r in engine.profiles(args["path"]).select("profile_id", "name").orderBy("profile_id").toLocalIterator()]
    if name == "search_archive":
        hits = engine.search_index(args["query"], args["path"])
        rows = hits.select("url", "mime", "status", "ts").orderBy("url", "ts").limit(int(args.get("limit", 100))).collect()
        return {"total": hits.count(), "results": [r.asDict() for r in rows]}
    error = extract.schema_error(args["profile"], args["schema"])
    return {"valid": error is None, "error": error}


def dispatch(engine: Engine, line: str) -> str | None:
    """Answer one JSON-RPC line; notifications have no answer."""

    def answer(number, **body):
        return json.dumps({"jsonrpc": "2.0", "id": number, **body}, default=str)

    try:
        message = json.loads(line)
    except ValueError:
        return answer(None, error={"code": PARSE, "message": "Parse error"})
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
        return answer(message.get("id") if isinstance(message, dict) else None, error={"code": REQUEST, "message": "Invalid Request"})
    number, method, params = message.get("id"), message["method"], message.get("params") or {}
    if "id" not in message:
        return None
    try:
        if method == "initialize":
            return answer(number, result={"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "lakeleaf", "version": "1"}})
        if method == "tools/list":
            return answer(number, result={"tools": [{"name": n, "inputSchema": {"type": "object", "required": sorted(r)}} for n, r in TOOLS.items()]})
        if method == "tools/call":
            found = call(engine, params.get("name"), params.get("arguments", {}))
            return answer(number, result={"content": [{"type": "text", "text": json.dumps(found, default=str)}]})
        return answer(number, error={"code": METHOD, "message": "Method not found"})
    except LookupError:
        return answer(number, error={"code": METHOD, "message": "Unknown tool"})
    except (TypeError, ValueError) as why:
        return answer(number, error={"code": PARAMS, "message": str(why)})
    except Exception:  # noqa: BLE001  the caller gets a code, never a trace
        return answer(number, error={"code": INTERNAL, "message": "Internal error"})


def schedule(engine_columns: str, every_seconds: int):
    """Start times of an opt-in schedule column, at least a minute apart."""
    if every_seconds < 60:
        raise ValueError("a schedule needs 60 seconds or more")
    return F.col(engine_columns) + F.expr(f"INTERVAL {int(every_seconds)} SECONDS")
