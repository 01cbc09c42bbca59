"""Ordered capture rules compiled to column expressions.

Every matcher is a three-valued predicate over the resource's columns; a rule's match is their conjunction, in
which FALSE wins over NULL. The first rule that is not FALSE decides: TRUE applies its decision, NULL (it needs
a column that is not known yet) holds the download. The compiled list is one CASE per output column.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeleaf.functions import http, urls

MOST_RULES, MOST_TEXT = 100, 2048
TEXTS = ("url_prefix", "path_prefix", "host", "mime", "kind")
BOUNDS = ("min_depth", "max_depth", "min_bytes", "max_bytes")
ACTIONS = ("discover", "download", "traverse")
KINDS = ("page", "asset", "sitemap")


class RuleError(ValueError):
    pass


def _check_matcher(key: str, value) -> None:
    if key in BOUNDS:
        if type(value) is not int or not 0 <= value <= http.SAFE_INTEGER:
            raise RuleError(f"{key}: not a safe count")
        return
    if not isinstance(value, str) or not 0 < len(value) <= MOST_TEXT or any(c < " " for c in value):
        raise RuleError(f"{key}: bad text")
    shapes = {
        "kind": lambda: value in KINDS,
        "host": lambda: re.fullmatch(r"[a-z0-9]+([.-][a-z0-9]+)*", value),
        "path_prefix": lambda: value.startswith("/"),
        "url_prefix": lambda: re.match(r"https?://[^/?#@]+([/?#]|$)", value),
    }
    if key in shapes and not shapes[key]():
        raise RuleError(f"{key}: bad value {value!r}")


def validated(config: dict) -> list[dict]:
    """The rules of a version 1 configuration, or RuleError."""
    if not isinstance(config, dict) or sorted(config) != ["rules", "version"] or type(config["version"]) is not int or config["version"] != 1:
        raise RuleError("expected version 1 with rules")
    rules = config["rules"]
    if not isinstance(rules, list) or len(rules) > MOST_RULES:
        raise RuleError(f"expected at most {MOST_RULES} rules")
    names = set()
    for rule in rules:
        if not isinstance(rule, dict) or sorted(rule) != ["decision", "id", "match"]:
            raise RuleError("a rule has id, match and decision")
        name, match, decision = rule["id"], rule["match"], rule["decision"]
        if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", name) or name in names:
            raise RuleError(f"bad or repeated id {name!r}")
        names.add(name)
        if not isinstance(match, dict) or set(match) - {*TEXTS, *BOUNDS}:
            raise RuleError(f"{name}: unknown matcher")
        if not isinstance(decision, dict) or not decision or set(decision) - set(ACTIONS) or any(type(v) is not bool for v in decision.values()):
            raise RuleError(f"{name}: decisions are true or false actions")
        for key, value in match.items():
            _check_matcher(key, value)
        for unit in ("depth", "bytes"):
            if match.get(f"min_{unit}", 0) > match.get(f"max_{unit}", http.SAFE_INTEGER):
                raise RuleError(f"{name}: reversed interval of {unit}")
    return rules


def _predicate(key: str, value, at: dict[str, Column]) -> Column:
    match key:
        case "url_prefix":
            return F.startswith(at["url"], F.lit(value))
        case "path_prefix":
            return F.startswith(at["path"], F.lit(value))
        case "host" | "kind":
            return at[key] == value
        case "mime":
            return at["mime"] == value.lower()
        case _:
            side, unit = key.split("_")
            return at[unit] >= value if side == "min" else at[unit] <= value


def decision(config: dict, in_scope: Column, *, url="url", kind="kind", depth="depth", mime="mime", size="bytes") -> Column:
    """struct<discover, download, traverse, rule_id, state, missing> of each row's resource."""
    rules = validated(config)
    p = urls.parts(url)
    at = {
        "url": F.col(url),
        "host": p["host"],
        "path": F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]),
        "kind": F.col(kind),
        "mime": http.mime(F.col(mime)),
        "depth": F.col(depth),
        "bytes": F.col(size),
    }
    field = {"min_depth": "depth", "max_depth": "depth", "min_bytes": "bytes", "max_bytes": "bytes", "mime": "mime"}
    none = F.array().cast("array<string>")

    def outcome(scope, discover, download, traverse, name, state, missing) -> Column:
        download = discover & download
        return F.struct(discover.alias("discover"), download.alias("download"), (download & traverse).alias("traverse"), name.alias("rule_id"), F.lit(state).alias("state"), missing.alias("missing"))

    yes = F.lit(True)
    default = outcome(None, yes, yes, yes, F.lit(None).cast("string"), "decided", none)
    closed = outcome(None, ~yes, ~yes, ~yes, F.lit(None).cast("string"), "out_of_scope", none)
    chain = F.when(~in_scope, closed)
    for rule in rules:
        tests = [_predicate(k, v, at) for k, v in rule["match"].items()]
        match = reduce(lambda a, b: a & b, tests, yes)
        acts = {a: F.lit(rule["decision"].get(a, True)) for a in ACTIONS}
        needed = sorted({field[k] for k in rule["match"] if k in field})
        missing = F.array_compact(F.array(*[F.when(at[f].isNull(), F.lit(f)) for f in needed])) if needed else none
        held = outcome(None, yes, ~yes, ~yes, F.lit(rule["id"]), "needs_metadata", missing.cast("array<string>"))
        chain = chain.when(match, outcome(None, acts["discover"], acts["download"], acts["traverse"], F.lit(rule["id"]), "decided", none)).when(match.isNull(), held)
    return chain.otherwise(default)


def preview(resources: DataFrame, config: dict, allowed_hosts: list[str]) -> DataFrame:
    """``resources`` (url, kind, depth, mime, bytes, any others) with ``decision``; nothing is fetched and no row is lost."""
    hosts = urls.scope_hosts(allowed_hosts)
    bad = ~urls.is_http_identity("url") | ~F.col("kind").isin(*KINDS)
    return resources.withColumn("decision", F.when(bad, F.raise_error(F.lit("bad preview resource")).cast("struct<discover:boolean,download:boolean,traverse:boolean,rule_id:string,state:string,missing:array<string>>")).otherwise(decision(config, urls.in_scope("url", hosts))))
