"""All queries on the supplied tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES: tuple[str, ...] = ("retrieval_plans", "url_plans", "catalogue_plans", "report_plans", "streaming_plans")


def _modules():
    return [importlib.import_module(f"lakeleaf.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE_SQL.items()}
