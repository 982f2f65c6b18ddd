"""Registry of runnable queries and the SQL each must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from usagelens.plans.views import SQL_VIEWS

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a SELECT with the view definitions it mentions, directly or through others."""
    views = {**SQL_VIEWS, **(extra or {})}
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name, definition in views.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(definition)
    if not needed:
        return body.strip()
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    body = body.replace("RECURSIVE", "")
    parts = [f"{name} AS ({text.strip()})" for name, text in views.items() if name in needed]
    stripped = body.strip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {recursive}" + ",\n".join(parts) + ",\n" + stripped[5:]
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + stripped


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register a query; ``sql`` is a DuckDB SELECT over the same tables."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, views)
        return fn

    return wrap
