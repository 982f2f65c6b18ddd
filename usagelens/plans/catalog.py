"""All registered queries."""

from __future__ import annotations

from usagelens.plans import (  # noqa: F401 - importing registers the queries
    board_queries,
    cost_queries,
    dedup_queries,
    function_queries,
    source_queries,
    stream_queries,
    usage_queries,
)
from usagelens.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
