"""Row predicates and argument checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions.names import trim_all
from usagelens.functions.times import local_range_start


def parse_range_days(text: str | None) -> int:
    """Day-range argument: blank or invalid gives 30, 0 is all history, at most 3650."""
    if text is None or not text.strip():
        return 30
    try:
        value = float(text)
    except ValueError:
        return 30
    if value != value or value in (float("inf"), float("-inf")) or value < 0 or value % 1:
        return 30
    return int(min(3650, value))


def range_days(c: Column) -> Column:
    """Column twin of :func:`parse_range_days`."""
    value = trim_all(c).try_cast("double")
    usable = value.isNotNull() & (value >= 0) & (value == F.floor(value)) & (value < 1e15)
    return F.when(usable, F.least(value, F.lit(3650.0))).otherwise(F.lit(30.0)).cast("int")


def parse_device(value: str | None = "all") -> str | None:
    """A known device or ``all``; anything else gives null."""
    value = "all" if value is None else value
    return value if value == "all" or value in fixed.DEVICES else None


def valid_session_id(c: Column) -> Column:
    return F.coalesce(c.rlike(fixed.SESSION_ID_PATTERN), F.lit(False))


def in_range(events: DataFrame, days: int, now_ms: int, tz: str = "UTC") -> DataFrame:
    """Rows of the last ``days`` civil days; reports have no upper bound."""
    return since(events, local_range_start(days, now_ms, tz))


def since(events: DataFrame, start_ms: int) -> DataFrame:
    """Rows from an instant on; prunes the ``day`` partitions of stored tables."""
    out = events.filter(F.col("ts_ms") >= start_ms)
    if "day" in events.columns:
        # day partitions are UTC days
        first = F.date_from_unix_date(F.lit(start_ms // fixed.DAY_MS).cast("int"))
        out = out.filter(F.col("day") >= first)
    return out


def utc_window(events: DataFrame, start_ms: int, now_ms: int) -> DataFrame:
    """Rows between two instants, both included; rows in the future are left out."""
    out = events.filter(F.col("ts_ms").between(start_ms, now_ms))
    if "day" in events.columns:
        out = out.filter(
            F.col("day").between(
                F.date_from_unix_date(F.lit(start_ms // fixed.DAY_MS).cast("int")),
                F.date_from_unix_date(F.lit(now_ms // fixed.DAY_MS).cast("int")),
            )
        )
    return out


def scope_device(frames: dict[str, DataFrame], device: str | None) -> dict[str, DataFrame]:
    """Restrict usage tables to one device; account-wide tables pass through untouched."""
    chosen = parse_device(device)
    if chosen is None:
        raise ValueError(f"invalid device: {device!r}")
    if chosen == "all":
        return dict(frames)
    scoped = {"events", "tool_calls", "credit_usage", "files"}
    return {
        name: df.filter(F.col("device") == chosen) if name in scoped else df
        for name, df in frames.items()
    }


def model_prefix(model: Column, prefix: Column | str) -> Column:
    """Direct-account models of a provider: the bare prefix or ``prefix-...``."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.coalesce((model == p) | model.startswith(F.concat(p, F.lit("-"))), F.lit(False))


def model_prefix_loose(model: Column, prefix: Column | str) -> Column:
    """Case-insensitive plain prefix, as used by subscription filters."""
    p = F.lower(F.lit(prefix) if isinstance(prefix, str) else prefix)
    return F.lower(F.coalesce(model, F.lit(""))).startswith(p)


def safe_count(c: Column) -> Column:
    """Non-negative integer that survives a double round trip."""
    return F.coalesce(c.between(0, fixed.MAX_SAFE_INTEGER), F.lit(False))


def is_long_context(events_tool: Column, fresh: Column, cached: Column, write: Column) -> Column:
    """Request reached the long-context price tier; summed sources cannot tell."""
    return F.when(events_tool.isin(fixed.LONG_CONTEXT_EXEMPT_TOOLS), F.lit(False)).otherwise(
        fresh + cached + write >= fixed.LONG_CONTEXT_TOKENS
    )
