"""Sources that are table extracts: zcode, opencode, hermes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions import variants as V
from usagelens.functions.names import basename, normalize_model
from usagelens.sources.lines import CALL_FIELDS, as_rows, used, with_total


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long")


def _with_directory(rows: DataFrame, sessions: DataFrame, column: str = "directory") -> DataFrame:
    """Project name from the session table; the planner broadcasts it when it is small."""
    folders = sessions.select(
        F.col("id").alias("session_id"), basename(F.nullif(F.col(column), F.lit(""))).alias("project")
    )
    return rows.join(folders, "session_id", "left")


def norm_zcode(model_usage: DataFrame, sessions: DataFrame) -> DataFrame:
    """Model usage rows; the input counter contains cache reads."""
    cached = F.least(_count("cache_read_input_tokens"), _count("input_tokens"))
    shaped = model_usage.filter(F.col("started_at").isNotNull()).select(
        F.concat(F.lit("zcode:"), F.col("id").cast("string")).alias("dedup_key"),
        F.col("started_at").cast("long").alias("ts_ms"),
        F.lit("zcode").alias("tool"),
        normalize_model(F.col("model_id")).alias("model"),
        "session_id",
        (_count("input_tokens") - cached).alias("input_tokens"),
        cached.alias("cached_input"),
        _count("cache_creation_input_tokens").alias("cache_write"),
        _count("output_tokens").alias("output_tokens"),
        _count("reasoning_tokens").alias("reasoning_tokens"),
    )
    return as_rows(_with_directory(used(with_total(shaped)), sessions))


def zcode_tool_calls(tool_usage: DataFrame) -> DataFrame:
    """Tool usage rows, keyed by row id (``rid``)."""
    valid = F.col("started_at").isNotNull() & (F.col("tool_name") != "")
    return tool_usage.filter(valid).select(
        F.concat(F.lit("zcode:tc:"), F.col("rid").cast("string")).alias("dedup_key"),
        F.col("started_at").cast("long").alias("ts_ms"),
        F.lit("zcode").alias("tool"),
        F.col("tool_name").alias("name"),
        "session_id",
    )


def norm_opencode(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Assistant messages with a token object in their JSON column; others are skipped."""
    d = F.col("d")
    stamp = F.coalesce(F.nullif(V.number(d, "$.time.created"), F.lit(0.0)).cast("long"), "time_created")
    rows = messages.select("*", V.once(V.parse(F.col("data"))).alias("d")).filter(
        V.is_object(d, "$.tokens") & (V.text(d, "$.role") == "assistant")
    )
    shaped = rows.select(
        F.concat(F.lit("opencode:"), "id").alias("dedup_key"),
        stamp.alias("ts_ms"),
        F.lit("opencode").alias("tool"),
        normalize_model(V.text(d, "$.modelID")).alias("model"),
        "session_id",
        V.count(d, "$.tokens.input").alias("input_tokens"),
        V.count(d, "$.tokens.cache.read").alias("cached_input"),
        V.count(d, "$.tokens.cache.write").alias("cache_write"),
        V.count(d, "$.tokens.output").alias("output_tokens"),
        V.count(d, "$.tokens.reasoning").alias("reasoning_tokens"),
    ).filter(F.col("ts_ms") != 0)
    return as_rows(_with_directory(used(with_total(shaped)), sessions))


def opencode_tool_calls(parts: DataFrame) -> DataFrame:
    """Tool parts; other parts carry whole tool outputs and are filtered by text first."""
    d = F.col("d")
    rows = (
        parts.filter(F.col("data").contains('"tool"'))
        .select("*", V.once(V.parse(F.col("data"))).alias("d"))
        .filter((V.text(d, "$.type") == "tool") & V.text(d, "$.tool").isNotNull())
    )
    stamp = F.coalesce(F.nullif(V.number(d, "$.state.time.start"), F.lit(0.0)).cast("long"), "time_created")
    return rows.select(
        F.concat(F.lit("opencode:tc:"), F.coalesce(V.text(d, "$.callID"), "id")).alias("dedup_key"),
        stamp.alias("ts_ms"),
        F.lit("opencode").alias("tool"),
        V.text(d, "$.tool").alias("name"),
        "session_id",
    ).filter(F.col("ts_ms") != 0)


_IDENTITY = ["session_id", "model", "billing_provider", "task", "billing_mode", "billing_base_url"]


def hermes_key() -> Column:
    """Stable key of an aggregate: a short digest of its identity fields."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _IDENTITY]
    return F.concat(F.lit("hermes:smu:"), F.substring(F.sha1(F.concat_ws("\0", *parts)), 1, 20))


def norm_hermes(usage: DataFrame, sessions: DataFrame) -> DataFrame:
    """Cumulative counters per aggregate; ``cumulative_to_daily`` turns them into usage."""
    shaped = usage.select(
        hermes_key().alias("dedup_key"),
        F.floor(F.col("last_seen") * 1000 + 0.5).cast("long").alias("ts_ms"),
        F.lit("hermes").alias("tool"),
        normalize_model(F.col("model")).alias("model"),
        "session_id",
        _count("input_tokens").alias("input_tokens"),
        _count("cache_read_tokens").alias("cached_input"),
        _count("cache_write_tokens").alias("cache_write"),
        _count("output_tokens").alias("output_tokens"),
        _count("reasoning_tokens").alias("reasoning_tokens"),
        *([F.col("ord")] if "ord" in usage.columns else []),
    )
    out = _with_directory(used(with_total(shaped)), sessions, "cwd")
    return as_rows(out, extra=["ord"] if "ord" in usage.columns else None)


def hermes_tool_calls(messages: DataFrame) -> DataFrame:
    stamp = F.floor(F.col("timestamp") * 1000 + 0.5).cast("long")
    return messages.filter((F.col("tool_name") != "") & (stamp != 0)).select(
        F.concat(F.lit("hermes:tc:"), F.col("id").cast("string")).alias("dedup_key"),
        stamp.alias("ts_ms"),
        F.lit("hermes").alias("tool"),
        F.col("tool_name").alias("name"),
        "session_id",
    ).select(*CALL_FIELDS)
