"""Assistant transcripts: events, tool calls and request latency (tools claude-code and ccmr)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions import variants as V
from usagelens.functions.names import basename, normalize_model
from usagelens.functions.times import parse_iso_millis
from usagelens.operators.joins import asof_last
from usagelens.sources.files import is_cowork_usage_path
from usagelens.sources.lines import CALL_FIELDS, as_rows, stem

_COUNTS = {
    "input_tokens": "input_tokens",
    "cached_input": "cache_read_input_tokens",
    "cache_write": "cache_creation_input_tokens",
    "output_tokens": "output_tokens",
}


#: fields read from a transcript line; counters and the id stay variants for the strict checks
_SCHEMA = """
    type string, timestamp string, _audit_timestamp string, sessionId string, session_id string,
    cwd string, requestId string, requestRef string,
    message struct<id: variant, model: string, content: array<struct<type: string, id: string, name: string>>,
      usage: struct<input_tokens: variant, cache_read_input_tokens: variant,
        cache_creation_input_tokens: variant, output_tokens: variant,
        output_tokens_details: struct<thinking_tokens: variant>>>
"""


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _replies(lines: DataFrame, tool: str) -> DataFrame:
    """Valid assistant rows with all event fields, content blocks and the request reference.

    Each line is converted once, to the few fields above.
    """
    strict = tool == "claude-code"
    wanted = F.col("value").contains('"usage"') & F.col("value").rlike(r'"type"\s*:\s*"assistant"')
    rows = lines.filter(wanted).select(
        "path", "block", "pos", V.once(F.from_json("value", _SCHEMA)).alias("v")
    )
    usage = "v.message.usage"
    audit = F.lit(False)
    if strict:
        # the cheap suffix test spares the layout patterns on ordinary files
        in_audit_file = F.col("path").endswith("audit.jsonl") & is_cowork_usage_path(F.col("path"))
        audit = F.col("v._audit_timestamp").isNotNull() | in_audit_file
    message_id = F.try_variant_get("v.message.id", "$", "string")
    valid = (F.col("v.type") == "assistant") & F.col(usage).isNotNull() & (message_id != "")
    # each counter is checked once per row; null means absent, -1 present but unusable
    raw_counts = {name: F.col(f"{usage}.{field}") for name, field in _COUNTS.items()}
    raw_counts["thinking"] = F.col(f"{usage}.output_tokens_details.thinking_tokens")
    if strict:
        checked = {
            n: F.when(raw.isNotNull(), F.coalesce(V.safe_int(raw, "$"), F.lit(-1)))
            for n, raw in raw_counts.items()
        }
    else:
        checked = {n: V.count(raw, "$") for n, raw in raw_counts.items()}
    rows = rows.select("*", V.once(F.struct(*[c.alias(n) for n, c in checked.items()])).alias("c"))
    if strict:
        lowest = F.least(*[F.col(f"c.{n}") for n in _COUNTS])
        # null only when all counters are absent
        valid = valid & F.coalesce(lowest >= 0, F.lit(False))
    counters = {n: F.coalesce(F.col(f"c.{n}"), F.lit(0)) for n in _COUNTS}
    thinking = F.coalesce(F.col("c.thinking"), F.lit(0))
    if strict:
        thinking = F.greatest(thinking, F.lit(0))
    session = F.coalesce(_filled(F.col("v.sessionId")), _filled(F.col("v.session_id")))
    if strict:
        has_session = (F.col("v.sessionId") != "") | (F.col("v.session_id") != "")
        is_text = V.is_string(F.col("v.message.id"), "$")
        named = ~audit | F.coalesce(has_session, F.lit(False))
        valid = valid & is_text & ~message_id.contains(":") & named
    raw_model = F.col("v.message.model")
    key = (
        F.concat(F.lit(f"{tool}:message:"), message_id)
        if strict
        else F.concat(F.lit(f"{tool}:"), message_id, F.lit(":"), F.coalesce("v.requestId", F.lit("")))
    )
    stamp = F.coalesce(_filled(F.col("v.timestamp")), F.when(audit, F.col("v._audit_timestamp")))
    shaped = rows.filter(valid & (raw_model != "") & (raw_model != "<synthetic>")).select(
        "path",
        "block",
        "pos",
        F.lit(tool).alias("tool"),
        key.alias("dedup_key"),
        message_id.alias("message_id"),
        parse_iso_millis(stamp).alias("ts_ms"),
        normalize_model(raw_model).alias("model"),
        F.coalesce(session, stem()).alias("session_id"),
        basename(_filled(F.col("v.cwd"))).alias("project"),
        *[c.alias(n) for n, c in counters.items()],
        thinking.alias("reasoning_tokens"),
        (F.when(audit, 1).otherwise(2) if strict else F.lit(0)).alias("usage_quality"),
        F.col("v.requestRef").alias("ref"),
        F.col("v.message.content").alias("content"),
    )
    total = F.col("input_tokens") + F.col("cached_input") + F.col("cache_write") + F.col("output_tokens")
    shaped = shaped.withColumn("total_tokens", total).filter(F.col("ts_ms").isNotNull())
    return shaped.filter(total <= fixed.MAX_SAFE_INTEGER) if strict else shaped


def norm_claude(lines: DataFrame, tool: str = "claude-code") -> DataFrame:
    """Usage events of assistant messages; one row per written block, deduplicated later."""
    return as_rows(_replies(lines, tool))


def claude_tool_calls(lines: DataFrame, tool: str = "claude-code") -> DataFrame:
    """Tool-use blocks of assistant messages."""
    blocks = _replies(lines, tool).select(
        "*", F.posexplode("content").alias("i", "b")
    )
    fallback = F.concat(F.col("message_id"), F.lit(":"), F.col("i").cast("string"))
    return (
        blocks.filter((F.col("b.type") == "tool_use") & (F.col("b.name") != ""))
        .withColumn("name", F.col("b.name"))
        .withColumn(
            "dedup_key", F.concat(F.lit(f"{tool}:tc:"), F.coalesce(_filled(F.col("b.id")), fallback))
        )
        .select(*CALL_FIELDS, "path", "block", "pos")
    )


def request_starts(lines: DataFrame) -> DataFrame:
    """Requests as (path, ref, sent_ms), by text: these lines are long and need no parsing."""
    head = F.col("value")
    rows = lines.filter(F.col("value").startswith('{"type":"api-request"')).select(
        "path",
        "block",
        "pos",
        F.regexp_extract(head, r'"id":"([^"]+)"', 1).alias("ref"),
        parse_iso_millis(
            F.nullif(F.regexp_extract(head, r'"timestamp":"([^"]+)"', 1), F.lit(""))
        ).alias("sent_ms"),
    )
    return rows.filter((F.col("ref") != "") & F.col("sent_ms").isNotNull())


def pair_request_latency(lines: DataFrame, tool: str = "claude-code") -> DataFrame:
    """Longest wait per event between its request and a written block, at most 15 minutes.

    A reference names the latest request of that id written before the reply.
    """
    place = ["path", "ref", "block", "pos"]
    replies = _replies(lines, tool).filter(F.col("ref").isNotNull()).select(
        *place, "dedup_key", "ts_ms", F.lit(None).cast("long").alias("sent")
    )
    sends = request_starts(lines).select(
        *place, F.lit(None).cast("string").alias("dedup_key"), F.lit(None).cast("long").alias("ts_ms"), F.col("sent_ms").alias("sent")
    )
    # the running last send: no pair of sends and replies is built
    latest = asof_last(replies.unionByName(sends), "sent", ["path", "ref"], "block", ["block", "pos"], "sent_ms")
    latest = latest.filter(F.col("dedup_key").isNotNull())
    wait = F.col("ts_ms") - F.col("sent_ms")
    return (
        latest.withColumn("duration_ms", wait)
        .filter((F.col("duration_ms") > 0) & (F.col("duration_ms") <= fixed.MAX_DURATION_MS))
        .groupBy("dedup_key")
        .agg(F.max("duration_ms").alias("duration_ms"))
    )


