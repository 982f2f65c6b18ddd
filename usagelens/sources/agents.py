"""Other agents' line logs: dsh, workbuddy, grok, pi, kimi, qoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions import variants as V
from usagelens.functions.names import basename, normalize_model
from usagelens.functions.times import parse_iso_millis, seconds_to_millis
from usagelens.sources.lines import (
    CALL_FIELDS,
    as_rows,
    folder_name,
    in_file_order,
    parsed,
    project_of,
    stem,
    used,
    with_total,
)

_PLACE = ["path", "block", "pos"]


def _text_of_id(v: Column, path: str) -> Column:
    """An id that may be a string or a number, as text."""
    return V.text(v, path)


def _template(v: Column, path: str) -> Column:
    """A scalar rendered into a key; absent values give an empty text."""
    return F.coalesce(V.get(v, path, "string"), F.lit(""))


# ------------------------------------------------------------------------------------ dsh


def _dsh_requests(lines: DataFrame) -> DataFrame:
    rows = parsed(lines, '"usage"', '"request/header"', '"type":"session"')
    v = F.col("v")
    kind = V.text(v, "$.type")
    message, chunk = kind == "assistant/message", kind == "assistant/chunk"
    chunk_usage = chunk & (V.text(v, "$.data.chunk.type") == "usage")

    def count(field: str) -> Column:
        return F.when(message, V.count(v, f"$.data.usage.{field}")).when(
            chunk_usage, V.count(v, f"$.data.chunk.usage.{field}")
        )

    flat = rows.select(
        *_PLACE,
        kind.alias("kind"),
        V.number(v, "$.time").cast("long").alias("ts_ms"),
        project_of(v, "$.cwd").alias("cwd_name"),
        V.text(v, "$.data.header.config.model").alias("header_model"),
        V.text(v, "$.data.message.source.model").alias("own_model"),
        V.safe_int(v, "$.data.turn").alias("turn"),
        V.safe_int(v, "$.data.step").alias("step"),
        _template(v, "$.data.turn").alias("turn_text"),
        _template(v, "$.data.step").alias("step_text"),
        V.get(v, "$.seq", "string").alias("seq"),
        count("inputTokens").alias("input_tokens"),
        count("cacheReadTokens").alias("cached_input"),
        count("cacheWriteTokens").alias("cache_write"),
        count("outputTokens").alias("output_tokens"),
        count("reasoningTokens").alias("reasoning_tokens"),
    )
    known = in_file_order(flat, {
            "current_model": ("last", F.when(F.col("kind") == "request/header", F.col("header_model"))),
            "project": ("last", F.when(F.col("kind") == "session", F.col("cwd_name"))),
        },
    )
    folder = folder_name(1)
    is_message = F.col("kind") == "assistant/message"
    identified = F.col("turn").isNotNull() & F.col("step").isNotNull()
    old_request = F.concat_ws(":", F.lit("dsh:request"), folder, "turn", "step")
    request = F.concat_ws(":", old_request, "input_tokens", "cached_input", "cache_write")
    seq = F.coalesce("seq", F.lit("undefined"))
    legacy = F.when(
        is_message, F.concat_ws(":", F.lit("dsh"), folder, basename(F.col("path")), seq)
    ).otherwise(F.concat_ws(":", F.lit("dsh"), folder, seq, "turn_text", "step_text"))
    shaped = known.filter(F.col("input_tokens").isNotNull() & F.col("ts_ms").isNotNull()).select(
        *_PLACE,
        F.when(identified, request).otherwise(legacy).alias("dedup_key"),
        F.when(identified, F.array(legacy, old_request)).alias("legacy_keys"),
        "ts_ms",
        F.lit("dsh").alias("tool"),
        normalize_model(F.coalesce(F.when(is_message, F.col("own_model")), "current_model")).alias("model"),
        folder.alias("session_id"),
        "project",
        "input_tokens",
        "cached_input",
        "cache_write",
        "output_tokens",
        "reasoning_tokens",
        is_message.alias("is_message"),
    )
    return used(with_total(shaped))


def norm_dsh(lines: DataFrame) -> DataFrame:
    """Requests of harness snapshots: chunk and message rows of one request fold to one event.

    The larger output stays; among equals a message row wins, the last of them.
    """
    rows = as_rows(_dsh_requests(lines), extra=["is_message"])
    # among equals the last message row, or else the first chunk row
    later = F.when(F.col("is_message"), 1).otherwise(-1)
    rank = F.struct(
        F.col("output_tokens"), F.col("is_message"), F.col("block") * later, F.col("pos") * later
    )
    kept = [c for c in rows.columns if c not in ("dedup_key", "path", "is_message")]
    return (
        rows.groupBy("path", "dedup_key")
        .agg(F.max_by(F.struct(*kept), rank).alias("e"))
        .select("path", "dedup_key", "e.*")
    )


def dsh_legacy_keys(lines: DataFrame) -> DataFrame:
    """Old-style keys met for each request: input of ``dedup_request_alias``."""
    return (
        _dsh_requests(lines)
        .filter(F.col("legacy_keys").isNotNull())
        .select("dedup_key", F.explode("legacy_keys").alias("legacy_key"))
        .distinct()
    )


# ------------------------------------------------------------------------------ workbuddy


def norm_workbuddy(lines: DataFrame) -> DataFrame:
    """Transcripts whose input already contains the cache reads; carries the trace id."""
    rows = parsed(lines, '"usage"')
    v = F.col("v")
    raw_input = V.count(v, "$.message.usage.input_tokens")
    cached = F.least(V.count(v, "$.message.usage.cache_read_input_tokens"), raw_input)
    folder = folder_name(1)
    named = F.regexp_extract(folder, r"-WorkBuddy-(.+)$", 1)
    record_id = _text_of_id(v, "$.id")
    shaped = rows.filter(
        V.present(v, "$.message.usage") & record_id.isNotNull() & V.number(v, "$.timestamp").isNotNull()
    ).select(
        *_PLACE,
        F.concat(F.lit("wb:"), record_id).alias("dedup_key"),
        V.number(v, "$.timestamp").cast("long").alias("ts_ms"),
        F.lit("workbuddy").alias("tool"),
        normalize_model(V.text(v, "$.providerData.model")).alias("model"),
        F.coalesce(V.text(v, "$.sessionId"), stem()).alias("session_id"),
        F.when(named != "", named).otherwise(folder).alias("project"),
        (raw_input - cached).alias("input_tokens"),
        cached.alias("cached_input"),
        F.lit(0).cast("long").alias("cache_write"),
        V.count(v, "$.message.usage.output_tokens").alias("output_tokens"),
        V.text(v, "$.providerData.traceId").alias("trace_id"),
    )
    return as_rows(used(with_total(shaped)))


# ----------------------------------------------------------------------------------- grok


def _grok_updates(lines: DataFrame) -> DataFrame:
    rows = parsed(lines, '"turn_completed"', '"sessionUpdate":"tool_call"', '"totalTokens"')
    v = F.col("v")
    stamp = V.number(v, "$.timestamp")
    folder = F.coalesce(F.nullif(folder_name(2), F.lit("")), folder_name(1))
    return rows.filter(V.present(v, "$.params.update")).select(
        *_PLACE,
        "v",
        seconds_to_millis(stamp).alias("ts_ms"),
        basename(F.coalesce(F.try_url_decode(folder), folder)).alias("project"),
        F.coalesce(V.text(v, "$.params.sessionId"), stem()).alias("session_id"),
    ).filter(F.col("ts_ms").isNotNull())


def norm_grok(lines: DataFrame) -> DataFrame:
    """One event per model of each completed turn, or one for the whole turn."""
    v = F.col("v")
    usage = "$.params.update.usage"
    turns = _grok_updates(lines).filter(
        (V.text(v, "$.params.update.sessionUpdate") == "turn_completed") & V.present(v, usage)
    )
    split = V.is_object(v, f"{usage}.modelUsage")
    per_model = F.map_entries(V.get(v, f"{usage}.modelUsage", "map<string,variant>"))
    whole = F.array(
        F.struct(F.lit(None).cast("string").alias("key"), V.get(v, usage, "variant").alias("value"))
    )
    entries = turns.select(
        *_PLACE,
        "ts_ms",
        "project",
        "session_id",
        _template(v, "$.params.sessionId").alias("sid_text"),
        _template(v, "$.params.update.prompt_id").alias("prompt"),
        F.explode(F.when(split, per_model).otherwise(whole)).alias("e"),
    )
    m = F.col("e.value")
    raw_input = V.count(m, "$.inputTokens")
    cached = F.least(V.count(m, "$.cachedReadTokens"), raw_input)
    shaped = entries.select(
        *_PLACE,
        F.concat_ws(":", F.lit("grok"), "sid_text", "prompt", F.coalesce("e.key", F.lit("x"))).alias("dedup_key"),
        "ts_ms",
        F.lit("grok").alias("tool"),
        normalize_model(F.coalesce(F.nullif(F.col("e.key"), F.lit("")), F.lit("grok"))).alias("model"),
        "session_id",
        "project",
        (raw_input - cached).alias("input_tokens"),
        cached.alias("cached_input"),
        V.count(m, "$.cacheCreationTokens").alias("cache_write"),
        V.count(m, "$.outputTokens").alias("output_tokens"),
        V.count(m, "$.reasoningTokens").alias("reasoning_tokens"),
    )
    return as_rows(used(with_total(shaped)))


def grok_tool_calls(lines: DataFrame) -> DataFrame:
    v = F.col("v")
    name = F.coalesce(V.text(v, "$.params.update.title"), V.text(v, "$.params.update.kind"))
    call_id = _text_of_id(v, "$.params.update.toolCallId")
    rows = _grok_updates(lines).filter(V.text(v, "$.params.update.sessionUpdate") == "tool_call")
    return rows.filter(name.isNotNull() & call_id.isNotNull()).select(
        F.concat(F.lit("grok:tc:"), call_id).alias("dedup_key"),
        "ts_ms",
        F.lit("grok").alias("tool"),
        name.alias("name"),
        "session_id",
        *_PLACE,
    )


def grok_live_context(lines: DataFrame) -> DataFrame:
    """Largest context seen per file in this batch: a live snapshot, not consumption."""
    v = F.col("v")
    rows = _grok_updates(lines).select(
        *_PLACE, "ts_ms", "session_id", "project",
        V.number(v, "$.params._meta.totalTokens").cast("long").alias("context_tokens"),
    )
    first_of_max = F.struct(F.col("context_tokens"), -F.col("block"), -F.col("pos"))
    return (
        rows.filter(F.col("context_tokens") > 0)
        .groupBy("path")
        .agg(F.max_by(F.struct("ts_ms", "context_tokens", "session_id", "project"), first_of_max).alias("s"))
        .select(F.lit("grok:live").alias("tool"), "path", "s.*")
    )


def live_view(snapshots: DataFrame, now_ms: int) -> DataFrame:
    """Newest live snapshot, unless it is older than ten minutes."""
    newest = snapshots.groupBy("tool").agg(
        F.max_by(F.struct("ts_ms", "context_tokens", "session_id", "project"), "ts_ms").alias("s")
    )
    return newest.select("tool", "s.*").filter(F.col("ts_ms") >= now_ms - fixed.LIVE_TTL_MS)


# ------------------------------------------------------------------------------------- pi


def _pi_messages(lines: DataFrame) -> DataFrame:
    rows = parsed(lines, '"usage"', '"toolCall"', '"session"')
    v = F.col("v")
    kind = V.text(v, "$.type")
    flat = rows.select(
        *_PLACE, "v", kind.alias("kind"), F.when(kind == "session", project_of(v, "$.cwd")).alias("cwd_name")
    )
    known = in_file_order(flat, {"project": ("last", F.col("cwd_name"))})
    stamp = F.coalesce(
        parse_iso_millis(V.text(v, "$.timestamp")), V.number(v, "$.message.timestamp").cast("long")
    )
    return (
        known.filter((F.col("kind") == "message") & (V.text(v, "$.message.role") == "assistant"))
        .withColumn("ts_ms", stamp)
        .withColumn("session_id", F.regexp_replace(stem(), r"^.*_", ""))
        .filter(F.col("ts_ms") > 0)
    )


def norm_pi(lines: DataFrame) -> DataFrame:
    v = F.col("v")
    key = F.coalesce(_text_of_id(v, "$.id"), _text_of_id(v, "$.message.responseId"))
    rows = _pi_messages(lines).filter(V.present(v, "$.message.usage") & key.isNotNull())
    shaped = rows.select(
        *_PLACE,
        F.concat_ws(":", F.lit("pi"), "session_id", key).alias("dedup_key"),
        "ts_ms",
        F.lit("pi").alias("tool"),
        normalize_model(V.text(v, "$.message.model")).alias("model"),
        "session_id",
        "project",
        V.count(v, "$.message.usage.input").alias("input_tokens"),
        V.count(v, "$.message.usage.cacheRead").alias("cached_input"),
        V.count(v, "$.message.usage.cacheWrite").alias("cache_write"),
        V.count(v, "$.message.usage.output").alias("output_tokens"),
        V.count(v, "$.message.usage.reasoning").alias("reasoning_tokens"),
    )
    return as_rows(used(with_total(shaped)))


def pi_tool_calls(lines: DataFrame) -> DataFrame:
    v, b = F.col("v"), F.col("b")
    blocks = _pi_messages(lines).select(
        *_PLACE, "ts_ms", "session_id",
        F.posexplode(V.get(v, "$.message.content", "array<variant>")).alias("i", "b"),
    )
    name = V.text(b, "$.name")
    block_id = F.coalesce(_text_of_id(b, "$.id"), F.col("i").cast("string"))
    return blocks.filter((V.text(b, "$.type") == "toolCall") & name.isNotNull()).select(
        F.concat_ws(":", F.lit("pi:tc"), "session_id", block_id).alias("dedup_key"),
        "ts_ms",
        F.lit("pi").alias("tool"),
        name.alias("name"),
        "session_id",
        *_PLACE,
    ).select(*CALL_FIELDS, *_PLACE)


# ----------------------------------------------------------------------------------- kimi


def kimi_steps(lines: DataFrame) -> DataFrame:
    """Step ends with their usage, and configured model aliases, with file position; no line looks at another."""
    rows = parsed(lines, "step.end", "config.update")
    v = F.col("v")
    wrapped = (V.text(v, "$.type") == "context.append_loop_event") & V.present(v, "$.event")
    alias = F.element_at(F.split(V.text(v, "$.modelAlias"), "/"), -1)
    event = F.when(wrapped, V.get(v, "$.event", "variant")).otherwise(F.col("v"))
    flat = rows.select(
        *_PLACE,
        F.when(V.text(v, "$.type") == "config.update", alias).alias("alias"),
        event.alias("e"),
        F.coalesce(V.get(v, "$.time", "double"), V.get(v, "$.event.time", "double")).cast("long").alias("ts_ms"),
    )
    e = F.col("e")

    def n(path: str) -> Column:
        value = V.get(e, f"$.usage.{path}", "double")
        return F.when(value > 0, F.floor(value)).otherwise(F.lit(0)).cast("long")

    def has(path: str) -> Column:
        return V.present(e, f"$.usage.{path}")

    folded_in = n("input_tokens_details.cached_tokens")
    own, anthropic = has("inputOther"), has("cache_read_input_tokens")
    ends = (
        (V.text(e, "$.type") == "step.end")
        & V.present(e, "$.usage")
        & _text_of_id(e, "$.uuid").isNotNull()
        & F.col("ts_ms").isNotNull()
    )
    return flat.select(
        *_PLACE,
        "alias",
        F.when(ends, F.concat(F.lit("kimi:"), _text_of_id(e, "$.uuid"))).alias("dedup_key"),
        "ts_ms",
        F.when(own, n("inputOther"))
        .when(anthropic, n("input_tokens"))
        .otherwise(F.greatest(n("input_tokens") - folded_in, F.lit(0)))
        .alias("input_tokens"),
        F.when(own, n("inputCacheRead"))
        .when(anthropic, n("cache_read_input_tokens"))
        .otherwise(folded_in)
        .alias("cached_input"),
        F.when(own, n("inputCacheCreation")).otherwise(n("cache_creation_input_tokens")).alias("cache_write"),
        F.when(own, n("output")).otherwise(n("output_tokens")).alias("output_tokens"),
    ).filter(F.col("alias").isNotNull() | F.col("dedup_key").isNotNull())


def kimi_events(known: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """Event rows of step ends with ``current``, the alias in force."""
    shaped = known.filter(F.col("dedup_key").isNotNull()).select(
        *_PLACE,
        "dedup_key",
        "ts_ms",
        F.lit("kimi").alias("tool"),
        normalize_model(F.coalesce("current", F.lit("kimi-for-coding"))).alias("model"),
        folder_name(3).alias("session_id"),
        folder_name(4).alias("wd_key"),
        "input_tokens",
        "cached_input",
        "cache_write",
        "output_tokens",
    )
    if workspaces is not None:
        names = workspaces.select("wd_key", F.col("name").alias("project"))
        shaped = shaped.join(names, "wd_key", "left")
    else:
        shaped = shaped.withColumn("project", F.lit(None).cast("string"))
    return as_rows(used(with_total(shaped)))


def norm_kimi(lines: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """Step-end usage in three layouts; the model is the last configured alias.

    ``workspaces`` maps folder keys (wd_key) to project names.
    """
    known = in_file_order(kimi_steps(lines), {"current": ("last", F.col("alias"))})
    return kimi_events(known, workspaces)


# ---------------------------------------------------------------------------------- qoder


def _qoder_rows(lines: DataFrame) -> DataFrame:
    rows = parsed(lines, '"assistant"', "workspace-directories")
    v = F.col("v")
    folder = F.when(
        V.text(v, "$.type") == "workspace-directories", basename(V.text(v, "$.directories[0]"))
    )
    flat = rows.select(*_PLACE, "v", folder.alias("cwd_name"))
    known = in_file_order(flat, {"project": ("last", F.col("cwd_name"))})
    return (
        known.filter(
            (V.text(v, "$.type") == "assistant")
            & _text_of_id(v, "$.message.id").isNotNull()
            & V.present(v, "$.message.usage")
        )
        .withColumn("ts_ms", parse_iso_millis(V.text(v, "$.timestamp")))
        .filter(F.col("ts_ms").isNotNull())
    )


def qoder_model(raw: Column) -> Column:
    """Model id without the per-installation prefix; unnamed models get a fixed name."""
    bare = F.regexp_replace(F.trim(raw), fixed.BYOK_PREFIX, "")
    return F.coalesce(normalize_model(bare), F.lit("qoder-agent"))


def norm_qoder(lines: DataFrame) -> DataFrame:
    v = F.col("v")
    usage = "$.message.usage"
    shaped = _qoder_rows(lines).select(
        *_PLACE,
        F.concat_ws(":", F.lit("qoder"), _text_of_id(v, "$.message.id"), _template(v, f"{usage}.request_id")).alias("dedup_key"),
        "ts_ms",
        F.lit("qoder").alias("tool"),
        qoder_model(V.text(v, "$.message.model")).alias("model"),
        F.coalesce(V.text(v, "$.sessionId"), stem()).alias("session_id"),
        "project",
        V.count(v, f"{usage}.input_tokens").alias("input_tokens"),
        V.count(v, f"{usage}.cache_read_input_tokens").alias("cached_input"),
        V.count(v, f"{usage}.cache_creation_input_tokens").alias("cache_write"),
        V.count(v, f"{usage}.output_tokens").alias("output_tokens"),
    )
    return as_rows(used(with_total(shaped)))


def qoder_credits(lines: DataFrame) -> DataFrame:
    """Positive credits per message, also where no tokens are reported."""
    v = F.col("v")
    credits = V.number(v, "$.message.usage.credits")
    return _qoder_rows(lines).filter(credits > 0).select(
        F.concat(F.lit("qoder-credit:"), _text_of_id(v, "$.message.id")).alias("dedup_key"),
        "ts_ms",
        F.lit("qoder").alias("tool"),
        credits.alias("amount"),
        *_PLACE,
    )
