"""Planner transcripts with step metadata (tool antigravity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions import variants as V
from usagelens.functions.names import (
    estimate_tokens,
    normalize_display_model,
    normalize_model,
    parse_model_selection,
)
from usagelens.functions.times import parse_iso_millis
from usagelens.sources.lines import as_rows, in_file_order, parsed, stem


def _estimate(v: Column, path: str) -> Column:
    """Token estimate of a field: text as it is, structures as compact JSON."""
    raw = V.get(v, path, "variant")
    # scalars read as text, structures do not and are rendered
    text = F.coalesce(V.get(v, path, "string"), F.to_json(raw))
    return F.when(V.present(v, path), estimate_tokens(text)).otherwise(F.lit(0)).cast("long")


def session_of(path: Column) -> Column:
    uuid = F.regexp_extract(path, r"[/\\]brain[/\\]([^/\\]+)[/\\]", 1)
    return F.concat(F.lit("anty-"), F.when(uuid != "", uuid).otherwise(stem()))


def steps(lines: DataFrame) -> DataFrame:
    """One row per written step that is final, with its own token estimates."""
    rows = parsed(lines)
    v = F.col("v")
    planner = V.text(v, "$.type") == "PLANNER_RESPONSE"
    content, calls = _estimate(v, "$.content"), _estimate(v, "$.tool_calls")
    exact = {
        "exact_input": V.safe_int(v, "$.input_tokens"),
        "exact_cached": V.safe_int(v, "$.cache_read_tokens"),
        "exact_output": V.safe_int(v, "$.output_tokens"),
        "exact_thinking": V.safe_int(v, "$.thinking_tokens"),
    }
    setting = V.text(v, "$.type").isin("USER_INPUT", "USER_SETTINGS_CHANGE")
    return rows.filter(F.coalesce(V.text(v, "$.status") != "ACTIVE", F.lit(True))).select(
        "path",
        "block",
        "pos",
        session_of(F.col("path")).alias("session_id"),
        F.coalesce(planner, F.lit(False)).alias("planner"),
        V.number(v, "$.step_index").alias("step_number"),
        V.safe_int(v, "$.step_index").alias("step"),
        parse_iso_millis(V.text(v, "$.created_at")).alias("ts_ms"),
        F.when(setting, parse_model_selection(V.text(v, "$.content"))).alias("chosen_model"),
        (content + F.when(planner, calls).otherwise(F.lit(0))).alias("own_tokens"),
        (content + calls + _estimate(v, "$.thinking")).alias("est_output"),
        _estimate(v, "$.thinking").alias("est_thinking"),
        *[c.alias(n) for n, c in exact.items()],
    )


def with_step_facts(rows: DataFrame, gen_meta: DataFrame) -> DataFrame:
    """Steps with the model and context that ``gen_meta`` (session_id, step, model, context_tokens) has for them."""
    meta = gen_meta.filter(F.col("context_tokens") > 0).select(
        "session_id",
        "step",
        normalize_display_model(F.col("model")).alias("meta_model"),
        F.col("context_tokens").cast("long").alias("context_tokens"),
    )
    exact = (
        F.col("exact_input").isNotNull() & F.col("exact_cached").isNotNull() & F.col("exact_output").isNotNull()
    )
    return rows.join(meta, ["session_id", "step"], "left").withColumn("exact", exact)


def norm_antigravity(
    lines: DataFrame, gen_meta: DataFrame, default_model: str | None = None
) -> DataFrame:
    """Planner responses with exact, context or estimated usage (quality 3, 2, 1).

    ``gen_meta`` has session_id, step, model and context_tokens. A repeated step adds nothing to
    the running context and yields a row only if it carries exact counts.
    """
    rows = steps(lines)
    # a window, not a join with the first places: those are as many as the steps
    same = W.partitionBy("path", "step_number")
    numbered = F.col("path").isNotNull() & F.col("step_number").isNotNull()
    place = F.struct("block", "pos")
    first = F.when(numbered, F.min(place).over(same))
    marked = rows.withColumn("repeat", F.coalesce(place > first, F.lit(False)))
    # metadata has a row a step: its size after parsing is misjudged from that of compressed files
    known = with_step_facts(marked, gen_meta.hint("merge"))
    # a response that is dropped as a repeat does not change the model either
    speaks = F.col("planner") & (~F.col("repeat") | F.col("exact"))
    model_now = F.when(speaks, F.col("meta_model")).when(
        ~F.col("repeat") & ~F.col("planner"), F.col("chosen_model")
    )
    ordered = in_file_order(
        known.withColumn("model_now", model_now).withColumn(
            "adds", F.when(~F.col("repeat"), F.col("own_tokens"))
        ),
        {"context": ("sum_before", F.col("adds")), "current": ("last", F.col("model_now"))},
    )
    return antigravity_events(ordered, default_model)


def antigravity_events(ordered: DataFrame, default_model: str | None = None) -> DataFrame:
    """Event rows of steps with ``repeat``, the running ``context`` and the ``current`` model."""
    from_meta = F.col("context_tokens").isNotNull()
    est_input = F.coalesce("context_tokens", "context")
    exact_total = F.col("exact_input") + F.col("exact_cached") + F.col("exact_output")
    usable = F.col("exact") & (exact_total <= fixed.MAX_SAFE_INTEGER)
    zero = F.lit(0).cast("long")
    thinking = F.least(F.coalesce("exact_thinking", zero), F.col("exact_output"))
    responses = ordered.filter(
        F.col("planner")
        & (~F.col("repeat") | usable)
        & F.col("ts_ms").isNotNull()
        & F.col("step").isNotNull()
    )
    model = F.coalesce("current", normalize_display_model(F.lit(default_model).cast("string")))
    shaped = responses.select(
        F.concat_ws(":", F.lit("antigravity"), "session_id", "step").alias("dedup_key"),
        "ts_ms",
        F.lit("antigravity").alias("tool"),
        normalize_model(model).alias("model"),
        "session_id",
        F.lit(None).cast("string").alias("project"),
        F.when(usable, F.col("exact_input")).otherwise(est_input).alias("input_tokens"),
        F.when(usable, F.col("exact_cached")).otherwise(zero).alias("cached_input"),
        zero.alias("cache_write"),
        F.when(usable, F.col("exact_output")).otherwise(F.col("est_output")).alias("output_tokens"),
        F.when(usable, thinking).otherwise(F.col("est_thinking")).alias("reasoning_tokens"),
        F.when(usable, exact_total).otherwise(est_input + F.col("est_output")).alias("total_tokens"),
        F.when(usable, 3).when(from_meta, 2).otherwise(1).alias("usage_quality"),
        "path",
        "block",
        "pos",
    )
    return as_rows(shaped)


def backfill_context(events: DataFrame, gen_meta: DataFrame) -> DataFrame:
    """Estimated events whose metadata arrived later, raised to quality 2; nothing else.

    The result joins the other arrivals of ``dedup_quality``.
    """
    meta = gen_meta.filter(F.col("context_tokens") > 0).select(
        F.concat_ws(":", F.lit("antigravity"), "session_id", F.col("step").cast("string")).alias("dedup_key"),
        normalize_model(normalize_display_model(F.col("model"))).alias("meta_model"),
        F.col("context_tokens").cast("long").alias("context_tokens"),
    )
    pending = events.filter((F.col("usage_quality") == 1) & (F.col("tool") == "antigravity"))
    return (
        pending.join(meta, "dedup_key")
        .withColumn("model", F.coalesce("meta_model", "model"))
        .withColumn("input_tokens", F.col("context_tokens"))
        .withColumn("total_tokens", F.col("context_tokens") + F.col("output_tokens"))
        .withColumn("usage_quality", F.lit(2))
        .select(*events.columns)
    )
