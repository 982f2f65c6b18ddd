"""Account usage exports (CSV) and provider quota payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions import variants as V
from usagelens.functions.names import normalize_model
from usagelens.functions.times import parse_iso_millis
from usagelens.operators.skew import running
from usagelens.sources.lines import as_rows, used, with_total

_COLUMNS = {
    "Date": "date",
    "Model": "model",
    "Input (w/ Cache Write)": "cache_write",
    "Input (w/o Cache Write)": "input_tokens",
    "Cache Read": "cached_input",
    "Output Tokens": "output_tokens",
}
USAGE_CSV_SCHEMA = "path string, block long, pos long, " + ", ".join(f"{c} string" for c in _COLUMNS.values())


def read_usage_csv(spark: SparkSession, path: str) -> DataFrame:
    """Usage export rows by column name; a file without a required column gives no rows."""
    raw = (
        spark.read.option("header", "true")
        .option("multiLine", "true")
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    by_name = {c.strip(): c for c in raw.columns}
    if any(name not in by_name for name in _COLUMNS):
        return spark.createDataFrame([], USAGE_CSV_SCHEMA)
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        *[F.col(f"`{by_name[name]}`").alias(column) for name, column in _COLUMNS.items()],
    )


def norm_cursor(rows: DataFrame) -> DataFrame:
    """Account billing rows; identical rows are told apart by their occurrence number.

    The occurrence number runs per fingerprint over file slices, so one very frequent row does
    not gather in one task. Input has path, block, pos and the text columns of the export.
    """
    counters = ["cache_write", "input_tokens", "cached_input", "output_tokens"]
    typed = rows.select(
        "path",
        "block",
        "pos",
        "date",
        "model",
        parse_iso_millis(F.col("date")).alias("ts_ms"),
        *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast("long").alias(c) for c in counters],
    ).filter(F.col("ts_ms").isNotNull() & (F.col("model") != ""))
    typed = used(with_total(typed)).withColumn(
        "fp", F.concat_ws("|", "date", "model", *counters)
    )
    numbered = running(
        typed.withColumn("one", F.lit(1).cast("long")),
        ["fp"],
        "block",
        ["pos"],
        {"nth": ("sum_before", F.col("one"))},
    )
    shaped = numbered.select(
        F.concat_ws(":", F.lit("cursor"), "fp", "nth").alias("dedup_key"),
        "ts_ms",
        F.lit("cursor").alias("tool"),
        normalize_model(F.col("model")).alias("model"),
        F.lit(None).cast("string").alias("session_id"),
        "input_tokens",
        "cached_input",
        "cache_write",
        "output_tokens",
        "total_tokens",
    )
    return as_rows(shaped, order=False)


# ---------------------------------------------------------------------------------- quota


def _percent(c: Column) -> Column:
    # least and greatest skip nulls, so an unknown value must stay unknown explicitly
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)))


def _loose(v: Column, path: str) -> Column:
    """A number, or text that holds one."""
    return V.number(v, path)


def _account_window(w: Column, label: Column) -> Column:
    used_percent = F.coalesce(*[_loose(w, f"$.{n}") for n in ("used_percent", "percent", "utilization")])
    return F.struct(
        label.alias("label"), _percent(used_percent).alias("used_percent"), V.text(w, "$.resets_at").alias("resets_at")
    )


def norm_official_quota(payloads: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Account usage payloads (ts_ms, body) to one row per window; unknown shapes give no row."""
    v = F.col("v")
    main = F.array(*[
        F.when(V.is_object(v, f"$.{n}"), _account_window(V.get(v, f"$.{n}", "variant"), F.lit(n)))
        for n in ("five_hour", "seven_day", "seven_day_opus")
    ])
    label_paths = ["$.scope.model.display_name", "$.scope.model.id"]

    def scoped(path: str, only_kind: bool, own_label: bool) -> Column:
        items = F.coalesce(V.get(v, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))
        if only_kind:
            items = F.filter(items, lambda i: F.coalesce(V.text(i, "$.kind") == "weekly_scoped", F.lit(False)))
        paths = [*label_paths, "$.label"] if own_label else label_paths
        windows = F.transform(
            items, lambda i: _account_window(i, F.coalesce(*[V.text(i, p) for p in paths]))
        )
        return F.filter(windows, lambda w: w["label"].isNotNull())

    windows = F.filter(
        F.concat(main, scoped("$.limits", True, False), scoped("$.weekly_scoped", False, True)),
        lambda w: w["used_percent"].isNotNull(),
    )
    # a payload with nothing but the model-specific weekly window counts as unknown
    known = F.exists(windows, lambda w: w["label"] != "seven_day_opus")
    rows = payloads.select("ts_ms", V.once(V.parse(F.col("body"))).alias("v")).select(
        "ts_ms", F.explode(F.when(known, windows)).alias("w")
    )
    out = rows.select("ts_ms", "w.*")
    if now_ms is None:
        return out
    return out.withColumn("stale", F.lit(now_ms) - F.col("ts_ms") > fixed.QUOTA_STALE_MS)


def norm_plan_quota(payloads: DataFrame) -> DataFrame:
    """Plan quota payloads (ts_ms, body): windows with used percent, amounts and reset time."""
    v = F.col("v")
    items = V.get(v, "$.data.limits", "array<variant>")
    rows = payloads.select("ts_ms", V.once(V.parse(F.col("body"))).alias("v")).select(
        "ts_ms",
        F.nullif(V.text(v, "$.data.level"), F.lit("")).alias("level"),
        F.explode(F.filter(items, lambda i: V.is_object(i, "$"))).alias("l"),
    )
    item = F.col("l")
    pct, total, amount = (_loose(item, f"$.{n}") for n in ("percentage", "usage", "currentValue"))
    derived = F.when((total > 0) & amount.isNotNull(), F.try_divide(amount, total) * 100)
    kind = F.concat_ws(":", V.text(item, "$.type"), V.get(item, "$.unit", "string"))
    label = None
    for known, text in fixed.PLAN_WINDOW_LABELS.items():
        label = (F if label is None else label).when(kind == known, F.lit(text))
    fallback = F.concat(F.lit("窗口 unit="), F.coalesce(V.get(item, "$.unit", "string"), F.lit("undefined")))
    return rows.select(
        "ts_ms",
        "level",
        label.otherwise(fallback).alias("label"),
        _percent(F.coalesce(pct, derived)).alias("used_percent"),
        amount.alias("used"),
        total.alias("total"),
        _loose(item, "$.remaining").alias("remaining"),
        _loose(item, "$.nextResetTime").cast("long").alias("resets_at"),
    ).filter(F.col("used_percent").isNotNull())


def norm_mcp_quota(lines: DataFrame, now_ms: int, tz: str = "UTC") -> DataFrame:
    """Newest usable quota line of a log: (used, quota, remaining, ts_ms), at most six hours old.

    The log line holds a JSON object whose ``body`` is JSON text again.
    """
    stamp = F.regexp_extract("value", r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)
    wall = F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))
    instant = F.unix_millis(wall if tz == "UTC" else F.to_utc_timestamp(wall, tz))
    outer = V.parse(F.regexp_extract("value", r"(\{.*\})", 1))
    rows = lines.filter(F.col("value").contains(fixed.MCP_MARKER)).select(
        "block", "pos", instant.alias("ts_ms"), V.once(V.parse(V.text(outer, "$.body"))).alias("b")
    )
    b = F.col("b")
    used_up, limit = _loose(b, "$.data.total_usage.used"), _loose(b, "$.data.total_usage.limit")
    good = rows.filter(
        F.col("ts_ms").isNotNull()
        & (F.lit(now_ms) - F.col("ts_ms")).between(0, fixed.MCP_MAX_AGE_MS)
        & (V.number(b, "$.code") == 0)
        & used_up.isNotNull()
        & (limit > 0)
    ).select(
        "block", "pos", "ts_ms", used_up.alias("used"), limit.alias("quota"),
        _loose(b, "$.data.total_usage.remaining").alias("remaining"),
    )
    return (
        good.agg(F.max_by(F.struct("used", "quota", "remaining", "ts_ms"), F.struct("ts_ms", "block", "pos")).alias("s"))
        .filter(F.col("s").isNotNull())
        .select("s.*")
    )
