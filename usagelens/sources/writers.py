"""Writers: idempotent upsert, CSV and JSON exports, dated snapshots, masked export."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions import variants as V
from usagelens.functions.keys import masked_id
from usagelens.functions.names import masked_model, safe_category
from usagelens.functions.times import iso_millis, parse_iso_millis, utc_day
from usagelens.operators import aggregate
from usagelens.operators.dedup import merge_upsert
from usagelens.operators.rollup import check_invariants
from usagelens.schema import EVENT_SCHEMA, as_events


# --------------------------------------------------------------------------------- upsert


def with_day(events: DataFrame) -> DataFrame:
    return events.withColumn("day", utc_day(F.col("ts_ms")))


def write_events(events: DataFrame, path: str) -> None:
    """First load of the event table: parquet by UTC day, sorted by key inside the files."""
    rows = with_day(as_events(events).select(*EVENT_SCHEMA.fieldNames()))
    (
        # a day spreads over as many tasks as its size asks for
        rows.repartition("day", F.pmod(F.xxhash64("dedup_key"), F.lit(8)))
        .sortWithinPartitions("day", "dedup_key")
        .write.mode("overwrite")
        .partitionBy("day")
        .parquet(path)
    )


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.exists(jvm_path))


def upsert_events(spark: SparkSession, batch: DataFrame, path: str) -> DataFrame:
    """Merge a batch (event columns and ``ord``) into the table at ``path``.

    A key keeps the day of its first arrival, so the days to rewrite are those of the batch's
    new keys and those where its known keys live. Only these partitions are read in full and
    overwritten; the rest of the table contributes its key column alone. Running the same batch
    again leaves the table as it is. Returns the days that were rewritten.
    """
    staged = as_events(batch)
    if not table_exists(spark, path):
        first = merge_upsert(staged.filter(F.lit(False)).drop("ord"), staged)
        write_events(first, path)
        return with_day(first).select("day").distinct()
    base = spark.read.parquet(path)
    keys = staged.select("dedup_key").distinct()
    known_days = base.select("dedup_key", "day").join(keys, "dedup_key", "left_semi").select("day")
    days = with_day(staged).select("day").unionByName(known_days).distinct()
    # calendar days: a short list, which prunes the partitions of the read below
    touched = [row["day"] for row in days.collect()]
    if not touched:
        return days
    part = base.filter(F.col("day").isin(touched)).drop("day")
    merged = merge_upsert(part.select(*EVENT_SCHEMA.fieldNames()), staged)
    rows = with_day(merged.select(*EVENT_SCHEMA.fieldNames()))
    (
        rows.repartition("day", F.pmod(F.xxhash64("dedup_key"), F.lit(8)))
        .sortWithinPartitions("day", "dedup_key")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )
    return spark.createDataFrame([(d,) for d in touched], "day date")


def upsert_ledger(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Append ledger rows (dedup_key, ts_ms, ...; tool calls, credits) whose key the ledger at ``path`` has not.

    Of rows with one key the first one in file order stays. A key names one line of a log and so has one day: only the
    days of the batch are looked at. The same batch again adds nothing.
    """
    order = [c for c in ("path", "block", "pos") if c in rows.columns]
    at = F.struct(*order) if order else F.col("ts_ms")
    kept = [c for c in rows.columns if c not in ("dedup_key", *order)]
    first = with_day(rows.groupBy("dedup_key").agg(F.min_by(F.struct(*kept), at).alias("f")).select("dedup_key", "f.*"))
    if table_exists(spark, path):
        days = [row["day"] for row in first.select("day").distinct().collect()]
        known = spark.read.parquet(path).filter(F.col("day").isin(days)).select("dedup_key")
        first = first.join(known, "dedup_key", "left_anti")
    first.write.mode("append").partitionBy("day").parquet(path)


# ------------------------------------------------------------------------------ CSV files


def _quoted(c: Column) -> Column:
    """CSV cell quoted only where it must be; null gives an empty cell."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(
        text.rlike('[",\n]'), F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))
    ).otherwise(text)


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows rendered as CSV lines in one ``line`` column."""
    return df.select(F.concat_ws(",", *[_quoted(F.col(c)) for c in df.columns]).alias("line"))


DAILY_COLUMNS = ["day", "tool", "input", "cached_input", "cache_write", "output", "total", "calls"]


def daily_csv(events: DataFrame, days: int, now_ms: int, device: str = "all", tz: str = "UTC") -> DataFrame:
    """Daily export rows of one device or all, in file order."""
    from usagelens.functions.predicates import scope_device

    scoped = scope_device({"events": events}, device)["events"]
    return (
        aggregate.daily_tool_export(scoped, days, now_ms, tz)
        .select(*DAILY_COLUMNS)
        .orderBy("day", "tool")
    )


def export_daily_csv(
    events: DataFrame, path: str, days: int, now_ms: int, device: str = "all", tz: str = "UTC"
) -> None:
    """One CSV file: the result has one row per day and tool."""
    rows = daily_csv(events, days, now_ms, device, tz)
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def sessions_csv(sessions: DataFrame) -> DataFrame:
    """Session export rows: ISO instants, empty cells for null."""
    commits = F.col("commits") if "commits" in sessions.columns else F.lit(None)
    return sessions.select(
        "session_id",
        "tool",
        "project",
        iso_millis(F.col("first_ts")).alias("first_ts"),
        iso_millis(F.col("last_ts")).alias("last_ts"),
        "calls",
        F.col("total").alias("total_tokens"),
        F.col("peak").alias("peak_tokens"),
        "models",
        commits.cast("string").alias("commits"),
    )


def export_sessions_csv(sessions: DataFrame, path: str) -> None:
    """CSV files of a session report, in order by their names; each has the header."""
    rows = sessions_csv(sessions)
    (
        rows.write.mode("overwrite")
        .option("header", "true")
        .option("emptyValue", "")
        .option("nullValue", "")
        .csv(path)
    )


# ------------------------------------------------------------------------------ usage cube


def published_cube(events: DataFrame, lo_ms: int, hi_ms: int, tz: str) -> DataFrame:
    """Cube with publishable labels: irregular names are replaced, unknown devices merged."""
    cube = aggregate.usage_cube(events, lo_ms, hi_ms, tz)
    device = F.when(F.col("device").isin(fixed.DEVICES), F.col("device")).otherwise("unknown")
    return (
        cube.select(
            "day",
            safe_category(F.col("tool"), fixed.UNKNOWN_TOOL).alias("tool"),
            safe_category(F.col("model"), fixed.UNKNOWN_MODEL).alias("model"),
            device.alias("device"),
            "tokens",
            "events",
        )
        .groupBy("day", "tool", "model", "device")
        .agg(F.sum("tokens").alias("tokens"), F.sum("events").alias("events"))
    )


def cube_window(now_ms: int, months: int, tz: str) -> tuple[int, int]:
    """From local midnight ``months`` calendar months ago up to now."""
    import calendar
    from datetime import datetime
    from zoneinfo import ZoneInfo

    zone = ZoneInfo(tz)
    today = datetime.fromtimestamp(now_ms / 1000, zone).date()
    index = today.year * 12 + today.month - 1 - months
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    start = date(year, month + 1, min(today.day, last))
    midnight = datetime(start.year, start.month, start.day, tzinfo=zone)
    return int(midnight.timestamp() * 1000), now_ms


def export_usage_cube(
    events: DataFrame, path: str, now_ms: int, months: int = 6, tz: str = "Asia/Taipei"
) -> None:
    """Cube of the last months as CSV and JSON folders, with a proof folder beside them.

    The rows stay spread over files; the proof holds totals, margins and invariant counts.
    """
    lo, hi = cube_window(now_ms, months, tz)
    cube = published_cube(events, lo, hi, tz)
    window = events.filter((F.col("ts_ms") >= lo) & (F.col("ts_ms") < hi))
    rows = cube.orderBy("day", "tool", "model", "device")
    rows.write.mode("overwrite").option("header", "true").csv(f"{path}/daily-usage-csv")
    rows.write.mode("overwrite").json(f"{path}/daily-usage-json")
    daily = cube.groupBy("day").agg(F.sum("tokens").alias("total"))
    axis = aggregate.fill_days(daily).orderBy("day")
    axis.write.mode("overwrite").json(f"{path}/days")
    aggregate.cube_totals(cube).write.mode("overwrite").json(f"{path}/totals")
    checks = check_invariants(window)
    checks.write.mode("overwrite").json(f"{path}/checks")
    aggregate.device_freshness(events).write.mode("overwrite").json(f"{path}/freshness")


# ------------------------------------------------------------------------------- snapshots


def snapshot_table(df: DataFrame, path: str, day: str, keep: int | None = None) -> list[str]:
    """Dated full copy below ``path``; with ``keep`` only so many newest copies stay. Returns their days."""
    spark = df.sparkSession
    target = f"{path}/snapshot={day}"
    if not table_exists(spark, target):
        df.write.parquet(target)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(
        status.getPath().getName()
        for status in system.listStatus(root)
        if status.getPath().getName().startswith("snapshot=")
    )
    stay = found if keep is None else found[-keep:]
    for name in found[: len(found) - len(stay)]:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return [name.removeprefix("snapshot=") for name in stay]


# --------------------------------------------------------------------------- masked export

_TRANSCRIPT_COUNTS = [
    "input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens",
]
_ROLLOUT_COUNTS = [
    "input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens",
    "reasoning_output_tokens", "total_tokens",
]


def _variants(names: list[str]) -> str:
    return ", ".join(f"{n}: variant" for n in names)


#: what the export reads of a record; counters stay as they are written, so that their JSON type can be checked
_TRANSCRIPT = f"""struct<type: string, timestamp: string, sessionId: string, session_id: string, requestId: string,
    message: struct<id: string, model: string,
      usage: struct<{_variants(_TRANSCRIPT_COUNTS)}, output_tokens_details: struct<thinking_tokens: variant>>>>"""
_ROLLOUT_USAGE = f"struct<{_variants(_ROLLOUT_COUNTS)}>"
_ROLLOUT = f"""struct<type: string, timestamp: string,
    payload: struct<type: string, model: string, session_id: string, parent_thread_id: string, response_id: string,
      thread_settings: struct<model: string>, usage: {_ROLLOUT_USAGE},
      info: struct<total_token_usage: {_ROLLOUT_USAGE}, last_token_usage: {_ROLLOUT_USAGE}>>>"""


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _counts(usage: Column, fields: list[str]) -> Column:
    """The present counters, null unless all of them are safe counts and any is there."""
    values = F.filter(F.array(*[usage[f] for f in fields]), lambda x: x.isNotNull())
    safe = F.forall(F.transform(values, lambda x: V.safe_int(x, "$")), lambda n: n.isNotNull())
    counters = F.struct(*[F.when(usage[f].isNotNull(), V.get(usage[f], "$", "double").cast("long")).alias(f) for f in fields])
    return F.when(usage.isNotNull() & (F.size(values) > 0) & safe, counters)


def export_masked_usage(lines: DataFrame, tool: str) -> DataFrame:
    """Whitelisted projection of raw records as JSON lines; ids are pseudonyms.

    Every output object is built from named fields; no free text passes. Rows that do not fit a
    known shape are left out.
    """
    if tool == "claude-code":
        return _masked_transcripts(_shaped(lines, _TRANSCRIPT))
    if tool != "codex":
        raise ValueError(f"no masked export for {tool}")
    return _masked_rollouts(_shaped(lines, _ROLLOUT))


def _shaped(lines: DataFrame, shape: str) -> DataFrame:
    """Dated records with the fields of ``shape`` in ``r``, one conversion a line."""
    rows = lines.select("path", "block", "pos", V.once(V.get(V.parse(F.col("value")), "$", shape)).alias("r"))
    stamp = V.once(iso_millis(parse_iso_millis(_text(F.col("r.timestamp"))))).alias("at")
    return rows.filter(_text(F.col("r.timestamp")).isNotNull()).select("*", stamp).filter(F.col("at").isNotNull())


def _written(rows: DataFrame, body: Column) -> DataFrame:
    """Lines of the records that have a ``body``, which is built once."""
    return rows.select("path", "block", "pos", V.once(F.to_json(body)).alias("value")).filter(F.col("value").isNotNull())


def _masked_transcripts(rows: DataFrame) -> DataFrame:
    message, raw_model = F.col("r.message"), _text(F.col("r.message.model"))
    told = (_text(F.col("r.type")) == "assistant") & _text(message["id"]).isNotNull() & (raw_model != "<synthetic>")
    thinking = V.safe_int(message["usage"]["output_tokens_details"]["thinking_tokens"], "$")
    rows = rows.filter(told).select(
        "*",
        V.once(F.struct(
            _counts(message["usage"], _TRANSCRIPT_COUNTS).alias("usage"), thinking.alias("thinking"), masked_model(raw_model).alias("model"),
        )).alias("c"),
    )
    usage, thinking = F.col("c.usage"), F.col("c.thinking")
    details = F.when(thinking.isNotNull(), F.struct(thinking.alias("thinking_tokens")))
    session = F.coalesce(_text(F.col("r.sessionId")), _text(F.col("r.session_id")), F.col("path"))
    request = _text(F.col("r.requestId"))
    body = F.struct(
        F.col("r.type").alias("type"),
        F.col("at").alias("timestamp"),
        masked_id("claude-session", session).alias("sessionId"),
        F.lit(fixed.MASKED_CWD).alias("cwd"),
        F.struct(
            masked_id("claude-message", message["id"]).alias("id"),
            F.col("c.model").alias("model"),
            F.struct(*[usage[f].alias(f) for f in _TRANSCRIPT_COUNTS], details.alias("output_tokens_details")).alias("usage"),
        ).alias("message"),
        F.when(request.isNotNull(), masked_id("claude-request", request)).alias("requestId"),
    )
    return _written(rows.filter(usage.isNotNull() & F.col("c.model").isNotNull()), body)


def _masked_rollouts(rows: DataFrame) -> DataFrame:
    payload, kind = F.col("r.payload"), _text(F.col("r.type"))
    payload_kind = _text(payload["type"])
    shapes = [
        (kind == "compacted", "compacted"),
        (payload.isNull(), None),
        ((kind == "session_meta") | (payload_kind == "session_meta"), "session_meta"),
        (kind == "turn_context", "turn_context"),
        (payload_kind == "thread_settings_applied", "settings"),
        (kind == "token_usage_record", "token_usage_record"),
        (payload_kind == "token_count", "count"),
        ((kind == "response_item") & (payload_kind == "function_call"), "call"),
    ]
    shape = None
    for condition, name in shapes:
        shape = (F if shape is None else shape).when(F.coalesce(condition, F.lit(False)), F.lit(name).cast("string"))
    rows = rows.select("*", V.once(shape).alias("shape")).filter(F.col("shape").isNotNull())
    info = payload["info"]

    def of(shapes: str | list[str], value: Column) -> Column:
        return F.when(F.col("shape").isin(shapes), value)

    def masked(domain: str, value: Column) -> Column:
        return F.when(_text(value).isNotNull(), masked_id(domain, value))

    rows = rows.select(
        "*",
        V.once(F.struct(
            of("turn_context", masked_model(_text(payload["model"]))).alias("model"),
            of("settings", masked_model(_text(payload["thread_settings"]["model"]))).alias("settings"),
            of("token_usage_record", _counts(payload["usage"], _ROLLOUT_COUNTS)).alias("usage"),
            of("count", _counts(info["total_token_usage"], _ROLLOUT_COUNTS)).alias("total"),
            of("count", _counts(info["last_token_usage"], _ROLLOUT_COUNTS)).alias("last"),
            of("token_usage_record", masked("codex-response", payload["response_id"])).alias("response_id"),
            of(["token_usage_record", "count"], masked("codex-session", payload["session_id"])).alias("session_id"),
            of("session_meta", masked("codex-session", payload["parent_thread_id"])).alias("parent_thread_id"),
        )).alias("c"),
    )
    is_, c = {name: F.col("shape") == name for _, name in shapes if name}, F.col("c")
    fits = (
        is_["compacted"]
        | is_["session_meta"]
        | is_["call"]
        | (is_["turn_context"] & c["model"].isNotNull())
        | (is_["settings"] & c["settings"].isNotNull())
        | (is_["token_usage_record"] & c["usage"].isNotNull() & c["response_id"].isNotNull())
        | (is_["count"] & c["total"].isNotNull())
    )
    kind_out = F.when(is_["settings"] | is_["count"], "event_msg").when(is_["call"], "response_item").otherwise(F.col("shape"))
    inner_kind = F.when(is_["settings"], "thread_settings_applied").when(is_["count"], "token_count").when(is_["call"], "function_call")
    # absent fields are not written, so one struct serves all shapes
    content = F.struct(
        inner_kind.alias("type"),
        of("session_meta", F.lit(fixed.MASKED_CWD)).alias("cwd"),
        c["parent_thread_id"].alias("parent_thread_id"),
        c["model"].alias("model"),
        of("settings", F.struct(c["settings"].alias("model"))).alias("thread_settings"),
        c["usage"].alias("usage"),
        c["response_id"].alias("response_id"),
        of("count", F.struct(c["total"].alias("total_token_usage"), c["last"].alias("last_token_usage"))).alias("info"),
        c["session_id"].alias("session_id"),
    )
    body = F.struct(kind_out.alias("type"), F.col("at").alias("timestamp"), F.when(~is_["compacted"], content).alias("payload"))
    return _written(rows.filter(fits), body)
