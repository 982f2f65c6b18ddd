"""Usage totals by day, tool, model, device and session, and the day-axis shaping of charts."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions.predicates import in_range, since
from usagelens.operators.skew import literal_table
from usagelens.functions.times import local_day, local_day_start, local_today


def _tokens() -> Column:
    return F.sum("total_tokens").alias("total")


def _calls() -> Column:
    return F.count(F.lit(1)).alias("n")


def _sum_if(condition: Column, value: Column | str = "total_tokens") -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(condition, column)), F.lit(0))


def totals(events: DataFrame, now_ms: int, tz: str = "UTC") -> DataFrame:
    """One row: all-time, today, last 7 days, peak day, active days, sessions active today.

    Rows fold to one per day first; distinct sessions are counted on today's rows alone, which
    a stored table prunes to today's partition.
    """
    today = F.lit(local_today(now_ms, tz)).cast("date")
    daily = by_day_all(events, tz).withColumn("sessions", F.lit(None).cast("long"))
    sessions = (
        since(events, local_day_start(now_ms, 0, tz))
        .agg(F.count_distinct("session_id").alias("sessions"))
        .select(
            F.lit(None).cast("date").alias("day"),
            F.lit(None).cast("long").alias("total"),
            F.lit(None).cast("long").alias("n"),
            "sessions",
        )
    )
    return daily.unionByName(sessions).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("all_time_tokens"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("all_time_events"),
        _sum_if(F.col("day") >= today, "total").alias("today_tokens"),
        _sum_if(F.col("day") >= F.date_sub(today, 6), "total").alias("last7d_tokens"),
        F.greatest(F.coalesce(F.max("total"), F.lit(0)), F.lit(0)).alias("peak_day_tokens"),
        F.count("day").alias("active_days"),
        F.max("sessions").alias("today_active_sessions"),
    )


def by_day_all(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """Tokens and requests of every local day."""
    return events.groupBy(local_day(F.col("ts_ms"), tz).alias("day")).agg(_tokens(), _calls())


def by_day_tool(events: DataFrame, days: int, now_ms: int, tz: str = "UTC") -> DataFrame:
    """Tokens by local day and tool within the range."""
    rows = in_range(events, days, now_ms, tz)
    return rows.groupBy(local_day(F.col("ts_ms"), tz).alias("day"), "tool").agg(_tokens())


def by_day_map(by_day_tool_rows: DataFrame) -> DataFrame:
    """One row per day with a map tool -> tokens (at most one entry per tool) and the day total."""
    return by_day_tool_rows.groupBy("day").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "total")))).alias("tools"),
        F.sum("total").alias("total"),
    )


def by_model(
    events: DataFrame, days: int, now_ms: int, limit: int | None = None, tz: str = "UTC"
) -> DataFrame:
    """Models of the range, the largest first; rows without a model form their own group."""
    models = in_range(events, days, now_ms, tz).groupBy("model").agg(_tokens(), _calls())
    return _top(models, limit, F.desc("total"), F.asc_nulls_last("model"))


def _top(rows: DataFrame, limit: int | None, *order) -> DataFrame:
    """Rows in order; cut only where the caller asks for a top list."""
    ordered = rows.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def by_tool(events: DataFrame, days: int, now_ms: int, tz: str = "UTC") -> DataFrame:
    return in_range(events, days, now_ms, tz).groupBy("tool").agg(_tokens(), _calls())


def by_tool_totals(events: DataFrame) -> DataFrame:
    """All-history totals per tool with the four token kinds."""
    return events.groupBy("tool").agg(
        _calls(),
        F.sum("input_tokens").alias("input"),
        F.sum("cached_input").alias("cached"),
        F.sum("cache_write").alias("cache_write"),
        F.sum("output_tokens").alias("output"),
        _tokens(),
    )


def daily_tool_export(events: DataFrame, days: int, now_ms: int, tz: str = "UTC") -> DataFrame:
    """Six sums per local day and tool, in the layout of the CSV export."""
    return (
        in_range(events, days, now_ms, tz)
        .groupBy(local_day(F.col("ts_ms"), tz).cast("string").alias("day"), "tool")
        .agg(
            F.sum("input_tokens").alias("input"),
            F.sum("cached_input").alias("cached_input"),
            F.sum("cache_write").alias("cache_write"),
            F.sum("output_tokens").alias("output"),
            _tokens(),
            F.count(F.lit(1)).alias("calls"),
        )
    )


def device_overview(events: DataFrame, since_ms: int) -> DataFrame:
    """All known devices, with zeros where nothing was recorded."""
    spark = events.sparkSession
    known = literal_table(spark, [(d,) for d in fixed.DEVICES], "id string")
    in_window = F.col("ts_ms") >= since_ms
    sums = events.groupBy(F.col("device").alias("id")).agg(
        F.count(F.lit(1)).alias("events"),
        _tokens(),
        _sum_if(in_window).alias("range_tokens"),
        F.count(F.when(in_window, 1)).alias("range_events"),
    )
    return known.join(sums, "id", "left").na.fill(
        0, ["events", "total", "range_tokens", "range_events"]
    )


def _session_aggs() -> list[Column]:
    # distinct models of a session: a short set, merged map-side
    models = F.array_join(F.array_sort(F.collect_set("model")), ",")
    return [
        F.min("ts_ms").alias("first_ts"),
        F.max("ts_ms").alias("last_ts"),
        F.count(F.lit(1)).alias("calls"),
        _tokens(),
        F.max("total_tokens").alias("peak"),
        F.max("project").alias("project"),
        F.nullif(models, F.lit("")).alias("models"),
    ]


def sessions_day(
    events: DataFrame, day: str, tool: str | None = None, limit: int | None = None, tz: str = "UTC"
) -> DataFrame:
    """Sessions of one local day by (tool, session); rows without a session group per tool."""
    rows = _one_day(events, day, tz)
    if tool:
        rows = rows.filter(F.col("tool") == tool)
    sessions = rows.groupBy("tool", "session_id").agg(*_session_aggs())
    return _top(sessions, limit, F.desc("total"), "tool", F.asc_nulls_last("session_id"))


def _one_day(events: DataFrame, day: str, tz: str) -> DataFrame:
    """Rows of one local day, as an instant range so that scans can be pruned."""
    noon = datetime.fromisoformat(f"{day}T12:00:00").replace(tzinfo=ZoneInfo(tz))
    noon_ms = int(noon.timestamp() * 1000)
    start, end = local_day_start(noon_ms, 0, tz), local_day_start(noon_ms, 1, tz)
    return since(events, start).filter(F.col("ts_ms") < end)


def sessions_report(
    events: DataFrame,
    day: str | None = None,
    first_day: str | None = None,
    last_day: str | None = None,
    limit: int | None = None,
    tz: str = "UTC",
) -> DataFrame:
    """Sessions by id only; the tool is that of the first event.

    ``day`` keeps the events of one local day; ``first_day``/``last_day`` keep whole sessions
    whose first and last local day lie inside the range.
    """
    rows = _one_day(events, day, tz) if day else events
    sessions = rows.groupBy("session_id").agg(
        F.min_by("tool", F.struct("ts_ms", "dedup_key")).alias("tool"), *_session_aggs()
    )
    if not day and first_day and last_day:
        sessions = sessions.filter(
            (local_day(F.col("first_ts"), tz) >= F.lit(first_day).cast("date"))
            & (local_day(F.col("last_ts"), tz) <= F.lit(last_day).cast("date"))
        )
    return _top(sessions, limit, F.desc("total"), F.asc_nulls_last("session_id"))


def tool_activity(
    calls: DataFrame, days: int, now_ms: int, top: int | None = None, tz: str = "UTC"
) -> DataFrame:
    """Tool-call counts per name, with the count of each tool; ``top`` keeps the busiest names."""
    pairs = in_range(calls, days, now_ms, tz).groupBy("name", "tool").agg(_calls())
    names = pairs.groupBy("name").agg(
        F.sum("n").alias("n"),
        # at most one entry per registered tool
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools"),
    )
    return _top(names, top, F.desc("n"), "name")


def credit_summary(credits: DataFrame, now_ms: int, tz: str = "UTC") -> DataFrame:
    """Credits per tool: all time and today."""
    today = F.col("ts_ms") >= local_day_start(now_ms, 0, tz)
    amount = F.col("amount").cast("decimal(28,6)")
    return credits.groupBy("tool").agg(
        F.sum(amount).cast("double").alias("total"),
        F.coalesce(F.sum(F.when(today, amount)).cast("double"), F.lit(0.0)).alias("today"),
    )


def today_report(events: DataFrame, now_ms: int, tz: str = "UTC") -> dict[str, DataFrame]:
    """Today's tokens and requests, by tool and by model, next to the all-time totals."""
    start = local_day_start(now_ms, 0, tz)
    today = since(events, start)
    in_today = F.col("ts_ms") >= start
    return {
        "totals": events.agg(
            _sum_if(in_today).alias("today_tokens"),
            F.count(F.when(in_today, 1)).alias("today_requests"),
            F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("all_time_tokens"),
            _calls().alias("all_time_events"),
        ),
        "by_tool": today.groupBy("tool").agg(_tokens(), _calls()),
        "by_model": today.groupBy("model").agg(_tokens(), _calls()),
    }


def fill_days(daily: DataFrame, value: str = "total") -> DataFrame:
    """Continuous day axis with zeros; its length is bounded by the calendar."""
    span = daily.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    holes = (
        span.filter(F.col("first").isNotNull())
        .select(F.explode(F.sequence("first", "last")).alias("day"))
        .withColumn(value, F.lit(0).cast("long"))
    )
    return daily.select("day", value).unionByName(holes).groupBy("day").agg(
        F.sum(value).alias(value)
    )


def pick_series(daily: DataFrame, key: str, limit: int, value: str = "total") -> DataFrame:
    """Series of a stacked chart: keys by last use, total and name; the tail becomes one series.

    ``daily`` has one row per (day, key), so the ranking works on one row per key.
    """
    used = daily.filter((F.col(value) > 0) & F.col(key).isNotNull())
    per_key = used.groupBy(key).agg(
        F.max("day").alias("last_day"), F.sum(value).alias("series_total")
    )
    head = (
        per_key.orderBy(F.desc("last_day"), F.desc("series_total"), key)
        .limit(limit)
        .select(F.col(key).alias("series"), "last_day", "series_total")
    )
    order = W.orderBy(F.desc("last_day"), F.desc("series_total"), "series")
    # at most ``limit`` rows reach this window
    ranked = head.withColumn("pos", F.row_number().over(order).cast("long"))
    tail = (
        used.join(head.select(F.col("series").alias(key)), key, "left_anti")
        .groupBy("day")
        .agg(F.sum(value).alias(value))
        .select("day", F.lit("other").alias("series"), F.lit(limit + 1).cast("long").alias("pos"), value)
    )
    kept = used.join(ranked.withColumnRenamed("series", key), key).select(
        "day", F.col(key).alias("series"), "pos", value
    )
    return kept.unionByName(tail)


def heatmap(daily: DataFrame, mode: str = "daily") -> DataFrame:
    """Calendar values per day: own total, total of the Monday-based week, or running total.

    The input has one row per calendar day, so the running window is bounded by the calendar.
    """
    if mode == "daily":
        return daily.select("day", F.col("total").alias("value"))
    if mode == "weekly":
        week = W.partitionBy(F.trunc("day", "week"))
        return daily.select("day", F.sum("total").over(week).alias("value"))
    if mode == "cumulative":
        running = W.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
        return daily.select("day", F.sum("total").over(running).alias("value"))
    raise ValueError(f"unknown heatmap mode {mode!r}")


def heatmap_year(daily: DataFrame, now_ms: int, tz: str = "UTC") -> DataFrame:
    """364 days up to the last used day with a shade 0-5 by share of the maximum."""
    today = F.lit(local_today(now_ms, tz)).cast("date")
    start = F.date_sub(today, 364)
    axis = (
        daily.agg(F.max("day").alias("last"))
        .filter(F.col("last") >= start)
        .select(F.explode(F.sequence(start, F.col("last"))).alias("day"))
        .withColumn("total", F.lit(0).cast("long"))
    )
    filled = (
        daily.filter(F.col("day") >= start)
        .select("day", "total")
        .unionByName(axis)
        .groupBy("day")
        .agg(F.sum("total").alias("total"))
    )
    # one row per calendar day, at most a year
    ratio = F.col("total") / F.greatest(F.max("total").over(W.partitionBy(F.lit(1))), F.lit(1))
    shade = F.when(F.col("total") <= 0, 0)
    for step, limit in enumerate(fixed.HEAT_STEPS, start=1):
        shade = shade.when(ratio <= limit, step)
    return filled.withColumn("shade", shade.otherwise(len(fixed.HEAT_STEPS) + 1))


def usage_cube(events: DataFrame, lo_ms: int, hi_ms: int, tz: str) -> DataFrame:
    """Tokens and events by local day, tool, model and device between two instants."""
    rows = since(events, lo_ms).filter(F.col("ts_ms") < hi_ms)
    return rows.groupBy(
        local_day(F.col("ts_ms"), tz).alias("day"),
        "tool",
        "model",
        F.coalesce("device", F.lit("unknown")).alias("device"),
    ).agg(F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("events"))


def cube_totals(cube: DataFrame) -> DataFrame:
    """Marginal totals of the cube: per tool, model, device and day, from one pass."""
    keys = ["tool", "model", "device", "day"]
    return (
        cube.groupingSets([[k] for k in keys], *keys)
        .agg(
            F.sum("tokens").alias("tokens"),
            F.sum("events").alias("events"),
            F.grouping_id().alias("gid"),
        )
        .select(
            F.when(F.col("gid") == 0b0111, "tool")
            .when(F.col("gid") == 0b1011, "model")
            .when(F.col("gid") == 0b1101, "device")
            .otherwise("day")
            .alias("dimension"),
            F.coalesce("tool", "model", "device", F.col("day").cast("string")).alias("name"),
            "tokens",
            "events",
        )
    )


def device_freshness(events: DataFrame) -> DataFrame:
    """Newest event per device."""
    return events.groupBy("device").agg(F.max("ts_ms").alias("latest_ts"))


def peak_day(daily: DataFrame) -> DataFrame:
    """Busiest day; the earliest of equals."""
    return daily.orderBy(F.desc("total"), "day").limit(1).select("day", "total")
