"""Queries: totals, breakdowns, sequences, sessions, charts, year report, top-k, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.predicates import in_range, scope_device, utc_window
from usagelens.functions.times import local_day_start, local_range_start, local_today
from usagelens.operators import aggregate as agg
from usagelens.operators import joins, rollup, sequence, sets, speed, topk, year
from usagelens.plans import views as v
from usagelens.plans.registry import query
from usagelens.plans.views import NOW_MS

DAYS = 7
START = local_range_start(DAYS, NOW_MS)
TODAY = local_today(NOW_MS)
TODAY_START = local_day_start(NOW_MS)
YEAR = 2024
ZONE = "America/New_York"

DAY = "CAST(epoch_ms(ts_ms) AS DATE)"
SINCE = f"ts_ms >= {START}"
DAILY_SQL = f"SELECT {DAY} AS day, CAST(sum(total_tokens) AS BIGINT) AS total, count(*) AS n FROM usage_events GROUP BY 1"
DAILY = {"daily": DAILY_SQL}


def _map_text(column: str, value_type: str = "long"):
    """A map rendered as sorted ``key=value`` pairs, to compare it across engines."""
    pairs = F.transform(
        F.array_sort(F.map_entries(column)),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return F.array_join(pairs, ",")


@query(
    "totals",
    f"""WITH daily AS ({DAILY_SQL})
    SELECT CAST(sum(total) AS BIGINT) AS all_time_tokens, CAST(sum(n) AS BIGINT) AS all_time_events,
      CAST(coalesce(sum(total) FILTER (day >= DATE '{TODAY}'), 0) AS BIGINT) AS today_tokens,
      CAST(coalesce(sum(total) FILTER (day >= DATE '{TODAY}' - 6), 0) AS BIGINT) AS last7d_tokens,
      max(total) AS peak_day_tokens, count(*) AS active_days,
      (SELECT count(DISTINCT session_id) FROM usage_events WHERE ts_ms >= {TODAY_START}) AS today_active_sessions
    FROM daily""",
)
def _(spark, d):
    return agg.totals(v.usage_events(spark, d), NOW_MS)


@query("by_day_all", DAILY_SQL)
def _(spark, d):
    return agg.by_day_all(v.usage_events(spark, d))


@query(
    "by_day_all_zoned",
    f"""SELECT CAST((epoch_ms(ts_ms) AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' AS DATE) AS day,
      CAST(sum(total_tokens) AS BIGINT) AS total, count(*) AS n FROM usage_events GROUP BY 1""",
)
def _(spark, d):
    return agg.by_day_all(v.usage_events(spark, d), ZONE)


DEDUPED = """
    SELECT dedup_key, first(ts_ms ORDER BY ord) AS ts_ms, first(tool ORDER BY ord) AS tool,
      first(total_tokens ORDER BY output_tokens DESC, ord) AS total_tokens
    FROM usage_arrivals GROUP BY dedup_key"""


@query(
    "by_day_tool",
    f"""SELECT {DAY} AS day, tool, CAST(sum(total_tokens) AS BIGINT) AS total
    FROM deduped WHERE ts_ms >= {local_range_start(30, NOW_MS)} GROUP BY 1, 2""",
    {"deduped": DEDUPED},
)
def by_day_tool(spark, d):
    from usagelens.operators.dedup import dedup_events

    return agg.by_day_tool(dedup_events(v.usage_arrivals(spark, d)), 30, NOW_MS)


@query(
    "by_day_tool_map",
    f"""WITH g AS (SELECT {DAY} AS day, tool, CAST(sum(total_tokens) AS BIGINT) AS total
      FROM usage_events WHERE {SINCE} GROUP BY 1, 2)
    SELECT day, string_agg(tool || '=' || total, ',' ORDER BY tool) AS tools, CAST(sum(total) AS BIGINT) AS total
    FROM g GROUP BY day""",
)
def _(spark, d):
    rows = agg.by_day_tool(v.usage_events(spark, d, START), DAYS, NOW_MS)
    return agg.by_day_map(rows).withColumn("tools", _map_text("tools"))


@query(
    "by_model",
    f"""SELECT model, CAST(sum(total_tokens) AS BIGINT) AS total, count(*) AS n FROM usage_events
    WHERE {SINCE} GROUP BY model ORDER BY total DESC, model NULLS LAST LIMIT 10""",
)
def _(spark, d):
    return agg.by_model(v.usage_events(spark, d, START), DAYS, NOW_MS, limit=10)


@query(
    "by_tool",
    f"""SELECT tool, CAST(sum(total_tokens) AS BIGINT) AS total, count(*) AS n FROM usage_events
    WHERE {SINCE} GROUP BY tool""",
)
def _(spark, d):
    return agg.by_tool(v.usage_events(spark, d, START), DAYS, NOW_MS)


@query(
    "by_tool_totals",
    """SELECT tool, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input,
      CAST(sum(cached_input) AS BIGINT) AS cached, CAST(sum(cache_write) AS BIGINT) AS cache_write,
      CAST(sum(output_tokens) AS BIGINT) AS output, CAST(sum(total_tokens) AS BIGINT) AS total
    FROM usage_events GROUP BY tool""",
)
def _(spark, d):
    return agg.by_tool_totals(v.usage_events(spark, d))


EXPORT_SQL = f"""
    SELECT strftime({DAY}, '%Y-%m-%d') AS day, tool, CAST(sum(input_tokens) AS BIGINT) AS input,
      CAST(sum(cached_input) AS BIGINT) AS cached_input, CAST(sum(cache_write) AS BIGINT) AS cache_write,
      CAST(sum(output_tokens) AS BIGINT) AS output, CAST(sum(total_tokens) AS BIGINT) AS total, count(*) AS calls
    FROM usage_events WHERE {{where}} GROUP BY 1, 2"""


@query("daily_tool_export", EXPORT_SQL.replace("{where}", f"ts_ms >= {local_range_start(30, NOW_MS)}"))
def _(spark, d):
    return agg.daily_tool_export(v.usage_events(spark, d), 30, NOW_MS)


@query(
    "device_overview",
    f"""SELECT dev.id, count(e.dedup_key) AS events, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total,
      CAST(coalesce(sum(total_tokens) FILTER ({SINCE}), 0) AS BIGINT) AS range_tokens,
      count(e.dedup_key) FILTER ({SINCE}) AS range_events
    FROM (VALUES ('local'), ('vps'), ('windows'), ('unknown')) dev(id) LEFT JOIN usage_events e ON e.device = dev.id
    GROUP BY dev.id""",
)
def _(spark, d):
    return agg.device_overview(v.usage_events(spark, d), START)


SESSION_COLS = """min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, count(*) AS calls,
      CAST(sum(total_tokens) AS BIGINT) AS total, max(total_tokens) AS peak, max(project) AS project,
      string_agg(DISTINCT model, ',' ORDER BY model) AS models"""


@query(
    "sessions_day",
    f"""SELECT session_id, tool, {SESSION_COLS} FROM usage_events WHERE {DAY} = DATE '{TODAY}'
    GROUP BY tool, session_id ORDER BY total DESC, tool, session_id NULLS LAST""",
)
def _(spark, d):
    return agg.sessions_day(v.usage_events(spark, d, TODAY_START), TODAY)


FIRST_TOOL = "first(tool ORDER BY ts_ms, dedup_key) AS tool"


@query(
    "sessions_report_all",
    f"""SELECT session_id, {FIRST_TOOL}, {SESSION_COLS} FROM usage_events
    GROUP BY session_id ORDER BY total DESC, session_id NULLS LAST""",
)
def _(spark, d):
    return agg.sessions_report(v.usage_events(spark, d))


@query(
    "sessions_report_day",
    f"""SELECT session_id, {FIRST_TOOL}, {SESSION_COLS} FROM usage_events WHERE {DAY} = DATE '{TODAY}'
    GROUP BY session_id ORDER BY total DESC, session_id NULLS LAST""",
)
def _(spark, d):
    return agg.sessions_report(v.usage_events(spark, d), day=TODAY)


@query(
    "sessions_report_range",
    f"""SELECT * FROM (SELECT session_id, {FIRST_TOOL}, {SESSION_COLS} FROM usage_events GROUP BY session_id)
    WHERE CAST(epoch_ms(first_ts) AS DATE) >= DATE '2024-01-02' AND CAST(epoch_ms(last_ts) AS DATE) <= DATE '2024-01-29'
    ORDER BY total DESC, session_id NULLS LAST""",
)
def _(spark, d):
    return agg.sessions_report(
        v.usage_events(spark, d), first_day="2024-01-02", last_day="2024-01-29"
    )


@query(
    "tool_activity",
    f"""WITH pairs AS (SELECT name, tool, count(*) AS n FROM tool_calls WHERE {SINCE}
      GROUP BY name, tool)
    SELECT name, CAST(sum(n) AS BIGINT) AS n, string_agg(tool || '=' || n, ',' ORDER BY tool) AS tools
    FROM pairs GROUP BY name ORDER BY n DESC, name LIMIT 14""",
)
def _(spark, d):
    out = agg.tool_activity(v.tool_calls(spark, d, START), DAYS, NOW_MS, top=14)
    return out.withColumn("tools", _map_text("tools"))


@query(
    "credit_summary",
    f"""SELECT tool, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS total,
      CAST(coalesce(sum(CAST(amount AS DECIMAL(28,6))) FILTER (ts_ms >= {TODAY_START}), 0) AS DOUBLE) AS today
    FROM credit_usage GROUP BY tool""",
)
def _(spark, d):
    return agg.credit_summary(v.credit_usage(spark, d), NOW_MS)


@query(
    "model_speed",
    f"""WITH r AS (SELECT *, CASE WHEN output_tokens >= 20 THEN output_tokens / (duration_ms / 1000) END AS tps
      FROM usage_events WHERE {SINCE} AND model IS NOT NULL AND duration_ms BETWEEN 1 AND 900000)
    SELECT model, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, bool_or(tool = 'codex') AS approx,
      count(*) AS requests, count(tps) AS speed_samples,
      floor(median(tps) * 10 + 0.5) / 10 AS median_tps, floor(quantile_disc(tps, 0.9) * 10 + 0.5) / 10 AS p90_tps,
      CAST(median(duration_ms) AS DOUBLE) AS median_ms, quantile_disc(duration_ms, 0.9) AS p90_ms
    FROM r GROUP BY model""",
)
def _(spark, d):
    out = speed.model_speed(v.usage_events(spark, d, START), DAYS, NOW_MS)
    return out.withColumn("tools", F.array_join("tools", ","))


@query(
    "today_report_totals",
    f"""SELECT CAST(coalesce(sum(total_tokens) FILTER (ts_ms >= {TODAY_START}), 0) AS BIGINT) AS today_tokens,
      count(*) FILTER (ts_ms >= {TODAY_START}) AS today_requests,
      CAST(sum(total_tokens) AS BIGINT) AS all_time_tokens, count(*) AS all_time_events FROM usage_events""",
)
def _(spark, d):
    return agg.today_report(v.usage_events(spark, d), NOW_MS)["totals"]


@query(
    "today_report_by_tool",
    f"""SELECT tool, CAST(sum(total_tokens) AS BIGINT) AS total, count(*) AS n FROM usage_events
    WHERE ts_ms >= {TODAY_START} GROUP BY tool""",
)
def _(spark, d):
    return agg.today_report(v.usage_events(spark, d, TODAY_START), NOW_MS)["by_tool"]


@query(
    "today_report_by_model",
    f"""SELECT model, CAST(sum(total_tokens) AS BIGINT) AS total, count(*) AS n FROM usage_events
    WHERE ts_ms >= {TODAY_START} GROUP BY model""",
)
def _(spark, d):
    return agg.today_report(v.usage_events(spark, d, TODAY_START), NOW_MS)["by_model"]


# one user's days leave holes to fill; every user is kept as its own device-like series
SPARSE = f"""SELECT {DAY} AS day, CAST(sum(total_tokens) AS BIGINT) AS total FROM usage_events
    WHERE project IS NULL AND tool = 'pi' AND model IS NULL GROUP BY 1"""


@query(
    "fill_days",
    f"""WITH s AS ({SPARSE}), axis AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s)
    SELECT axis.day, coalesce(total, 0) AS total FROM axis LEFT JOIN s USING (day)""",
)
def _(spark, d):
    rows = v.usage_events(spark, d).filter(
        "project IS NULL AND tool = 'pi' AND model IS NULL"
    )
    return agg.fill_days(agg.by_day_all(rows))


@query(
    "pick_series",
    f"""WITH g AS (SELECT {DAY} AS day, session_id, CAST(sum(total_tokens) AS BIGINT) AS total
      FROM usage_events WHERE session_id IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT session_id, row_number() OVER (ORDER BY max(day) DESC, sum(total) DESC, session_id) AS pos
      FROM g WHERE total > 0 GROUP BY session_id)
    SELECT day, CASE WHEN pos <= 8 THEN session_id ELSE 'other' END AS series, least(pos, 9) AS pos,
      CAST(sum(total) AS BIGINT) AS total
    FROM g JOIN r USING (session_id) WHERE total > 0 GROUP BY 1, 2, 3""",
)
def _(spark, d):
    rows = v.usage_events(spark, d)
    daily = rows.groupBy(
        agg.local_day(F.col("ts_ms")).alias("day"), "session_id"
    ).agg(F.sum("total_tokens").alias("total"))
    return agg.pick_series(daily, "session_id", 8)


@query("heatmap_daily", "SELECT day, total AS value FROM daily", DAILY)
def _(spark, d):
    return agg.heatmap(agg.by_day_all(v.usage_events(spark, d)), "daily")


@query(
    "heatmap_weekly",
    "SELECT day, CAST(sum(total) OVER (PARTITION BY date_trunc('week', day)) AS BIGINT) AS value FROM daily",
    DAILY,
)
def _(spark, d):
    return agg.heatmap(agg.by_day_all(v.usage_events(spark, d)), "weekly")


@query(
    "heatmap_cumulative",
    "SELECT day, CAST(sum(total) OVER (ORDER BY day) AS BIGINT) AS value FROM daily",
    DAILY,
)
def _(spark, d):
    return agg.heatmap(agg.by_day_all(v.usage_events(spark, d)), "cumulative")


@query(
    "heatmap_year",
    f"""WITH axis AS (SELECT CAST(unnest(generate_series(DATE '{TODAY}' - 364, (SELECT max(day) FROM daily), INTERVAL 1 DAY)) AS DATE) AS day),
    f AS (SELECT axis.day, coalesce(total, 0) AS total FROM axis LEFT JOIN daily USING (day))
    SELECT day, total, CAST(CASE WHEN total <= 0 THEN 0 WHEN r <= 0.15 THEN 1 WHEN r <= 0.35 THEN 2
      WHEN r <= 0.6 THEN 3 WHEN r <= 0.85 THEN 4 ELSE 5 END AS INTEGER) AS shade
    FROM (SELECT *, total / greatest(max(total) OVER (), 1) AS r FROM f)""",
    DAILY,
)
def _(spark, d):
    return agg.heatmap_year(agg.by_day_all(v.usage_events(spark, d)), NOW_MS)


CUBE_LO, CUBE_HI = 1_704_038_400_000, NOW_MS  # local midnight of 2024-01-01 at +8 h
CUBE = f"""SELECT CAST(epoch_ms(ts_ms + 28800000) AS DATE) AS day, tool, model, device,
    CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS events
    FROM usage_events WHERE ts_ms >= {CUBE_LO} AND ts_ms < {CUBE_HI} GROUP BY ALL"""


def _cube(spark, d) -> DataFrame:
    return agg.usage_cube(v.usage_events(spark, d), CUBE_LO, CUBE_HI, "Asia/Taipei")


@query("usage_cube", CUBE)
def _(spark, d):
    return _cube(spark, d)


@query(
    "usage_cube_totals",
    """WITH t AS (
      SELECT 'tool' AS dimension, tool AS name, tokens, events FROM cube
      UNION ALL SELECT 'model', model, tokens, events FROM cube
      UNION ALL SELECT 'device', device, tokens, events FROM cube
      UNION ALL SELECT 'day', strftime(day, '%Y-%m-%d'), tokens, events FROM cube)
    SELECT dimension, name, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(events) AS BIGINT) AS events
    FROM t GROUP BY 1, 2""",
    {"cube": CUBE},
)
def _(spark, d):
    return agg.cube_totals(_cube(spark, d))


@query("device_freshness", "SELECT device, max(ts_ms) AS latest_ts FROM usage_events GROUP BY device")
def _(spark, d):
    return agg.device_freshness(v.usage_events(spark, d))


@query("peak_day", "SELECT day, total FROM daily ORDER BY total DESC, day LIMIT 1", DAILY)
def _(spark, d):
    return agg.peak_day(agg.by_day_all(v.usage_events(spark, d)))


# ---------------------------------------------------------------------------- year report


@query(
    "year_report_totals",
    f"""WITH h AS (SELECT hour(epoch_ms(ts_ms)) AS h, sum(total_tokens) AS t FROM usage_events GROUP BY 1),
    d AS (SELECT DISTINCT {DAY} AS day FROM usage_events),
    runs AS (SELECT count(*) AS n FROM (SELECT day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS g FROM d) GROUP BY g)
    SELECT CAST({YEAR} AS BIGINT) AS year, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS events,
      count(DISTINCT {DAY}) AS active_days, min({DAY}) AS first_day, max({DAY}) AS last_day,
      (SELECT max(n) FROM runs) AS longest_streak_days,
      (SELECT h FROM h ORDER BY t DESC, h LIMIT 1) AS peak_hour
    FROM usage_events WHERE year(epoch_ms(ts_ms)) = {YEAR}""",
)
def _(spark, d):
    return year.year_report(v.usage_events(spark, d), YEAR)["totals"]


@query(
    "year_report_months",
    f"""SELECT m.month, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens
    FROM generate_series(1, 12) m(month) LEFT JOIN usage_events e
      ON month(epoch_ms(ts_ms)) = m.month AND year(epoch_ms(ts_ms)) = {YEAR} GROUP BY 1""",
)
def _(spark, d):
    return year.year_report(v.usage_events(spark, d), YEAR)["by_month"]


@query(
    "year_report_hours",
    f"""SELECT m.hour, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens
    FROM generate_series(0, 23) m(hour) LEFT JOIN usage_events e
      ON hour(epoch_ms(ts_ms)) = m.hour AND year(epoch_ms(ts_ms)) = {YEAR} GROUP BY 1""",
)
def _(spark, d):
    return year.year_report(v.usage_events(spark, d), YEAR)["by_hour"]


@query(
    "year_report_busiest_day",
    "SELECT day, total AS tokens FROM daily ORDER BY total DESC, day LIMIT 1",
    DAILY,
)
def _(spark, d):
    return year.year_report(v.usage_events(spark, d), YEAR)["busiest_day"]


@query(
    "year_report_top",
    f"""WITH t AS (
      SELECT 'tool' AS dimension, tool AS name, total_tokens, ts_ms FROM usage_events
      UNION ALL SELECT 'model', model, total_tokens, ts_ms FROM usage_events
      UNION ALL SELECT 'project', project, total_tokens, ts_ms FROM usage_events),
    g AS (SELECT dimension, name, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM t
      WHERE year(epoch_ms(ts_ms)) = {YEAR} AND name <> '' GROUP BY 1, 2)
    SELECT * FROM (SELECT dimension, row_number() OVER (PARTITION BY dimension ORDER BY tokens DESC, name) AS rank, name, tokens FROM g)
    WHERE rank <= 5""",
)
def _(spark, d):
    return year.year_report(v.usage_events(spark, d), YEAR)["top"]


@query(
    "year_report_biggest_session",
    f"""SELECT session_id, {FIRST_TOOL}, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM usage_events
    WHERE year(epoch_ms(ts_ms)) = {YEAR} AND session_id <> '' GROUP BY session_id
    ORDER BY tokens DESC, session_id LIMIT 1""",
)
def _(spark, d):
    return year.year_report(v.usage_events(spark, d), YEAR)["biggest_session"]


# ------------------------------------------------------------------------------ sequences


def _sparse_days(spark, d) -> DataFrame:
    rows = v.usage_events(spark, d).filter("project IS NULL AND tool = 'pi' AND model IS NULL")
    return sets.active_days(rows)


@query(
    "current_streak",
    f"""WITH s AS ({SPARSE}), i AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS g FROM s),
    a AS (SELECT CASE WHEN count(*) FILTER (day = DATE '{TODAY}') > 0 THEN DATE '{TODAY}'
      WHEN count(*) FILTER (day = DATE '{TODAY}' - 1) > 0 THEN DATE '{TODAY}' - 1 END AS anchor FROM s)
    SELECT count(*) AS streak_days FROM i, a
    WHERE i.day <= anchor AND i.g = (SELECT g FROM i, a WHERE i.day = anchor)""",
)
def _(spark, d):
    return sequence.current_streak(_sparse_days(spark, d), TODAY)


@query(
    "longest_streak",
    f"""WITH s AS ({SPARSE}), i AS (SELECT year(day) AS year, day - CAST(row_number() OVER (PARTITION BY year(day) ORDER BY day) AS INTEGER) AS g FROM s)
    SELECT year, max(n) AS longest_streak_days FROM (SELECT year, g, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY year""",
)
def _(spark, d):
    return sequence.longest_streak(_sparse_days(spark, d))


H5, H36 = 18_000_000, 129_600_000


@query(
    "anchored_blocks",
    f"""WITH RECURSIVE r AS (SELECT coalesce(session_id, '') AS s, ts_ms, total_tokens FROM usage_events
      WHERE tool = 'claude-code'),
    b AS (SELECT s, min(ts_ms) AS st FROM r GROUP BY s
      UNION ALL
      SELECT b.s, (SELECT min(r.ts_ms) FROM r WHERE r.s = b.s AND r.ts_ms >= b.st + {H5}) AS st
      FROM b WHERE EXISTS (SELECT 1 FROM r WHERE r.s = b.s AND r.ts_ms >= b.st + {H5})),
    o AS (SELECT * FROM b WHERE st <= {NOW_MS} AND {NOW_MS} < st + {H5}),
    t AS (SELECT CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS window_tokens, count(*) AS window_calls, min(st) AS window_start
      FROM r JOIN o ON r.s = o.s AND r.ts_ms >= o.st AND r.ts_ms < o.st + {H5})
    SELECT window_start IS NOT NULL AS active, window_tokens, window_calls, window_start,
      window_start + {H5} AS window_ends_at FROM t""",
)
def _(spark, d):
    return sequence.anchored_blocks(v.usage_events(spark, d), NOW_MS)


@query(
    "anchored_blocks_36h",
    f"""WITH RECURSIVE r AS (SELECT coalesce(session_id, '') AS s, ts_ms, total_tokens FROM usage_events
      WHERE tool = 'claude-code' AND ts_ms >= {NOW_MS - H36}),
    b AS (SELECT s, min(ts_ms) AS st FROM r GROUP BY s
      UNION ALL
      SELECT b.s, (SELECT min(r.ts_ms) FROM r WHERE r.s = b.s AND r.ts_ms >= b.st + {H5}) AS st
      FROM b WHERE EXISTS (SELECT 1 FROM r WHERE r.s = b.s AND r.ts_ms >= b.st + {H5})),
    o AS (SELECT * FROM b WHERE st <= {NOW_MS} AND {NOW_MS} < st + {H5}),
    t AS (SELECT CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS window_tokens, count(*) AS window_calls, min(st) AS window_start
      FROM r JOIN o ON r.s = o.s AND r.ts_ms >= o.st AND r.ts_ms < o.st + {H5})
    SELECT window_start IS NOT NULL AS active, window_tokens, window_calls, window_start,
      window_start + {H5} AS window_ends_at FROM t""",
)
def _(spark, d):
    return sequence.anchored_blocks(v.usage_events(spark, d, NOW_MS - H36), NOW_MS, lookback_ms=H36)


@query(
    "session_curve",
    """SELECT ts_ms, dedup_key, model, input_tokens, cached_input, cache_write, output_tokens, total_tokens
    FROM usage_events WHERE session_id = 's3-1' AND tool = 'claude-code' ORDER BY ts_ms, dedup_key""",
)
def _(spark, d):
    return sequence.session_curve(v.usage_events(spark, d), "s3-1", "claude-code")


COUNTERS = sequence.COUNTERS
CUMULATIVE = (
    "SELECT 'h:' || user_id || ':' || k % 2 AS dedup_key, 'hermes' AS tool, ts_ms, event_id AS ord, model, session_id, project, "
    + ", ".join(
        f"CAST(sum({c}) OVER (PARTITION BY user_id, k % 2 ORDER BY ts_ms, event_id) AS BIGINT) AS {c}"
        for c in COUNTERS
    )
    + " FROM usage_rows"
)


def cumulative(spark, d) -> DataFrame:
    """Snapshots of running counters per (user, parity), as a cumulative source reports them."""
    from pyspark.sql import Window as W

    w = (
        W.partitionBy("user_id", F.col("k") % 2)
        .orderBy("ts_ms", "event_id")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    key = F.concat(
        F.lit("h:"), F.col("user_id").cast("string"), F.lit(":"), (F.col("k") % 2).cast("string")
    )
    return v.usage_rows(spark, d).select(
        key.alias("dedup_key"),
        F.lit("hermes").alias("tool"),
        "ts_ms",
        F.col("event_id").alias("ord"),
        "model",
        "session_id",
        "project",
        *[F.sum(c).over(w).alias(c) for c in COUNTERS],
    )


@query(
    "cumulative_to_daily",
    f"""WITH e AS (SELECT dedup_key AS k0, tool, {DAY} AS day, ts_ms, model, session_id, project, {', '.join(COUNTERS)},
        row_number() OVER (PARTITION BY dedup_key, {DAY} ORDER BY ts_ms DESC, ord DESC) AS rn FROM cumulative),
    b AS (SELECT k0, tool, day, ts_ms, model, session_id, project,
        {', '.join(f"{c} - coalesce(max({c}) OVER (PARTITION BY k0 ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {c}" for c in COUNTERS)}
      FROM e WHERE rn = 1),
    t AS (SELECT *, input_tokens + cached_input + cache_write + output_tokens AS total_tokens FROM b),
    n AS (SELECT *, row_number() OVER (PARTITION BY k0 ORDER BY day) AS nth FROM t WHERE total_tokens <> 0 OR reasoning_tokens <> 0)
    SELECT CASE WHEN nth = 1 THEN k0 ELSE k0 || ':' || epoch_ms(CAST(day AS TIMESTAMP)) END AS dedup_key, ts_ms, tool, model,
      session_id, project, {', '.join(COUNTERS)}, total_tokens FROM n""",
    {"cumulative": CUMULATIVE},
)
def _(spark, d):
    return sequence.cumulative_to_daily(cumulative(spark, d))


SLICE = 1_000


@query(
    "running_context",
    """SELECT dedup_key, CAST(coalesce(sum(output_tokens) OVER (PARTITION BY session_id ORDER BY ts_ms, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS context FROM usage_rows""",
)
def _(spark, d):
    rows = v.usage_rows(spark, d).withColumn("slice", F.floor(F.col("ts_ms") / 86_400_000))
    return sequence.running_context(
        rows, "output_tokens", ["session_id"], "slice", ["ts_ms", "event_id"], null_keys=True
    ).select("dedup_key", "context")


@query(
    "last_known_model",
    """SELECT dedup_key, last_value(model IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_ms, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known_model FROM usage_rows""",
)
def _(spark, d):
    rows = v.usage_rows(spark, d).withColumn("slice", F.floor(F.col("ts_ms") / 86_400_000))
    return sequence.last_known(
        rows, {"model": "known_model"}, ["session_id"], "slice", ["ts_ms", "event_id"], True
    ).select("dedup_key", "known_model")


@query(
    "asof_last_trigger",
    """SELECT dedup_key, last_value(CASE WHEN k % 4 = 0 THEN ts_ms END IGNORE NULLS) OVER (PARTITION BY user_id
      ORDER BY ts_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS trigger_ms FROM usage_rows""",
)
def _(spark, d):
    rows = (
        v.usage_rows(spark, d)
        .withColumn("slice", F.floor(F.col("ts_ms") / 86_400_000))
        .withColumn("trigger", F.when(F.col("k") % 4 == 0, F.col("ts_ms")))
    )
    return joins.asof_last(
        rows, "trigger", ["user_id"], "slice", ["ts_ms", "event_id"], "trigger_ms"
    ).select("dedup_key", "trigger_ms")


@query(
    "balance_delta",
    f"""SELECT provider, count(*) AS points, CASE WHEN count(*) >= 2 THEN
      CAST(last(CAST(balance AS DECIMAL(28,6)) ORDER BY ts_ms, event_id) - first(CAST(balance AS DECIMAL(28,6)) ORDER BY ts_ms, event_id) AS DOUBLE) END AS delta
    FROM balance_history WHERE ts_ms >= {NOW_MS - 86_400_000} GROUP BY provider""",
)
def _(spark, d):
    since = NOW_MS - 86_400_000
    return sequence.balance_delta(v.balance_history(spark, d, since), since)


# ------------------------------------------------------------------- predicates, top-k, sets


@query(
    "in_range",
    f"SELECT dedup_key, ts_ms FROM usage_events WHERE {SINCE}",
)
def _(spark, d):
    return in_range(v.usage_events(spark, d, START), DAYS, NOW_MS).select("dedup_key", "ts_ms")


@query(
    "utc_window",
    f"SELECT dedup_key, ts_ms FROM usage_events WHERE ts_ms BETWEEN {START} AND {NOW_MS}",
)
def _(spark, d):
    return utc_window(v.usage_events(spark, d, START), START, NOW_MS).select("dedup_key", "ts_ms")


@query(
    "scope_device",
    """SELECT 'events' AS frame, count(*) AS n FROM usage_events WHERE device = 'vps'
    UNION ALL SELECT 'tool_calls', count(*) FROM tool_calls WHERE device = 'vps'
    UNION ALL SELECT 'credit_usage', count(*) FROM credit_usage WHERE device = 'vps'
    UNION ALL SELECT 'files', count(*) FROM file_rows WHERE device = 'vps'
    UNION ALL SELECT 'balances', count(*) FROM balance_history""",
)
def _(spark, d):
    frames = scope_device(
        {
            "events": v.usage_events(spark, d),
            "tool_calls": v.tool_calls(spark, d),
            "credit_usage": v.credit_usage(spark, d),
            "files": v.file_rows(spark, d),
            "balances": v.balance_history(spark, d),
        },
        "vps",
    )
    counted = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("frame"), "n")
        for name, df in frames.items()
    ]
    return sets.merge_parts(*counted)


@query(
    "recent_events",
    """SELECT ts_ms, tool, model, project, device, input_tokens, cached_input, output_tokens, total_tokens, dedup_key
    FROM usage_events ORDER BY ts_ms DESC, dedup_key DESC LIMIT 15""",
)
def _(spark, d):
    return topk.recent_events(v.usage_events(spark, d))


@query(
    "merge_parts",
    f"""SELECT tool, CAST(sum(total_tokens) AS BIGINT) AS total, count(*) AS n FROM usage_events GROUP BY tool""",
)
def _(spark, d):
    rows = v.usage_events(spark, d)
    history = rows.filter(F.col("ts_ms") < TODAY_START)
    today = v.usage_events(spark, d, TODAY_START)
    return sets.merge_parts(history, today).groupBy("tool").agg(
        F.sum("total_tokens").alias("total"), F.count(F.lit(1)).alias("n")
    )


@query("active_days", f"SELECT DISTINCT {DAY} AS day FROM usage_events")
def _(spark, d):
    return sets.active_days(v.usage_events(spark, d))


@query(
    "missing_from",
    """SELECT DISTINCT session_id FROM usage_events WHERE tool = 'pi' AND session_id IS NOT NULL
      AND session_id NOT IN (SELECT session_id FROM usage_events WHERE tool = 'codex' AND session_id IS NOT NULL)
    """,
)
def _(spark, d):
    rows = v.usage_events(spark, d).filter("session_id IS NOT NULL")
    return sets.missing_from(
        rows.filter("tool = 'pi'"), rows.filter("tool = 'codex'"), ["session_id"]
    )


# ---------------------------------------------------------------------- rollup and quality

ROLL_COLS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in rollup.USAGE_COLUMNS)
ROLLUP_SQL = f"""SELECT {DAY} AS day, tool, model, device, {ROLL_COLS}, count(*) AS events, max(ts_ms) AS last_ts
    FROM usage_events GROUP BY 1, 2, 3, 4"""


@query("daily_rollup", ROLLUP_SQL)
def _(spark, d):
    return rollup.daily_rollup(v.usage_events(spark, d))


@query("merge_rollup", ROLLUP_SQL)
def _(spark, d):
    rows = v.usage_events(spark, d)
    middle = NOW_MS - 10 * 86_400_000 + 12_345
    return rollup.merge_rollup(
        rollup.daily_rollup(rows.filter(F.col("ts_ms") < middle)),
        rollup.daily_rollup(rows.filter(F.col("ts_ms") >= middle)),
    )


@query("refresh_rollup", ROLLUP_SQL)
def _(spark, d):
    rows = v.usage_events(spark, d)
    # rows of one tool arrive late: the rollup of the rest is refreshed on the touched days
    late = rows.filter(F.col("tool") == "ccmr")
    before = rollup.daily_rollup(rows.filter(F.col("tool") != "ccmr"))
    return rollup.refresh_rollup(before, rows, rollup.touched_days(late))


@query(
    "check_invariants",
    """WITH k AS (SELECT dedup_key, count(*) AS n FROM usage_arrivals GROUP BY 1)
    SELECT (SELECT count(*) FROM usage_arrivals) AS rows,
      (SELECT count(*) FROM usage_arrivals WHERE total_tokens <> input_tokens + cached_input + cache_write + output_tokens) AS wrong_totals,
      (SELECT count(*) FROM usage_arrivals WHERE least(input_tokens, cached_input, cache_write, output_tokens, reasoning_tokens, total_tokens) < 0) AS negative_rows,
      (SELECT CAST(sum(n - 1) AS BIGINT) FROM k) AS duplicate_keys""",
)
def _(spark, d):
    return rollup.check_invariants(v.usage_arrivals(spark, d))


@query(
    "prove_rollup",
    "SELECT 'x' AS dimension, 'x' AS name, CAST(0 AS BIGINT) AS tokens, 'x' AS side FROM events WHERE 1 = 0",
)
def _(spark, d):
    rows = v.usage_events(spark, d)
    return rollup.prove_rollup(rollup.daily_rollup(rows), rows)


@query(
    "non_exact_share",
    """SELECT CAST(sum(total_tokens) FILTER (tool = 'pi' AND usage_quality <> 3) AS BIGINT) AS non_exact_tokens,
      CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM usage_quality""",
)
def _(spark, d):
    return rollup.non_exact_share(v.usage_quality(spark, d), "pi")
