"""Queries: player reports, plausibility, ledger, board, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions.times import local_day_start
from usagelens.operators import alerts, dedup, leaderboard
from usagelens.operators.skew import literal_table
from usagelens.plans import views as v
from usagelens.plans.registry import query
from usagelens.plans.views import NOW_MS
from usagelens.sources import reports

DAY0 = NOW_MS // fixed.DAY_MS * fixed.DAY_MS
WEEK0, MONTH0 = DAY0 - 6 * fixed.DAY_MS, DAY0 - 29 * fixed.DAY_MS
TODAY = "2024-01-30"


def _share_text(column: str):
    return F.array_join(
        F.transform(column, lambda s: F.concat(s["name"], F.lit(":"), s["pct"].cast("string"))), ","
    )


REPORT_SQL = f"""
    WITH r AS (SELECT user_id, tool, model, ts_ms, total_tokens FROM usage_rows WHERE ts_ms BETWEEN {MONTH0} AND {NOW_MS}),
    s AS (SELECT user_id, coalesce(sum(total_tokens) FILTER (ts_ms >= {DAY0}), 0) AS dt, count(*) FILTER (ts_ms >= {DAY0}) AS dr,
        coalesce(sum(total_tokens) FILTER (ts_ms >= {WEEK0}), 0) AS wt, sum(total_tokens) AS mt FROM r GROUP BY 1),
    m AS (SELECT user_id, model AS name, coalesce(sum(total_tokens) FILTER (ts_ms >= {DAY0}), 0) AS d,
        coalesce(sum(total_tokens) FILTER (ts_ms >= {WEEK0}), 0) AS w, sum(total_tokens) AS mo FROM r WHERE model <> '' GROUP BY 1, 2),
    t AS (SELECT user_id, tool AS name, sum(total_tokens) AS w FROM r WHERE ts_ms >= {WEEK0} GROUP BY 1, 2),
    mw AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, name) AS rn FROM m WHERE w > 0),
    md AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d DESC, name) AS rn FROM m WHERE d > 0),
    mm AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mo DESC, name) AS rn FROM m WHERE mo > 0),
    tw AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, name) AS rn FROM t)
    SELECT s.user_id AS player, '{TODAY}' AS day, CAST(dt AS BIGINT) AS day_tokens, dr AS day_requests, CAST(wt AS BIGINT) AS week_tokens, CAST(mt AS BIGINT) AS month_tokens,
      coalesce((SELECT string_agg(name || ':' || CAST(floor(w / wt * 100 + 0.5) AS BIGINT), ',' ORDER BY rn) FROM mw WHERE mw.user_id = s.user_id AND rn <= 5), '') AS models,
      coalesce((SELECT string_agg(name || ':' || CAST(floor(d / dt * 100 + 0.5) AS BIGINT), ',') FROM md WHERE md.user_id = s.user_id AND rn = 1), '') AS day_model,
      coalesce((SELECT string_agg(name || ':' || CAST(floor(mo / mt * 100 + 0.5) AS BIGINT), ',') FROM mm WHERE mm.user_id = s.user_id AND rn = 1), '') AS month_model,
      coalesce((SELECT string_agg(name || ':' || CAST(floor(w / wt * 100 + 0.5) AS BIGINT), ',' ORDER BY rn) FROM tw WHERE tw.user_id = s.user_id AND rn <= 5), '') AS tools
    FROM s"""


@query("build_report", REPORT_SQL)
def _(spark, d):
    rows = v.usage_rows(spark, d, MONTH0).withColumn("player", F.col("user_id"))
    out = leaderboard.build_report(rows, NOW_MS)
    return out.select(
        "player", "day", "day_tokens", "day_requests", "week_tokens", "month_tokens",
        _share_text("models").alias("models"),
        _share_text("models_by_period.day").alias("day_model"),
        _share_text("models_by_period.month").alias("month_model"),
        _share_text("tools").alias("tools"),
    )


@query(
    "top_models_per_period",
    f"""SELECT model, CAST(sum(total_tokens) AS BIGINT) AS total FROM usage_events WHERE ts_ms BETWEEN {WEEK0} AND {NOW_MS} AND model <> ''
    GROUP BY model HAVING sum(total_tokens) > 0 ORDER BY total DESC, model LIMIT 5""",
)
def _(spark, d):
    return leaderboard.top_models_per_period(v.usage_events(spark, d, WEEK0), WEEK0, NOW_MS)


# one upload per event: counters grow with the event, some are implausible or malformed
UPLOADS = f"""
    SELECT user_id, event_id AS ord, ts_ms AS received_ms, CASE WHEN k % 40 = 1 THEN 2 ELSE 1 END AS ver,
      substr(md5(CAST(user_id AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(user_id AS VARCHAR)), 9, 4) || '-4' || substr(md5(CAST(user_id AS VARCHAR)), 14, 3)
        || '-8' || substr(md5(CAST(user_id AS VARCHAR)), 18, 3) || '-' || substr(md5(CAST(user_id AS VARCHAR)), 21, 12) AS id,
      CASE WHEN k % 6 = 0 THEN '' WHEN k % 6 = 1 THEN 'spam king' ELSE 'user ' || user_id END AS name,
      CASE WHEN k % 50 = 3 THEN '2023-12-31' ELSE strftime(epoch_ms(ts_ms), '%Y-%m-%d') END AS day,
      CAST(total_tokens * CASE WHEN k % 11 = 0 THEN 100000 WHEN k % 11 = 1 THEN -1 ELSE 1000 END AS DOUBLE) AS day_tokens,
      CAST(CASE WHEN k % 13 = 0 THEN 0 WHEN k % 13 = 1 THEN 300000 ELSE 50 + k END AS DOUBLE) AS day_requests,
      CAST(total_tokens * CASE WHEN k % 17 = 0 THEN 10 WHEN k % 11 = 0 THEN 400000 ELSE 5000 END AS DOUBLE) AS week_tokens,
      CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(total_tokens * CASE WHEN k % 11 = 0 THEN 1600000 ELSE 20000 END AS DOUBLE) END AS month_tokens
    FROM usage_rows"""


def uploads(spark, d) -> DataFrame:
    r = v.usage_rows(spark, d)
    k, total = F.col("k"), F.col("total_tokens")
    return r.select(
        "user_id",
        F.col("event_id").alias("ord"),
        F.col("ts_ms").alias("received_ms"),
        F.when(k % 40 == 1, 2).otherwise(1).alias("v"),
        v.uuid_of(F.col("user_id")).alias("id"),
        F.when(k % 6 == 0, "").when(k % 6 == 1, "spam king").otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("name"),
        F.when(k % 50 == 3, "2023-12-31")
        .otherwise(F.date_from_unix_date(F.floor(F.col("ts_ms") / fixed.DAY_MS).cast("int")).cast("string"))
        .alias("day"),
        (total * F.when(k % 11 == 0, 100000).when(k % 11 == 1, -1).otherwise(1000)).cast("double").alias("day_tokens"),
        F.when(k % 13 == 0, 0).when(k % 13 == 1, 300000).otherwise(50 + k).cast("double").alias("day_requests"),
        (total * F.when(k % 17 == 0, 10).when(k % 11 == 0, 400000).otherwise(5000)).cast("double").alias("week_tokens"),
        F.when(k % 7 != 0, (total * F.when(k % 11 == 0, 1600000).otherwise(20000)).cast("double")).alias("month_tokens"),
    )


REASON = f"""CASE WHEN day_tokens < 0 OR day_requests < 0 OR week_tokens < 0 OR month_tokens < 0 THEN '{fixed.REASON_NUMBERS}'
    WHEN day_tokens > 2e10 THEN '{fixed.REASON_DAY}' WHEN day_tokens > 5e9 * ((received_ms % 86400000) / 3600000 + 1) THEN '{fixed.REASON_GROWTH}'
    WHEN day_requests > 200000 THEN '{fixed.REASON_REQUESTS}' WHEN day_tokens > 0 AND day_requests < 1 THEN '{fixed.REASON_NO_REQUESTS}'
    WHEN day_requests > 0 AND day_tokens / day_requests > 5e6 THEN '{fixed.REASON_PER_REQUEST}'
    WHEN week_tokens < day_tokens OR month_tokens < week_tokens THEN '{fixed.REASON_WINDOWS}'
    WHEN week_tokens > 1.4e11 OR month_tokens > 6e11 THEN '{fixed.REASON_TOTALS}' END"""


@query(
    "validate_reports",
    f"SELECT ord, reason, reason IS NULL AS accepted FROM (SELECT ord, {REASON} AS reason FROM uploads)",
    {"uploads": UPLOADS},
)
def _(spark, d):
    return leaderboard.validate_reports(uploads(spark, d), F.col("received_ms")).select(
        "ord", "reason", "accepted"
    )


GAP = 6 * fixed.HOUR_MS
BANNED_USERS = "user_id % 10 = 0"
ACCEPTED = f"""
    SELECT u.*, row_number() OVER (PARTITION BY id ORDER BY received_ms, ord) AS rn FROM uploads u
    WHERE ver = 1 AND NOT ({BANNED_USERS}) AND {REASON} IS NULL AND day = strftime(epoch_ms(received_ms), '%Y-%m-%d')"""


def accepted(spark, d) -> DataFrame:
    rows = uploads(spark, d)
    banned = rows.filter(BANNED_USERS).select("id").distinct()
    return leaderboard.accept_reports(rows, banned, GAP)


@query(
    "accept_reports",
    f"""WITH RECURSIVE g AS (SELECT id, ord, received_ms FROM candidates WHERE rn = 1
      UNION ALL
      SELECT c.id, c.ord, c.received_ms FROM g JOIN candidates c ON c.id = g.id
        AND c.rn = (SELECT min(x.rn) FROM candidates x WHERE x.id = g.id AND x.received_ms >= g.received_ms + {GAP}))
    SELECT c.id, c.ord, CASE WHEN name = '' OR name = 'spam king' THEN '匿名-' || substr(c.id, 1, 4) ELSE name END AS name, c.day_tokens
    FROM g JOIN candidates c ON c.id = g.id AND c.ord = g.ord""",
    {"uploads": UPLOADS, "candidates": ACCEPTED},
)
def _(spark, d):
    return accepted(spark, d).select("id", "ord", "name", "day_tokens")


@query(
    "merge_daily",
    """SELECT id, day, CAST(first(day_tokens ORDER BY received_ms DESC) AS BIGINT) AS tokens, max(received_ms) AS updated_at FROM uploads GROUP BY id, day""",
    {"uploads": UPLOADS},
)
def _(spark, d):
    rows = uploads(spark, d)
    early = rows.filter("received_ms < 1705600000000").select(
        "id", "day", F.col("day_tokens").cast("long").alias("tokens"), F.col("received_ms").alias("updated_at")
    )
    return leaderboard.merge_daily(early, rows.filter("received_ms >= 1705600000000"))


def _daily(spark, d) -> DataFrame:
    return v.player_days(spark, d).select(
        "user_id", "id", "day", F.col("day_tokens").alias("tokens"), F.col("at_ms").alias("updated_at")
    )


WINDOWS = f"""SELECT id, CAST(coalesce(sum(day_tokens) FILTER (day >= '2024-01-24'), 0) AS BIGINT) AS week_tokens, CAST(sum(day_tokens) AS BIGINT) AS month_tokens
    FROM player_days WHERE day >= '2024-01-01' GROUP BY id"""


@query("server_windows", WINDOWS)
def _(spark, d):
    return leaderboard.server_windows(_daily(spark, d), TODAY)


PLAYERS = """
    SELECT p.id, 'n' || p.user_id AS name, p.day, p.day_tokens, p.day_requests, w.week_tokens, w.month_tokens,
      CASE WHEN p.user_id % 6 = 0 THEN NULL ELSE (p.user_id % 37) / 4 END AS roi_ratio, p.at_ms AS updated_at
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM player_days) p JOIN windows w USING (id) WHERE rn = 1"""
PLAYER_VIEWS = {"windows": WINDOWS, "players": PLAYERS}


def players(spark, d) -> DataFrame:
    days = v.player_days(spark, d)
    latest = days.groupBy("user_id", "id").agg(
        F.max_by(F.struct("day", "day_tokens", "day_requests", F.col("at_ms").alias("updated_at")), "day").alias("l")
    )
    windows = leaderboard.server_windows(_daily(spark, d), TODAY)
    roi = F.when(F.col("user_id") % 6 != 0, (F.col("user_id") % 37) / 4)
    return latest.join(windows, "id").select(
        "id",
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("name"),
        "l.day",
        "l.day_tokens",
        "l.day_requests",
        "week_tokens",
        "month_tokens",
        roi.alias("roi_ratio"),
        "l.updated_at",
    )


@query(
    "rank_players",
    """SELECT id, row_number() OVER (ORDER BY month_tokens DESC, id) AS position, count(*) OVER () AS player_count FROM players""",
    PLAYER_VIEWS,
)
def _(spark, d):
    return leaderboard.rank_players(players(spark, d), "month_tokens").select(
        "id", "position", "player_count"
    )


# the requesting player: user 11 of the table
ME = "6512bd43-d9ca-46e0-8c99-0b0a82652dca"


def _board_sql(metric: str, extra: str = "") -> str:
    return f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY {metric} DESC, id) AS position, count(*) OVER () AS player_count FROM players
      WHERE updated_at > {NOW_MS - fixed.FRESH_MS} AND {metric} > 0 {extra})
    SELECT name, day, day_tokens, day_requests, week_tokens, month_tokens, roi_ratio, updated_at, position, id = '{ME}' AS is_me, player_count FROM r
    WHERE position <= 50 OR id = '{ME}'"""


@query("leaderboard_day", _board_sql("day_tokens", f"AND day = '{TODAY}'"), PLAYER_VIEWS)
def _(spark, d):
    return leaderboard.leaderboard(players(spark, d), "day", "tokens", NOW_MS, ME)


@query("leaderboard_month", _board_sql("month_tokens"), PLAYER_VIEWS)
def _(spark, d):
    return leaderboard.leaderboard(players(spark, d), "month", "tokens", NOW_MS, ME)


@query("leaderboard_roi", _board_sql("roi_ratio"), PLAYER_VIEWS)
def _(spark, d):
    return leaderboard.leaderboard(players(spark, d), "week", "roi", NOW_MS, ME)


LATER = NOW_MS + 29 * fixed.DAY_MS + 20 * fixed.HOUR_MS


@query(
    "expire_players",
    f"SELECT id, updated_at FROM players WHERE updated_at >= {LATER - fixed.RETAIN_MS}",
    PLAYER_VIEWS,
)
def _(spark, d):
    kept, _daily_rows = leaderboard.expire_players(players(spark, d), _daily(spark, d), LATER)
    return kept.select("id", "updated_at")


@query(
    "expire_daily",
    f"""SELECT id, day, day_tokens AS tokens FROM player_days WHERE day >= strftime(epoch_ms(CAST({LATER - 30 * fixed.DAY_MS} AS BIGINT)), '%Y-%m-%d')
      AND id IN (SELECT id FROM players WHERE updated_at >= {LATER - fixed.RETAIN_MS})""",
    PLAYER_VIEWS,
)
def _(spark, d):
    return leaderboard.expire_players(players(spark, d), _daily(spark, d), LATER)[1].select(
        "id", "day", "tokens"
    )


# stored players inflated by user, so that some break the present rules
INFLATED = """SELECT * REPLACE (day_tokens * CASE WHEN roi_ratio > 8 THEN 100000 ELSE 1 END AS day_tokens,
    CASE WHEN roi_ratio = 2 THEN 0 ELSE day_requests END AS day_requests) FROM players"""


def _inflated(spark, d) -> DataFrame:
    p = players(spark, d)
    return p.withColumn(
        "day_tokens", F.col("day_tokens") * F.when(F.col("roi_ratio") > 8, 100000).otherwise(1)
    ).withColumn("day_requests", F.when(F.col("roi_ratio") == 2, 0).otherwise(F.col("day_requests")))


KEPT = """day_tokens <= 20000000000 AND day_requests <= 200000 AND NOT (day_tokens > 0 AND day_requests < 1)
    AND NOT (day_requests > 0 AND day_tokens / day_requests > 5000000)"""


@query(
    "purge_implausible",
    f"SELECT id, day_tokens, day_tokens AS week_tokens, day_tokens AS month_tokens FROM inflated WHERE {KEPT}",
    {**PLAYER_VIEWS, "inflated": INFLATED},
)
def _(spark, d):
    daily = _daily(spark, d).filter("day < '2024-01-15'")
    return leaderboard.purge_implausible(_inflated(spark, d), daily)[0].select(
        "id", "day_tokens", "week_tokens", "month_tokens"
    )


@query(
    "purge_reseeded_daily",
    f"""SELECT id, day, day_tokens AS tokens FROM player_days WHERE day < '2024-01-15'
    UNION ALL SELECT id, day, day_tokens FROM inflated WHERE {KEPT} AND day_tokens > 0 AND day >= '2024-01-15'""",
    {**PLAYER_VIEWS, "inflated": INFLATED},
)
def _(spark, d):
    daily = _daily(spark, d).filter("day < '2024-01-15'")
    return leaderboard.purge_implausible(_inflated(spark, d), daily)[1].select("id", "day", "tokens")


@query(
    "ban_players",
    """SELECT id FROM players WHERE id NOT IN (SELECT DISTINCT id FROM player_days WHERE user_id % 10 = 0)""",
    PLAYER_VIEWS,
)
def _(spark, d):
    banned = v.player_days(spark, d).filter("user_id % 10 = 0").select("id").distinct()
    return leaderboard.ban(players(spark, d), _daily(spark, d), banned)[0].select("id")


@query("find_player", "SELECT id, name, day_tokens FROM players WHERE name = 'n11'", PLAYER_VIEWS)
def _(spark, d):
    return leaderboard.find_player(players(spark, d), "n11").select("id", "name", "day_tokens")


@query(
    "top_players",
    "SELECT id, week_tokens FROM players ORDER BY week_tokens DESC, id LIMIT 20",
    PLAYER_VIEWS,
)
def _(spark, d):
    return leaderboard.top_players(players(spark, d), "week", 20).select("id", "week_tokens")


# ------------------------------------------------------------------------ uploaded bodies


def _bodies(spark, d) -> DataFrame:
    """Uploads as JSON text, with share lists as arrays of [name, value] pairs."""
    u = uploads(spark, d)
    pair_a = F.concat(F.lit('["'), F.lit("Model-"), F.col("user_id").cast("string"), F.lit('",'), F.col("day_requests").cast("string"), F.lit("]"))
    pairs = F.concat(
        F.lit("["), pair_a, F.lit(',["www.x.com",5],[7,7],["glm/'), F.col("user_id").cast("string"), F.lit('","33.5"]]')
    )
    body = F.concat(
        F.regexp_replace(
            F.to_json(F.struct("v", "id", "name", "day", "day_tokens", "day_requests", "week_tokens", "month_tokens")), "[}]$", ""
        ),
        F.lit(',"roi_ratio":'),
        F.when(F.col("user_id") % 4 == 0, "null").otherwise((F.col("user_id") / 7).cast("string")),
        F.lit(',"models":'),
        pairs,
        F.lit(',"models_by_period":{"week":'),
        pairs,
        F.lit("}}"),
    )
    return u.select(body.alias("value"), "received_ms", "ord")


@query(
    "read_player_reports",
    "SELECT ord, id, day, day_tokens, month_tokens FROM uploads WHERE ver = 1",
    {"uploads": UPLOADS},
)
def _(spark, d):
    return reports.read_player_reports(_bodies(spark, d)).select(
        "ord", "id", "day", "day_tokens", "month_tokens"
    )


@query(
    "rejected_reports",
    """SELECT ord, received_ms, CASE WHEN user_id % 9 = 1 THEN 'too large' WHEN user_id % 9 = 2 THEN 'malformed' WHEN ver <> 1 THEN 'version' ELSE 'id' END AS reason
    FROM uploads WHERE user_id % 9 IN (1, 2, 3) OR ver <> 1""",
    {"uploads": UPLOADS},
)
def _(spark, d):
    user = F.col("user_id")
    broken = (
        F.when(user % 9 == 1, F.rpad("value", fixed.REPORT_MAX_BYTES + 1, " "))
        .when(user % 9 == 2, F.expr("left(value, length(value) - 2)"))
        .when(user % 9 == 3, F.regexp_replace("value", '"id":"[^"]*"', '"id":"someone"'))
        .otherwise(F.col("value"))
    )
    users = uploads(spark, d).select("ord", "user_id")
    bodies = _bodies(spark, d).join(users, "ord").withColumn("value", broken)
    return reports.rejected_reports(bodies).select("ord", "received_ms", "reason")


@query(
    "clamp_report",
    """SELECT ord, CAST(greatest(0, least(1e12, day_tokens)) AS BIGINT) AS day_tokens, CAST(day_requests AS BIGINT) AS day_requests,
      CAST(least(1e13, week_tokens) AS BIGINT) AS week_tokens, CAST(month_tokens AS BIGINT) AS month_tokens,
      CASE WHEN user_id % 4 = 0 THEN NULL ELSE floor(user_id / 7 * 10 + 0.5) / 10 END AS roi_ratio,
      'Model-' || user_id || ':' || CAST(least(100, day_requests) AS BIGINT) || ',glm/' || user_id || ':34' AS models,
      'Model-' || user_id || ':' || CAST(least(100, day_requests) AS BIGINT) AS week_model
    FROM uploads WHERE ver = 1""",
    {"uploads": UPLOADS},
)
def _(spark, d):
    c = reports.read_player_reports(_bodies(spark, d)).select("ord", "clamped.*")
    return c.select(
        "ord", "day_tokens", "day_requests", "week_tokens", "month_tokens", "roi_ratio",
        _share_text("models").alias("models"),
        _share_text("models_by_period.week").alias("week_model"),
    )


# -------------------------------------------------------------------------------- alerts

H5 = 5 * fixed.HOUR_MS
VALUES_SQL = f"""
    SELECT 'codex_quota_pct' AS metric, NULL AS suffix, NULL AS provider, CAST(max(k) AS DOUBLE) AS value, NULL AS currency FROM usage_rows WHERE tool = 'codex' AND ts_ms >= {NOW_MS - H5}
    UNION ALL SELECT 'balance', provider || ' id', provider, first(balance ORDER BY ts_ms DESC, event_id), 'CNY' FROM balance_history GROUP BY provider
    UNION ALL SELECT 'today_tokens', NULL, NULL, CAST(sum(total_tokens) AS DOUBLE), NULL FROM usage_rows WHERE ts_ms >= {local_day_start(NOW_MS)}
    UNION ALL SELECT 'claude_5h_tokens', NULL, NULL, CAST(sum(total_tokens) AS DOUBLE), NULL FROM usage_rows WHERE tool = 'claude-code' AND ts_ms >= {NOW_MS - H5}"""


def alert_values(spark, d) -> DataFrame:
    recent = v.usage_rows(spark, d, NOW_MS - H5)
    quota = recent.filter("tool = 'codex'").groupBy("event_type").agg(F.max("k").alias("used_percent"))
    newest = dedup.latest_snapshot(v.balance_history(spark, d), ["provider"], "event_id")
    balances = newest.select(
        "provider", F.concat(F.col("provider"), F.lit(" id")).alias("id"), "balance", F.lit("CNY").alias("currency")
    )
    today = v.usage_rows(spark, d, local_day_start(NOW_MS)).agg(F.sum("total_tokens").alias("today_tokens"))
    block = recent.filter("tool = 'claude-code'").agg(
        F.sum("total_tokens").alias("window_tokens"), (F.count(F.lit(1)) > 0).alias("active")
    )
    return alerts.metric_values(quota, balances, today, block)


@query("metric_values", VALUES_SQL)
def _(spark, d):
    return alert_values(spark, d)


RULES = [
    ("codex_quota_pct", "codex_quota_pct", True, 80.0, 95.0, None),
    ("balance", "balance", True, 1000.0, 2.0, None),
    ("kimi low", "balance", True, 500.0, 400.0, "kimi"),
    ("today_tokens", "today_tokens", True, 1000.0, None, None),
    ("off", "today_tokens", False, 1.0, None, None),
    ("claude_5h_tokens", "claude_5h_tokens", True, None, 1000.0, None),
]


@query(
    "evaluate_alerts",
    """WITH rules AS (SELECT * FROM (VALUES ('codex_quota_pct', 'codex_quota_pct', 80, 95, NULL), ('balance', 'balance', 1000, 2, NULL), ('kimi low', 'balance', 500, 400, 'kimi'),
        ('today_tokens', 'today_tokens', 1000, NULL, NULL), ('claude_5h_tokens', 'claude_5h_tokens', NULL, 1000, NULL)) r(rule_id, metric, warn, crit, only_provider)),
    j AS (SELECT *, CASE WHEN CASE WHEN metric = 'balance' THEN value < crit ELSE value >= crit END THEN 'crit'
        WHEN CASE WHEN metric = 'balance' THEN value < warn ELSE value >= warn END THEN 'warn' END AS level
      FROM metric_values_v JOIN rules USING (metric) WHERE only_provider IS NULL OR only_provider = provider OR only_provider = suffix)
    SELECT metric || coalesce(':' || replace(suffix, ' ', '%20'), '') || CASE WHEN rule_id <> metric THEN ':rule:' || replace(rule_id, ' ', '%20') ELSE '' END AS key,
      rule_id, metric, level, value, CAST(CASE level WHEN 'crit' THEN crit ELSE warn END AS DOUBLE) AS threshold FROM j WHERE level IS NOT NULL""",
    {"metric_values_v": VALUES_SQL},
)
def _(spark, d):
    return alerts.evaluate_alerts(
        alert_values(spark, d), literal_table(spark, RULES, alerts.RULE_SCHEMA)
    )


@query(
    "validate_rules",
    """WITH r AS (SELECT event_id AS pos, CASE WHEN k % 9 = 0 THEN ' ' WHEN k % 9 = 1 THEN 'dup' || user_id ELSE 'r' || event_id END AS id,
        CASE k % 5 WHEN 0 THEN 'balance' WHEN 1 THEN 'codex_quota_pct' WHEN 2 THEN 'today_tokens' WHEN 3 THEN 'claude_5h_tokens' ELSE 'other' END AS metric,
        CASE WHEN k % 8 = 0 THEN NULL ELSE k % 2 = 0 END AS enabled, CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k * 2 - 10 AS DOUBLE) END AS warn,
        CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(v % 120 AS DOUBLE) END AS crit, CASE WHEN k % 10 = 7 THEN 'kimi' END AS provider FROM usage_rows),
    f AS (SELECT *, min(pos) OVER (PARTITION BY id) AS first_pos FROM r),
    e AS (
      SELECT pos, 'id must not be blank' AS error FROM f WHERE trim(id) = ''
      UNION ALL SELECT pos, 'duplicate id' FROM f WHERE trim(id) <> '' AND pos > first_pos
      UNION ALL SELECT pos, 'unknown metric' FROM f WHERE metric = 'other'
      UNION ALL SELECT pos, 'enabled must be boolean' FROM f WHERE enabled IS NULL
      UNION ALL SELECT pos, 'provider only fits balance' FROM f WHERE provider IS NOT NULL AND metric <> 'balance'
      UNION ALL SELECT pos, 'warn out of range' FROM f WHERE warn < 0 OR (metric = 'codex_quota_pct' AND warn > 100)
      UNION ALL SELECT pos, 'crit out of range' FROM f WHERE crit < 0 OR (metric = 'codex_quota_pct' AND crit > 100)
      UNION ALL SELECT pos, 'enabled rule without threshold' FROM f WHERE enabled AND warn IS NULL AND crit IS NULL
      UNION ALL SELECT pos, 'thresholds in wrong order' FROM f WHERE CASE WHEN metric = 'balance' THEN warn < crit ELSE warn > crit END)
    SELECT pos, error FROM e""",
)
def _(spark, d):
    k = F.col("k")
    metric = F.when(k % 5 == 0, "balance").when(k % 5 == 1, "codex_quota_pct").when(k % 5 == 2, "today_tokens")
    rules = v.usage_rows(spark, d).select(
        F.col("event_id").alias("pos"),
        F.when(k % 9 == 0, " ")
        .when(k % 9 == 1, F.concat(F.lit("dup"), F.col("user_id").cast("string")))
        .otherwise(F.concat(F.lit("r"), F.col("event_id").cast("string")))
        .alias("id"),
        metric.when(k % 5 == 3, "claude_5h_tokens").otherwise("other").alias("metric"),
        F.when(k % 8 != 0, k % 2 == 0).alias("enabled"),
        F.when(k % 3 != 0, (k * 2 - 10).cast("double")).alias("warn"),
        F.when(k % 4 != 0, (F.col("v") % 120).cast("double")).alias("crit"),
        F.when(k % 10 == 7, "kimi").alias("provider"),
    )
    return alerts.validate_rules(rules)
