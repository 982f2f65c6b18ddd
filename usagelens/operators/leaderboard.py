"""Multi-user leaderboard: reports, plausibility, daily ledger, windows, board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions.names import sanitize_name
from usagelens.functions.predicates import utc_window
from usagelens.functions.times import utc_day, utc_day_offset
from usagelens.operators.rank import global_rank
from usagelens.operators.spaced import spaced


def rank_players(players: DataFrame, metric: str) -> DataFrame:
    """Position by metric (ties by id) and the number of players, over all players."""
    ranked = global_rank(players, [F.desc(metric), F.asc("id")])
    count = players.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ranked.withColumn("player_count", count)


# ---------------------------------------------------------------------------- reports


def _utc_day_start(now_ms: int) -> int:
    return now_ms // fixed.DAY_MS * fixed.DAY_MS


def build_report(events: DataFrame, now_ms: int, player: str = "player") -> DataFrame:
    """Aggregate report of each player: UTC day, 7 and 30 UTC days, model and tool shares.

    One scan folds to (player, tool, model); everything else works on those few rows.
    """
    day0 = _utc_day_start(now_ms)
    week0, month0 = day0 - 6 * fixed.DAY_MS, day0 - 29 * fixed.DAY_MS

    def tokens_since(start: int, name: str) -> Column:
        return F.sum(
            F.when(F.col("ts_ms") >= start, F.col("total_tokens")).otherwise(F.lit(0))
        ).alias(name)

    base = (
        utc_window(events, month0, now_ms)
        .groupBy(player, "tool", "model")
        .agg(
            tokens_since(day0, "day"),
            F.count(F.when(F.col("ts_ms") >= day0, 1)).alias("requests"),
            tokens_since(week0, "week"),
            F.count(F.when(F.col("ts_ms") >= week0, 1)).alias("week_rows"),
            F.sum("total_tokens").alias("month"),
        )
    )
    sums = base.groupBy(player).agg(
        F.sum("day").alias("day_tokens"),
        F.sum("requests").alias("day_requests"),
        F.sum("week").alias("week_tokens"),
        F.sum("month").alias("month_tokens"),
    )
    named = base.filter(F.col("model").isNotNull() & (F.col("model") != ""))
    models = named.groupBy(player, F.col("model").alias("name")).agg(
        *[F.sum(c).alias(c) for c in ("day", "week", "month")]
    )
    tools = (
        base.filter("week_rows > 0")
        .groupBy(player, F.col("tool").alias("name"))
        .agg(F.sum("week").alias("week"))
    )

    def top(frame: DataFrame, window: str, limit: int, out: str, positive: bool) -> DataFrame:
        rows = frame.filter(F.col(window) > 0) if positive else frame
        order = W.partitionBy(player).orderBy(F.desc(window), "name")
        entry = F.struct("rn", "name", F.col(window).alias("tokens"))
        return (
            rows.withColumn("rn", F.row_number().over(order))
            .filter(F.col("rn") <= limit)
            .groupBy(player)
            .agg(F.array_sort(F.collect_list(entry)).alias(out))
        )

    out = (
        sums.join(top(models, "week", 5, "m_week", True), player, "left")
        .join(top(models, "day", 1, "m_day", True), player, "left")
        .join(top(models, "month", 1, "m_month", True), player, "left")
        .join(top(tools, "week", 5, "t_week", False), player, "left")
    )

    def shares(column: str, total: str, limit: int) -> Column:
        whole = F.col(total)
        empty = F.expr("cast(array() as array<struct<name:string,pct:bigint>>)")
        entries = F.transform(
            F.slice(F.col(column), 1, limit),
            lambda e: F.struct(
                e["name"].alias("name"),
                F.when(whole > 0, F.floor(e["tokens"] / whole * 100 + 0.5))
                .otherwise(F.lit(0).cast("long"))
                .alias("pct"),
            ),
        )
        return F.coalesce(entries, empty)

    return out.select(
        player,
        F.lit(utc_day_offset(now_ms, 0)).alias("day"),
        "day_tokens",
        "day_requests",
        "week_tokens",
        "month_tokens",
        shares("m_week", "week_tokens", 5).alias("models"),
        F.struct(
            shares("m_day", "day_tokens", 1).alias("day"),
            shares("m_week", "week_tokens", 1).alias("week"),
            shares("m_month", "month_tokens", 1).alias("month"),
        ).alias("models_by_period"),
        shares("t_week", "week_tokens", 5).alias("tools"),
    )


def top_models_per_period(
    events: DataFrame, start_ms: int, now_ms: int, limit: int = 5
) -> DataFrame:
    """Models with positive sums in a UTC window, by tokens, then name."""
    return (
        utc_window(events, start_ms, now_ms)
        .filter(F.col("model").isNotNull() & (F.col("model") != ""))
        .groupBy("model")
        .agg(F.sum("total_tokens").alias("total"))
        .filter(F.col("total") > 0)
        .orderBy(F.desc("total"), "model")
        .limit(limit)
    )


def validate_reports(reports: DataFrame, now_ms: Column | int) -> DataFrame:
    """Add ``accepted`` and the first failing ``reason``; nothing is clamped.

    Counters are doubles; a value of a wrong type reads as NaN, an absent one as null.
    """
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    day, requests, week, month = (
        F.col(c).cast("double") for c in ("day_tokens", "day_requests", "week_tokens", "month_tokens")
    )

    def bad(c: Column, required: bool = True) -> Column:
        wrong = F.isnan(c) | (c < 0) | (c == float("inf"))
        return F.coalesce(wrong, F.lit(required))

    hours_today = F.pmod(now, F.lit(fixed.DAY_MS)) / fixed.HOUR_MS
    cap = fixed.DAY_TOKENS_LIMIT
    checks = [
        (bad(day) | bad(requests) | bad(week) | bad(month, False), fixed.REASON_NUMBERS),
        (day > cap, fixed.REASON_DAY),
        (day > fixed.HOUR_TOKENS_LIMIT * (hours_today + 1), fixed.REASON_GROWTH),
        (requests > fixed.DAY_REQUESTS_LIMIT, fixed.REASON_REQUESTS),
        ((day > 0) & (requests < 1), fixed.REASON_NO_REQUESTS),
        (
            (requests > 0) & (F.try_divide(day, requests) > fixed.TOKENS_PER_REQUEST_LIMIT),
            fixed.REASON_PER_REQUEST,
        ),
        ((week < day) | (month < week), fixed.REASON_WINDOWS),
        ((week > 7 * cap) | (month > 30 * cap), fixed.REASON_TOTALS),
    ]
    reason = None
    for failed, text in checks:
        reason = (F if reason is None else reason).when(failed, F.lit(text))
    return reports.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def throttle(reports: DataFrame, gap_ms: int = fixed.THROTTLE_MS) -> DataFrame:
    """At most one report per id and gap: the first, then the first one a gap or more after the last kept one.

    Of reports at one instant the one of smallest ``ord`` counts. An id with very many reports spreads over time slices.
    """
    times = reports.groupBy("id", "received_ms").agg(F.min("ord").alias("ord"))
    kept = spaced(times, ["id"], "received_ms", gap_ms).join(times, ["id", "received_ms"])
    return reports.join(kept.select("id", "ord"), ["id", "ord"], "left_semi")


def accept_reports(reports: DataFrame, banned: DataFrame, gap_ms: int = fixed.THROTTLE_MS) -> DataFrame:
    """Reports that count: version 1, UUIDv4 id, not banned, plausible, of the current UTC day,
    not too soon after the last one. Blank or bad names become anonymous."""
    now = F.col("received_ms")
    wellformed = reports.filter((F.col("v") == 1) & F.col("id").rlike(fixed.UUID4_PATTERN))
    allowed = wellformed.join(banned.select("id"), "id", "left_anti")
    plausible = validate_reports(allowed, now).filter("accepted").drop("accepted", "reason")
    current = plausible.filter(F.col("day") == utc_day(now).cast("string"))
    name = F.coalesce(
        sanitize_name(F.coalesce("name", F.lit(""))),
        F.concat(F.lit(fixed.ANONYMOUS_PREFIX), F.substring("id", 1, 4)),
    )
    return throttle(current, gap_ms).withColumn("name", name)


def merge_daily(daily: DataFrame, accepted: DataFrame) -> DataFrame:
    """Last reported tokens per (id, day); the value may fall. Of reports at one instant the largest counts."""
    new = accepted.select(
        "id", "day", F.col("day_tokens").cast("long").alias("tokens"), F.col("received_ms").alias("updated_at")
    )
    return (
        daily.select("id", "day", "tokens", "updated_at")
        .unionByName(new)
        .groupBy("id", "day")
        .agg(F.max(F.struct("updated_at", "tokens")).alias("last"))
        .select("id", "day", "last.tokens", "last.updated_at")
    )


def server_windows(daily: DataFrame, day: str) -> DataFrame:
    """7- and 30-day sums over the days the server has seen; client totals do not count."""
    anchor = F.lit(day).cast("date")
    d = F.col("day").cast("date")
    return (
        daily.filter(d >= F.date_sub(anchor, 29))
        .groupBy("id")
        .agg(
            F.coalesce(F.sum(F.when(d >= F.date_sub(anchor, 6), F.col("tokens"))), F.lit(0)).alias(
                "week_tokens"
            ),
            F.sum("tokens").alias("month_tokens"),
        )
    )


# ------------------------------------------------------------------------------ board

_METRIC_OF = {"day": "day_tokens", "week": "week_tokens", "month": "month_tokens"}


def leaderboard(
    players: DataFrame, period: str, metric: str, now_ms: int, me: str | None = None
) -> DataFrame:
    """Top 50 by the period's metric plus the own row; ids stay private.

    The top rows come from a distributed top-k, the own position from a count of better rows,
    so no task ever sees all players.
    """
    column = "roi_ratio" if metric == "roi" else _METRIC_OF.get(period, "day_tokens")
    fresh = (F.col("updated_at") > now_ms - fixed.FRESH_MS) & (F.col(column) > 0)
    if period not in ("week", "month"):
        fresh = fresh & (F.col("day") == utc_day_offset(now_ms, 0))
    valid = players.filter(fresh)
    top = valid.orderBy(F.desc(column), "id").limit(fixed.BOARD_ROWS)
    # at most 50 rows reach this window
    board = top.withColumn(
        "position", F.row_number().over(W.orderBy(F.desc(column), "id")).cast("long")
    )
    own = me or ""
    mine = valid.filter(F.col("id") == own)
    my_value = mine.agg(F.max(column).alias("mine")).scalar()
    ahead = (F.col(column) > my_value) | ((F.col(column) == my_value) & (F.col("id") < own))
    my_position = valid.filter(ahead).agg((F.count(F.lit(1)) + 1).alias("p")).scalar()
    tail = mine.withColumn("position", my_position.cast("long")).filter(
        F.col("position") > fixed.BOARD_ROWS
    )
    count = valid.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        board.unionByName(tail)
        .withColumn("is_me", F.col("id") == own)
        .withColumn("player_count", count)
        .drop("id")
    )


def expire_players(
    players: DataFrame, daily: DataFrame, now_ms: int
) -> tuple[DataFrame, DataFrame]:
    """Players idle for 30 days leave; so do daily rows that are old or without a player."""
    kept = players.filter(F.col("updated_at") >= now_ms - fixed.RETAIN_MS)
    recent = daily.filter(F.col("day") >= utc_day_offset(now_ms, -30))
    return kept, recent.join(kept.select("id"), "id", "left_semi")


def purge_implausible(players: DataFrame, daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove stored players that today's rules reject; re-seed windows from the latest day."""
    day, requests = F.col("day_tokens"), F.col("day_requests")
    reject = (
        (day > fixed.DAY_TOKENS_LIMIT)
        | (requests > fixed.DAY_REQUESTS_LIMIT)
        | ((day > 0) & (requests < 1))
        | ((requests > 0) & (F.try_divide(day, requests) > fixed.TOKENS_PER_REQUEST_LIMIT))
    )
    kept = players.filter(~F.coalesce(reject, F.lit(False)))
    seeds = kept.filter(F.col("day").isNotNull() & (day > 0)).select(
        "id", "day", day.alias("tokens"), "updated_at"
    )
    known = daily.select("id", "day")
    reseeded = daily.select("id", "day", "tokens", "updated_at").unionByName(
        seeds.join(known, ["id", "day"], "left_anti")
    )
    return kept.withColumn("week_tokens", day).withColumn("month_tokens", day), reseeded


def ban(players: DataFrame, daily: DataFrame, banned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Players and daily rows without the banned ids."""
    ids = banned.select("id")
    return players.join(ids, "id", "left_anti"), daily.join(ids, "id", "left_anti")


def find_player(players: DataFrame, name: str) -> DataFrame:
    return players.filter(F.col("name") == name).orderBy(F.desc("updated_at"), "id")


def top_players(players: DataFrame, period: str = "day", limit: int | None = None) -> DataFrame:
    """Players in order of a period's tokens, all of them unless a limit is given."""
    if period not in _METRIC_OF:
        raise ValueError("period must be day, week or month")
    ranked = players.orderBy(F.desc(_METRIC_OF[period]), "id")
    return ranked if limit is None else ranked.limit(limit)
