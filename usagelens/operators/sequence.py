"""Sequence analytics: streaks, anchored blocks, session curves, cumulative counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions.predicates import since
from usagelens.functions.times import day_start_ms, local_day
from usagelens.operators.skew import running, salted_join
from usagelens.operators.spaced import spaced
from usagelens.schema import BILLED_COLUMNS


def current_streak(days: DataFrame, today: str) -> DataFrame:
    """Consecutive active days ending today, or yesterday when today has none; one row.

    ``days`` holds distinct calendar days. The run that holds the anchor starts at the latest
    day, not after the anchor, whose predecessor is missing.
    """
    t = F.lit(today).cast("date")
    follows = days.select(F.date_add("day", 1).alias("day"), F.lit(True).alias("follows"))
    marked = days.join(follows, "day", "left")
    anchored = F.max(F.when(F.col("day") == t, t)), F.max(
        F.when(F.col("day") == F.date_sub(t, 1), F.date_sub(t, 1))
    )
    starts_run = F.col("follows").isNull() & (F.col("day") <= t)
    return marked.agg(
        F.coalesce(*anchored).alias("anchor"),
        F.max(F.when(starts_run & (F.col("day") < t), F.col("day"))).alias("start_before"),
        F.max(F.when(starts_run, F.col("day"))).alias("start_upto"),
    ).select(
        F.when(
            F.col("anchor").isNotNull(),
            F.datediff(
                "anchor", F.when(F.col("anchor") == t, F.col("start_upto")).otherwise(F.col("start_before"))
            )
            + 1,
        )
        .otherwise(0)
        .cast("long")
        .alias("streak_days")
    )


def longest_streak(days: DataFrame) -> DataFrame:
    """Longest run of consecutive days per year (at most 366 rows per window)."""
    per_year = W.partitionBy("year").orderBy("day")
    island = F.date_sub("day", F.row_number().over(per_year))
    return (
        days.withColumn("year", F.year("day").cast("long"))
        .withColumn("island", island)
        .groupBy("year", "island")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("year")
        .agg(F.max("n").alias("longest_streak_days"))
    )


def anchored_blocks(
    events: DataFrame,
    now_ms: int,
    width_ms: int = 5 * fixed.HOUR_MS,
    lookback_ms: int | None = None,
    tool: str = "claude-code",
) -> DataFrame:
    """Usage of the blocks that are open at ``now``; one row.

    Inside a session a block starts at its first event and the next one at the first event at
    least ``width_ms`` later, whatever the session's age; with ``lookback_ms`` older events are not
    looked at, which moves the starts of sessions that began before. Rows are folded to (session,
    instant) first.
    """
    recent = events if lookback_ms is None else since(events, now_ms - lookback_ms)
    rows = (
        recent
        .filter(F.col("tool") == tool)
        # rows without a session form one group
        .groupBy(
            F.coalesce(F.col("session_id"), F.lit("\0")).alias("session_id"), F.col("ts_ms")
        )
        .agg(F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"))
    )
    starts = spaced(rows, ["session_id"], "ts_ms", width_ms).withColumnRenamed("ts_ms", "start_ms")
    # blocks do not overlap: at most one per session is open
    is_open = (F.col("start_ms") <= now_ms) & (F.col("start_ms") > now_ms - width_ms)
    open_blocks = starts.filter(is_open)
    return (
        salted_join(rows, open_blocks, ["session_id"], spread_by="ts_ms")
        .filter(F.col("ts_ms").between(F.col("start_ms"), F.col("start_ms") + width_ms - 1))
        .agg(
            F.coalesce(F.sum("tokens"), F.lit(0)).alias("window_tokens"),
            F.coalesce(F.sum("calls"), F.lit(0)).alias("window_calls"),
            F.min("start_ms").alias("window_start"),
        )
        .select(
            F.col("window_start").isNotNull().alias("active"),
            "window_tokens",
            "window_calls",
            "window_start",
            (F.col("window_start") + width_ms).alias("window_ends_at"),
        )
    )


def session_curve(
    events: DataFrame, session_id: str, tool: str | None = None, limit: int | None = None
) -> DataFrame:
    """Requests of one session in time order."""
    rows = events.filter(F.col("session_id") == session_id)
    if tool:
        rows = rows.filter(F.col("tool") == tool)
    curve = rows.select("ts_ms", "dedup_key", "model", *BILLED_COLUMNS, "total_tokens").orderBy("ts_ms", "dedup_key")
    return curve if limit is None else curve.limit(limit)


COUNTERS = [*BILLED_COLUMNS, "reasoning_tokens"]


def cumulative_to_daily(snapshots: DataFrame, tz: str = "UTC") -> DataFrame:
    """Cumulative per-key counters to usage booked on the local day of the newest snapshot.

    Per key and day only the newest snapshot counts (field-wise maximum at equal instants);
    booked counters never fall, and a day's usage is what they gained. The windows run over one
    row per key and day.
    """
    day = local_day(F.col("ts_ms"), tz)
    at_instant = (
        snapshots.withColumn("day", day)
        .groupBy("dedup_key", "tool", "day", "ts_ms")
        .agg(
            *[F.max(c).alias(c) for c in COUNTERS],
            F.max_by(F.struct("model", "session_id", "project"), "ord").alias("ids"),
        )
    )
    day_end = (
        at_instant.groupBy("dedup_key", "tool", "day")
        .agg(F.max_by(F.struct("ts_ms", *COUNTERS, "ids"), "ts_ms").alias("s"))
        .select("dedup_key", "tool", "day", "s.*")
    )
    per_key = W.partitionBy("dedup_key", "tool").orderBy("day")
    so_far = per_key.rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = per_key.rowsBetween(W.unboundedPreceding, -1)
    gained = day_end.select(
        "dedup_key",
        "tool",
        "day",
        "ts_ms",
        "ids",
        *[
            (F.max(c).over(so_far) - F.coalesce(F.max(c).over(earlier), F.lit(0))).alias(c)
            for c in COUNTERS
        ],
    )
    total = sum((F.col(c) for c in BILLED_COLUMNS[1:]), F.col(BILLED_COLUMNS[0]))
    booked = gained.withColumn("total_tokens", total).filter(
        (F.col("total_tokens") != 0) | (F.col("reasoning_tokens") != 0)
    )
    first_booked = F.row_number().over(per_key) == 1
    key = F.when(first_booked, F.col("dedup_key")).otherwise(
        F.concat(F.col("dedup_key"), F.lit(":"), day_start_ms(F.col("day"), tz).cast("string"))
    )
    return booked.select(
        key.alias("dedup_key"),
        "ts_ms",
        "tool",
        F.col("ids.model").alias("model"),
        F.col("ids.session_id").alias("session_id"),
        F.col("ids.project").alias("project"),
        *COUNTERS,
        "total_tokens",
    )


def running_context(
    lines: DataFrame,
    value: str,
    keys: list[str],
    chunk: str,
    order: list[str],
    name: str = "context",
    null_keys: bool = False,
) -> DataFrame:
    """Sum of all earlier rows of the same file."""
    return running(lines, keys, chunk, order, {name: ("sum_before", F.col(value))}, null_keys)


def last_known(
    lines: DataFrame,
    columns: dict[str, str],
    keys: list[str],
    chunk: str,
    order: list[str],
    null_keys: bool = False,
) -> DataFrame:
    """Carry the last value that is not null forward; ``columns`` maps source to output."""
    specs = {out: ("last", F.col(source)) for source, out in columns.items()}
    return running(lines, keys, chunk, order, specs, null_keys)


def balance_delta(balances: DataFrame, since_ms: int) -> DataFrame:
    """Last minus first balance of each provider since an instant; null below two readings."""
    order = F.struct("ts_ms", "event_id") if "event_id" in balances.columns else F.col("ts_ms")
    amount = F.col("balance").cast("decimal(28,6)")
    return (
        since(balances, since_ms)
        .groupBy("provider")
        .agg(
            F.count(F.lit(1)).alias("points"),
            (F.max_by(amount, order) - F.min_by(amount, order)).alias("d"),
        )
        .select(
            "provider",
            "points",
            F.when(F.col("points") >= 2, F.col("d").cast("double")).alias("delta"),
        )
    )
