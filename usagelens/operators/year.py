"""Year report."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions.predicates import since
from usagelens.functions.times import local_time
from usagelens.operators.sequence import longest_streak


def year_rows(events: DataFrame, year: int, tz: str = "UTC") -> DataFrame:
    """Events of one local calendar year, cut by instant so that scans can be pruned."""
    zone = ZoneInfo(tz)
    start = int(datetime(year, 1, 1, tzinfo=zone).timestamp() * 1000)
    end = int(datetime(year + 1, 1, 1, tzinfo=zone).timestamp() * 1000)
    return since(events, start).filter(F.col("ts_ms") < end)


def _first_max(keys: DataFrame, value: str, key: str) -> DataFrame:
    return keys.agg(
        F.max_by(key, F.struct(F.col(value), -F.col(key))).alias(key), F.max(value).alias(value)
    )


def year_report(events: DataFrame, year: int, tz: str = "UTC") -> dict[str, DataFrame]:
    """Frames of the report: totals, by_month, by_hour, busiest_day, top, biggest_session.

    Calendar figures come from one fold to (day, hour), at most 8784 rows.
    """
    rows = year_rows(events, year, tz)
    at = local_time(F.col("ts_ms"), tz)
    calendar = rows.groupBy(
        F.to_date(at).alias("day"), F.hour(at).cast("long").alias("hour")
    ).agg(F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("events"))
    daily = calendar.groupBy("day").agg(F.sum("tokens").alias("tokens"))
    hours = calendar.groupBy("hour").agg(F.sum("tokens").alias("tokens"))
    months = calendar.groupBy(F.month("day").cast("long").alias("month")).agg(
        F.sum("tokens").alias("tokens")
    )
    spark = events.sparkSession

    def complete(frame: DataFrame, key: str, first: int, last: int) -> DataFrame:
        axis = spark.range(first, last + 1).withColumnRenamed("id", key)
        return axis.join(frame, key, "left").na.fill(0, ["tokens"])

    by_hour = complete(hours, "hour", 0, 23)
    streak = longest_streak(daily.select("day")).agg(F.max("longest_streak_days").alias("s"))
    peak = _first_max(by_hour.filter("tokens > 0"), "tokens", "hour")
    totals = calendar.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
        F.count_distinct("day").alias("active_days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    ).select(
        F.lit(year).cast("long").alias("year"),
        "*",
        F.coalesce(streak.scalar(), F.lit(0)).alias("longest_streak_days"),
        F.when(F.col("total_tokens") > 0, F.coalesce(peak.select("hour").scalar(), F.lit(0))).alias(
            "peak_hour"
        ),
    )
    dimensions = ["tool", "model", "project"]
    by_name = (
        rows.groupingSets([[d] for d in dimensions], *dimensions)
        .agg(F.sum("total_tokens").alias("tokens"), F.grouping_id().alias("gid"))
        .select(
            F.when(F.col("gid") == 0b011, "tool")
            .when(F.col("gid") == 0b101, "model")
            .otherwise("project")
            .alias("dimension"),
            F.coalesce(*dimensions).alias("name"),
            "tokens",
        )
        .filter(F.col("name").isNotNull() & (F.col("name") != ""))
    )
    # five rows per dimension; rank within (dimension, hash slice) first so that no window
    # sees all names of a dimension
    slice_ = F.pmod(F.xxhash64("name"), F.lit(64))
    local = W.partitionBy("dimension", "slice").orderBy(F.desc("tokens"), "name")
    final = W.partitionBy("dimension").orderBy(F.desc("tokens"), "name")
    top = (
        by_name.withColumn("slice", slice_)
        .withColumn("rn", F.row_number().over(local))
        .filter("rn <= 5")
        .withColumn("rank", F.row_number().over(final).cast("long"))
        .filter("rank <= 5")
        .select("dimension", "rank", "name", "tokens")
    )
    biggest = (
        rows.filter(F.col("session_id").isNotNull() & (F.col("session_id") != ""))
        .groupBy("session_id")
        .agg(
            F.min_by("tool", F.struct("ts_ms", "dedup_key")).alias("tool"),
            F.sum("total_tokens").alias("tokens"),
        )
        .orderBy(F.desc("tokens"), "session_id")
        .limit(1)
    )
    return {
        "totals": totals,
        "by_month": complete(months, "month", 1, 12),
        "by_hour": by_hour,
        "busiest_day": daily.orderBy(F.desc("tokens"), "day").limit(1),
        "top": top,
        "biggest_session": biggest,
    }
