"""Health of sources and of mirrored folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions.keys import under_root
from usagelens.operators.skew import literal_table

_STALE_MS = 30 * fixed.MINUTE_MS


def source_health(
    events: DataFrame, credits: DataFrame, files: DataFrame, scan_stats: DataFrame, now_ms: int
) -> DataFrame:
    """Status of every registered source: error, empty, stale or ok.

    ``scan_stats`` has tool, parse_errors and last_error. Each input folds to one row per tool
    before it meets the registry.
    """
    spark = events.sparkSession
    sources = literal_table(spark, [(t,) for t, *_ in fixed.SOURCES], "tool string")
    ev = events.groupBy("tool").agg(
        F.count(F.lit(1)).alias("events"), F.max("ts_ms").alias("event_ts")
    )
    cr = credits.groupBy("tool").agg(
        F.count(F.lit(1)).alias("credit_rows"), F.max("ts_ms").alias("credit_ts")
    )
    fl = files.groupBy("tool").agg(
        F.count(F.lit(1)).alias("files"), F.max("mtime_ms").alias("last_file_mtime")
    )
    joined = (
        sources.join(ev, "tool", "left")
        .join(cr, "tool", "left")
        .join(fl, "tool", "left")
        .join(scan_stats, "tool", "left")
        .na.fill(0, ["events", "credit_rows", "files", "parse_errors"])
        .withColumn("last_event_ts", F.greatest("event_ts", "credit_ts"))
    )
    stale = (F.col("last_file_mtime") > now_ms - _STALE_MS) & (
        F.col("last_file_mtime") - F.col("last_event_ts") > _STALE_MS
    )
    status = (
        F.when(F.col("parse_errors") > 0, "error")
        .when(F.col("events") + F.col("credit_rows") == 0, "empty")
        .when(stale, "stale")
        .otherwise("ok")
    )
    return joined.select(
        "tool",
        status.alias("status"),
        "events",
        "last_event_ts",
        "files",
        "last_file_mtime",
        "parse_errors",
        "last_error",
    )


def mirror_health(files: DataFrame, roots: list[tuple[str, str]], now_ms: int) -> DataFrame:
    """File count, newest change and idle days of each mirrored root (tool, root)."""
    spark = files.sparkSession
    known = literal_table(spark, roots, "tool string, root string")
    # the root list is configuration; each file is tested against the roots of its own tool
    counted = (
        files.join(known, "tool")
        .filter(under_root(F.col("path"), F.col("root")))
        .groupBy("tool", "root")
        .agg(F.count(F.lit(1)).alias("files"), F.max("mtime_ms").alias("newest_ms"))
    )
    idle = F.floor((F.lit(now_ms) - F.col("newest_ms")) / fixed.DAY_MS)
    return (
        known.join(counted, ["tool", "root"], "left")
        .na.fill(0, ["files"])
        .withColumn("idle_days", idle)
        .withColumn("warn", F.coalesce(F.col("idle_days") > 7, F.lit(False)))
    )
