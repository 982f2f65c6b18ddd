"""Daily rollup, its refresh for touched days, and data-quality proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.times import utc_day
from usagelens.schema import USAGE_COLUMNS

ROLLUP_KEYS = ["day", "tool", "model", "device"]
_SUMS = [*USAGE_COLUMNS, "events"]


def daily_rollup(events: DataFrame) -> DataFrame:
    """Sums per UTC day, tool, model and device, with the newest instant."""
    return (
        events.withColumn("day", utc_day(F.col("ts_ms")))
        .groupBy(*ROLLUP_KEYS)
        .agg(
            *[F.sum(c).alias(c) for c in USAGE_COLUMNS],
            F.count(F.lit(1)).alias("events"),
            F.max("ts_ms").alias("last_ts"),
        )
    )


def merge_rollup(*parts: DataFrame) -> DataFrame:
    """Rollups of disjoint event sets merged into one."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy(*ROLLUP_KEYS).agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.max("last_ts").alias("last_ts")
    )


def touched_days(batch: DataFrame) -> DataFrame:
    """UTC days a batch of late rows changes."""
    return batch.select(utc_day(F.col("ts_ms")).alias("day")).distinct()


def refresh_rollup(rollup: DataFrame, events: DataFrame, days: DataFrame) -> DataFrame:
    """Rollup with exactly the given days rebuilt from the events.

    ``days`` holds calendar days, at most a few thousand; other days are carried over as they are.
    """
    keyed = events if "day" in events.columns else events.withColumn("day", utc_day(F.col("ts_ms")))
    rebuilt = daily_rollup(keyed.join(days, "day", "left_semi").drop("day"))
    return rollup.join(days, "day", "left_anti").unionByName(rebuilt)


def check_invariants(events: DataFrame) -> DataFrame:
    """One row: rows, wrong totals, negative counters, repeated keys."""
    formula = (
        F.col("input_tokens") + F.col("cached_input") + F.col("cache_write") + F.col("output_tokens")
    )
    negative = F.lit(False)
    for c in USAGE_COLUMNS:
        negative = negative | (F.col(c) < 0)
    # fold by key first: a repeated key costs nothing in the final count
    per_key = events.groupBy("dedup_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("total_tokens") != formula, 1)).alias("bad_total"),
        F.count(F.when(negative, 1)).alias("negative"),
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("bad_total"), F.lit(0)).alias("wrong_totals"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"),
    )


def prove_rollup(cube: DataFrame, events: DataFrame) -> DataFrame:
    """Differences between cube sums and direct sums by tool and by day; empty when they agree."""
    dated = events.withColumn("day", utc_day(F.col("ts_ms")))

    def sums(df: DataFrame, value: str) -> DataFrame:
        return (
            df.groupingSets([["tool"], ["day"]], "tool", "day")
            .agg(F.sum(value).alias("tokens"))
            .select(
                F.when(F.col("tool").isNotNull(), "tool").otherwise("day").alias("dimension"),
                F.coalesce("tool", F.col("day").cast("string")).alias("name"),
                "tokens",
            )
        )

    from_cube, direct = sums(cube, "total_tokens"), sums(dated, "total_tokens")
    surplus = from_cube.exceptAll(direct).withColumn("side", F.lit("rollup"))
    missing = direct.exceptAll(from_cube).withColumn("side", F.lit("events"))
    return surplus.unionByName(missing)


def non_exact_share(events: DataFrame, tool: str = "antigravity") -> DataFrame:
    """Tokens of a tool that are not exactly measured, next to all tokens."""
    inexact = (F.col("tool") == tool) & (F.col("usage_quality") != 3)
    return events.agg(
        F.coalesce(F.sum(F.when(inexact, F.col("total_tokens"))), F.lit(0)).alias("non_exact_tokens"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
    )
