"""Top-k reports that are not part of another operator, and stable colour slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recent_events(events: DataFrame, limit: int = 15) -> DataFrame:
    """Newest events; the key breaks ties."""
    return (
        events.select(
            "ts_ms", "tool", "model", "project", "device", "input_tokens", "cached_input",
            "output_tokens", "total_tokens", "dedup_key",
        )
        .orderBy(F.desc("ts_ms"), F.desc("dedup_key"))
        .limit(limit)
    )


def assign_slots(names: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """Colour slot per name: kept where it was known and free, else the next free one by name.

    ``names`` are the drawn series, at most ``size`` of them, so the windows are tiny.
    """
    wanted = names.select("name").distinct()
    held = (
        wanted.join(known.filter(F.col("slot").between(0, size - 1)), "name")
        .groupBy("slot")
        .agg(F.min("name").alias("name"))
    )
    fresh = wanted.join(held.select("name"), "name", "left_anti").withColumn(
        "nth", F.row_number().over(W.orderBy("name"))
    )
    spark = names.sparkSession
    free = (
        spark.range(size)
        .select(F.col("id").alias("slot"))
        .join(held.select("slot"), "slot", "left_anti")
        .withColumn("nth", F.row_number().over(W.orderBy("slot")))
    )
    assigned = fresh.join(free, "nth", "left").select(
        "name", F.coalesce("slot", F.lit(size - 1)).cast("long").alias("slot")
    )
    return held.select("name", F.col("slot").cast("long")).unionByName(assigned)
