"""Set-like operations over usage frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.times import local_day


def merge_parts(*parts: DataFrame) -> DataFrame:
    """Concatenate parts of the same layout (for instance history and today)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def active_days(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """Distinct local days with any event."""
    return events.select(local_day(F.col("ts_ms"), tz).alias("day")).distinct()


def missing_from(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")
