"""Incremental reads of table sources (extracts or JDBC frames)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_table_since(
    rows: DataFrame, column: str, watermark: int | float, lookback: int | float = 0
) -> DataFrame:
    """Rows beyond a watermark. ``lookback`` re-reads a margin for rows updated in place."""
    return rows.filter(F.col(column) > max(0, watermark - lookback))


def next_watermark(rows: DataFrame, column: str) -> DataFrame:
    """One row with the highest value of the column."""
    return rows.agg(F.max(column).alias("watermark"))


def effective_watermark(rows: DataFrame, column: str, watermark: int) -> int:
    """The watermark to read from: 0 when the table became shorter, since ids were reused."""
    top = next_watermark(rows, column).first()["watermark"]
    return 0 if (top or 0) < watermark else watermark
