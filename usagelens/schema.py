"""Table schemas. All counters are longs, all instants are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_COLUMNS = ["ts_ms", "model", "session_id", "project", "trace_id"]
USAGE_COLUMNS = [
    "input_tokens",
    "cached_input",
    "cache_write",
    "output_tokens",
    "reasoning_tokens",
    "total_tokens",
]
#: the four counters that add up to ``total_tokens``
BILLED_COLUMNS = ["input_tokens", "cached_input", "cache_write", "output_tokens"]


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


EVENT_SCHEMA = _struct(
    ("dedup_key", T.StringType(), False),
    ("ts_ms", T.LongType(), False),
    ("tool", T.StringType(), False),
    ("model", T.StringType(), True),
    ("session_id", T.StringType(), True),
    ("project", T.StringType(), True),
    ("input_tokens", T.LongType(), False),
    ("cached_input", T.LongType(), False),
    ("cache_write", T.LongType(), False),
    ("output_tokens", T.LongType(), False),
    ("reasoning_tokens", T.LongType(), False),
    ("total_tokens", T.LongType(), False),
    ("trace_id", T.StringType(), True),
    ("usage_quality", T.IntegerType(), False),
    ("duration_ms", T.LongType(), True),
    ("device", T.StringType(), False),
)

TOOL_CALL_SCHEMA = _struct(
    ("dedup_key", T.StringType(), False),
    ("ts_ms", T.LongType(), False),
    ("tool", T.StringType(), False),
    ("name", T.StringType(), False),
    ("session_id", T.StringType(), True),
    ("device", T.StringType(), False),
)

CREDIT_SCHEMA = _struct(
    ("dedup_key", T.StringType(), False),
    ("ts_ms", T.LongType(), False),
    ("tool", T.StringType(), False),
    ("amount", T.DoubleType(), False),
    ("device", T.StringType(), False),
)

FILE_SCHEMA = _struct(
    ("path", T.StringType(), False),
    ("tool", T.StringType(), False),
    ("session_id", T.StringType(), True),
    ("size", T.LongType(), False),
    ("mtime_ms", T.LongType(), False),
    ("version", T.IntegerType(), False),
    ("device", T.StringType(), False),
)


def as_events(df: DataFrame) -> DataFrame:
    """Project onto the event schema; optional columns that are missing get their default."""
    defaults = {
        "trace_id": F.lit(None),
        "usage_quality": F.lit(0),
        "duration_ms": F.lit(None),
        "device": F.lit("unknown"),
        "session_id": F.lit(None),
        "project": F.lit(None),
    }
    columns = []
    for field in EVENT_SCHEMA.fields:
        source = F.col(field.name) if field.name in df.columns else defaults[field.name]
        columns.append(source.cast(field.dataType).alias(field.name))
    extra = [c for c in df.columns if c not in EVENT_SCHEMA.fieldNames()]
    return df.select(*columns, *extra)
