"""Shared shape of the log normalisers.

Lines are frames (path, tool, block, pos, value) as ``read_log_lines`` gives them. A normaliser
filters by text first, parses each remaining line once, and projects fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions import variants as V
from usagelens.functions.names import basename, file_stem, parent_dir
from usagelens.operators.skew import running
from usagelens.schema import BILLED_COLUMNS

#: window partitions and order of a file's lines
FILE_KEYS, CHUNK, ORDER = ["path"], "block", ["block", "pos"]
_KEEP = ["path", "tool", "block", "pos"]


def parsed(lines: DataFrame, *any_of: str, keep_value: bool = False) -> DataFrame:
    """Lines that contain one of the texts, parsed into ``v``; malformed lines are dropped."""
    wanted = None
    for text in any_of:
        hit = F.col("value").contains(text)
        wanted = hit if wanted is None else wanted | hit
    rows = lines if wanted is None else lines.filter(wanted)
    extra = ["value"] if keep_value else []
    body = V.once(V.parse(F.col("value"))).alias("v")
    return rows.select(*_KEEP, *extra, body).filter(F.col("v").isNotNull())


def in_file_order(
    rows: DataFrame, *rounds: dict[str, tuple[str, Column]], chunked: bool = False
) -> DataFrame:
    """Running values over each file's rows; later rounds may use the columns of earlier ones.

    A file is the unit of order, so all rounds share one shuffle and one sort by file; the
    windows stream and spill, and only narrow rows reach them. ``chunked`` computes each round
    split by split instead, for single files too large for one task, at the price of more
    shuffles. Kinds are those of :func:`usagelens.operators.skew.running`.
    """
    out = rows
    per_file = W.partitionBy(*FILE_KEYS).orderBy(*ORDER)
    upto = per_file.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = per_file.rowsBetween(W.unboundedPreceding, -1)
    for specs in rounds:
        if chunked:
            out = running(out, FILE_KEYS, CHUNK, ORDER, specs)
            continue
        added = []
        for name, (kind, value) in specs.items():
            window = before if kind.endswith("_before") else upto
            base = kind.removesuffix("_before")
            if base == "last":
                column = F.last(value, ignorenulls=True).over(window)
            elif base == "sum":
                column = F.coalesce(F.sum(value).over(window), F.lit(0))
            else:
                column = F.max(value).over(window)
            added.append(column.alias(name))
        out = out.select("*", *added)
    return out


def stem() -> Column:
    return file_stem(F.col("path"))


def folder_name(levels: int) -> Column:
    """Name of the folder ``levels`` above the file."""
    p = F.col("path")
    for _ in range(levels):
        p = parent_dir(p)
    return basename(p)


def project_of(v: Column, path: str) -> Column:
    return basename(V.text(v, path))


def with_total(rows: DataFrame) -> DataFrame:
    total = F.col(BILLED_COLUMNS[0])
    for c in BILLED_COLUMNS[1:]:
        total = total + F.col(c)
    return rows.withColumn("total_tokens", total)


def used(rows: DataFrame) -> DataFrame:
    """Without rows that used nothing."""
    return rows.filter(F.col("total_tokens") > 0)


EVENT_FIELDS = [
    "dedup_key", "ts_ms", "tool", "model", "session_id", "project", "input_tokens", "cached_input",
    "cache_write", "output_tokens", "reasoning_tokens", "total_tokens", "trace_id", "usage_quality",
]
CALL_FIELDS = ["dedup_key", "ts_ms", "tool", "name", "session_id"]


def as_rows(rows: DataFrame, order: bool = True, extra: list[str] | None = None) -> DataFrame:
    """Project to event columns plus the line position; absent columns get their default."""
    defaults = {
        "reasoning_tokens": F.lit(0).cast("long"),
        "cache_write": F.lit(0).cast("long"),
        "cached_input": F.lit(0).cast("long"),
        "trace_id": F.lit(None).cast("string"),
        "usage_quality": F.lit(0),
        "session_id": F.lit(None).cast("string"),
        "project": F.lit(None).cast("string"),
    }
    columns = [
        F.col(c) if c in rows.columns else defaults[c].alias(c) for c in EVENT_FIELDS
    ]
    place = [c for c in ("path", "block", "pos") if order and c in rows.columns]
    return rows.select(*columns, *place, *(extra or []))
