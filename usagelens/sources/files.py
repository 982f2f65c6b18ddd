"""Log files: listing, selection, incremental ledger, and line reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions.keys import under_root
from usagelens.functions.names import basename


def list_files(spark: SparkSession, folder: str, tool: str) -> DataFrame:
    """Path, size and change time of every file below a folder; no content is read."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    )
    return listing.select(
        "path",
        F.lit(tool).alias("tool"),
        F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("mtime_ms"),
    )


def read_log_lines(spark: SparkSession, folders: str | list[str], tool: str) -> DataFrame:
    """Lines of all log files as (path, tool, block, pos, value), plain or zstd-compressed.

    ``(block, pos)`` orders the lines of a file even when its splits are read by different
    tasks; ``block`` also bounds the rows of one window partition. Lines that are not complete
    JSON objects, such as a half-written last line, are left out.
    """
    wanted = r"(?i)\.jsonl(\.(zst|zstd))?$"
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(folders)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.lit(tool).alias("tool"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
            "value",
        )
    )
    complete = F.rtrim("value").endswith("}")
    name = F.regexp_replace("path", "%20", " ")
    return lines.filter(
        F.col("path").rlike(wanted) & ~name.rlike(fixed.SYNC_CONFLICT_PATTERN) & complete
    )


def drop_sync_conflicts(files: DataFrame) -> DataFrame:
    """Without the copies that file synchronisers make of conflicting versions."""
    return files.filter(~F.col("path").rlike(fixed.SYNC_CONFLICT_PATTERN))


def is_cowork_usage_path(path: Column) -> Column:
    """Desktop agent layout: audit files and project transcripts, nothing else below it."""
    p = F.regexp_replace(path, r"\\", "/")
    below = rf"^(?:.*/)?{fixed.COWORK_FOLDER}/[^/]+/[^/]+/agent/local_ditto_[^/]+/"
    return p.rlike(below + r"audit\.jsonl$") | p.rlike(
        below + r"\.claude/projects/[^/]+/(?:.*)\.jsonl$"
    )


def match_source_path(files: DataFrame) -> DataFrame:
    """Files that belong to their tool's log layout."""
    path, tool = F.col("path"), F.col("tool")
    name = basename(path)
    in_cowork = F.regexp_replace(path, r"\\", "/").contains(f"/{fixed.COWORK_FOLDER}/")
    plain = name.endswith(".jsonl")
    keep = (
        F.when(tool == "claude-code", plain & (~in_cowork | is_cowork_usage_path(path)))
        .when(tool == "codex", name.rlike(r"\.jsonl(\.(zst|zstd))?$"))
        .when(tool == "dsh", name.rlike(r"\.(zst|zstd)$"))
        .when(tool == "antigravity", name.startswith("transcript") & plain)
        .when(tool == "kimi", name == "wire.jsonl")
        .otherwise(plain)
    )
    return files.filter(keep)


def new_or_changed_files(files: DataFrame, ledger: DataFrame, version: int) -> DataFrame:
    """Files to read: unknown, changed, or last read by an older normaliser.

    ``restart`` marks files that became shorter than what was read before. Table sources are
    always read. ``ledger`` has one row per path.
    """
    known = ledger.select(
        "path",
        F.col("size").alias("old_size"),
        F.col("mtime_ms").alias("old_mtime"),
        F.col("version").alias("old_version"),
    )
    unchanged = (
        (F.col("size") == F.col("old_size"))
        & (F.col("mtime_ms") == F.col("old_mtime"))
        & (F.col("old_version") == version)
    )
    table_tools = [t for t, _, kind, *_ in fixed.SOURCES if kind in fixed.SQL_KINDS]
    always = F.col("tool").isin(table_tools)
    return (
        files.join(known, "path", "left")
        .filter(always | ~F.coalesce(unchanged, F.lit(False)))
        .withColumn("restart", F.coalesce(F.col("size") < F.col("old_size"), F.lit(False)))
        .drop("old_size", "old_mtime", "old_version")
    )


def prune_ledger(ledger: DataFrame, seen: DataFrame, live_roots: list[str]) -> DataFrame:
    """Ledger without files that vanished from a root that is still there."""
    in_live_root = F.lit(False)
    for root in live_roots:
        in_live_root = in_live_root | under_root(F.col("path"), root)
    gone = ledger.join(seen.select("path").distinct(), "path", "left_anti").filter(in_live_root)
    return ledger.join(gone.select("path"), "path", "left_anti")
