"""One call from a folder of logs to the event table, with a stored ledger of the files that were read.

List, match, find what is new or changed, read from the cursors, normalise, upsert, save the ledger. The ledger
is written after the table, as a new version beside the old one: a run that is lost in between reads the same lines
again, and the upsert leaves the table as it is. A second run over unchanged files opens none of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.session import cut_lineage
from usagelens.sources.files import drop_sync_conflicts, list_files, match_source_path, new_or_changed_files, prune_ledger
from usagelens.sources.tail import read_changed
from usagelens.sources.writers import upsert_events
from usagelens.streaming.jobs import in_log_order, refresh_stored_rollup

LEDGER_SCHEMA = "path string, tool string, size long, mtime_ms long, version int"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a ledger, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [status.getPath().getName() for status in system.listStatus(root)]
    done = [n for n in names if n.startswith("v") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("v")) for n in done)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Path, size, time of change and normaliser version of every file that was read."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"{path}/v{versions[-1]}")


def save_ledger(ledger: DataFrame, path: str, keep: int = 2) -> None:
    """Write the next version; only the newest ``keep`` ones stay."""
    spark = ledger.sparkSession
    versions = _versions(spark, path)
    number = versions[-1] + 1 if versions else 1
    ledger.write.mode("overwrite").parquet(f"{path}/v{number}")
    for old in [*versions, number][:-keep]:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def ingest_folder(
    spark: SparkSession,
    folder: str,
    tool: str,
    normalise: Callable[[DataFrame], DataFrame],
    table: str,
    ledger: str,
    version: int = 1,
    whole: bool = True,
    live_roots: list[str] | None = None,
    rollup: str | None = None,
) -> int:
    """Bring what a folder has new into the event table; returns the number of files that were read.

    Normalisers that carry something from line to line read changed files as a whole (``whole``); those whose lines
    stand alone take only what was added. A new ``version`` reads everything again. Files that vanished leave the
    ledger if they lie below one of ``live_roots``; their events stay.
    """
    listing = drop_sync_conflicts(match_source_path(list_files(spark, folder, tool)))
    files = cut_lineage(listing.select("path", "tool", "size", "mtime_ms"))
    known = load_ledger(spark, ledger)
    n_changed = new_or_changed_files(files, known, version).count()
    if n_changed:
        events = in_log_order(normalise(read_changed(files, known, version, whole))).persist()
        days = upsert_events(spark, events, table)
        if rollup is not None:
            refresh_stored_rollup(spark, table, rollup, days)
        events.unpersist()
    kept = prune_ledger(known, files, live_roots or []).join(files.select("path"), "path", "left_anti")
    gone = kept.count() != known.join(files.select("path"), "path", "left_anti").count()
    if n_changed or gone:
        now = files.withColumn("version", F.lit(version))
        save_ledger(now.unionByName(kept.select(*now.columns)), ledger)
    return n_changed
