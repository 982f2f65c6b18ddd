"""Streaming ingest, live aggregates and ledgers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usagelens.operators.rollup import daily_rollup, touched_days
from usagelens.sources import rollouts
from usagelens.sources.writers import table_exists, upsert_events, upsert_ledger, with_day
from usagelens.streaming.file_state import stream_antigravity, stream_kimi, stream_rollouts

LINE_SCHEMA = "path string, tool string, block long, pos long, value string"


def stream_lines(spark: SparkSession, folder: str, tool: str) -> DataFrame:
    """New log segments as a stream of lines (path, tool, block, value).

    A file source never re-reads a file that grew, so growing logs must land as segments here;
    :func:`usagelens.sources.tail.stream_tail` follows files that grow. The line position is added inside each
    micro-batch.
    """
    return (
        spark.readStream.option("recursiveFileLookup", "true")
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.lit(tool).alias("tool"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
        )
    )


def in_log_order(events: DataFrame) -> DataFrame:
    """``ord``, unique inside a micro-batch and rising by file, split and line. Stored rows always come first."""
    sorted_ = events.repartitionByRange("path", "block", "pos", "dedup_key").sortWithinPartitions("path", "block", "pos", "dedup_key")
    return sorted_.withColumn("ord", F.monotonically_increasing_id())


def write_events_stream(
    events: DataFrame, table: str, checkpoint: str, rollup: str | None = None, calls: str | None = None
) -> StreamingQuery:
    """A stream of event rows (with path, block and pos) to the event table, one idempotent upsert per micro-batch.

    A replayed micro-batch writes the same rows again and changes nothing. With ``rollup``, the daily rollup is
    rebuilt for exactly the days the batch touched. With ``calls``, rows whose ``kind`` is call go to the ledger of
    tool calls there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # the upsert looks at the batch several times
        rows = batch.persist()
        spark = batch.sparkSession
        used = rows
        if calls is not None:
            used = rollouts.codex_events(rows.filter("kind <> 'call'"))
            called = rows.filter("kind = 'call'").withColumn("call_id", F.coalesce("call_id", F.col("seq").cast("string")))
            upsert_ledger(spark, rollouts.codex_calls(called), calls)
        events = in_log_order(used).persist()
        days = upsert_events(spark, events, table)
        if rollup is not None:
            refresh_stored_rollup(spark, table, rollup, days)
        events.unpersist()
        rows.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_events(
    lines: DataFrame,
    normalise: Callable[[DataFrame], DataFrame],
    table: str,
    checkpoint: str,
    rollup: str | None = None,
) -> StreamingQuery:
    """Lines to events to the event table, for normalisers whose lines stand alone.

    Those that carry something from line to line have streams of their own, :func:`stream_codex_events` and the
    like, which keep it in state. Lines without a position get one inside the micro-batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        placed = batch if "pos" in batch.columns else batch.withColumn("pos", F.monotonically_increasing_id())
        events = in_log_order(normalise(placed)).persist()
        days = upsert_events(batch.sparkSession, events, table)
        if rollup is not None:
            refresh_stored_rollup(batch.sparkSession, table, rollup, days)
        events.unpersist()

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_codex_events(
    lines: DataFrame, table: str, checkpoint: str, calls: str, rollup: str | None = None, initial: DataFrame | None = None
) -> StreamingQuery:
    """Growing rollouts to the event table and the ledger of tool calls; see :mod:`usagelens.streaming.file_state`."""
    return write_events_stream(stream_rollouts(lines, initial=initial), table, checkpoint, rollup, calls)


def stream_kimi_events(lines: DataFrame, table: str, checkpoint: str, workspaces: DataFrame | None = None) -> StreamingQuery:
    return write_events_stream(stream_kimi(lines, workspaces), table, checkpoint)


def stream_antigravity_events(
    lines: DataFrame, gen_meta: DataFrame, table: str, checkpoint: str, default_model: str | None = None
) -> StreamingQuery:
    return write_events_stream(stream_antigravity(lines, gen_meta, default_model), table, checkpoint)


def refresh_stored_rollup(
    spark: SparkSession, table: str, rollup: str, days: DataFrame
) -> None:
    """Overwrite the rollup partitions of the given days from the event table."""
    touched = [row["day"] for row in days.collect()]
    if not touched:
        return
    events = spark.read.parquet(table).filter(F.col("day").isin(touched))
    rows = daily_rollup(events.drop("day"))
    writer = rows.write.mode("overwrite").partitionBy("day")
    writer.option("partitionOverwriteMode", "dynamic").parquet(rollup)


def late_days(batch: DataFrame) -> DataFrame:
    """Days whose history a batch of late rows changes."""
    return touched_days(batch)


def stream_dedup_ledger(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Ledger rows (tool calls, credits) without repeats; state is bounded by the watermark."""
    timed = rows.withColumn("event_time", F.timestamp_millis("ts_ms"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["dedup_key"])


def stream_daily_usage(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Tokens and requests per UTC day and tool, for update mode."""
    timed = events.withColumn("event_time", F.timestamp_millis("ts_ms"))
    return (
        timed.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 day").alias("w"), "tool")
        .agg(F.sum("total_tokens").alias("total"), F.count(F.lit(1)).alias("n"))
        .select(F.to_date("w.start").alias("day"), "tool", "total", "n")
    )


def stream_freshness(events: DataFrame) -> DataFrame:
    """Newest event per tool, for update mode; feeds the staleness check of source health."""
    return events.groupBy("tool").agg(F.max("ts_ms").alias("last_ts"), F.count(F.lit(1)).alias("n"))


__all__ = [
    "LINE_SCHEMA", "late_days", "refresh_stored_rollup", "stream_antigravity_events", "stream_codex_events",
    "stream_daily_usage", "stream_dedup_ledger", "stream_events", "stream_freshness", "stream_kimi_events",
    "stream_lines", "table_exists", "with_day", "write_events_stream",
]
