"""Queries: streams over the given tables, which arrive as files in slices; what they wrote is read back.

Each slice is one run of the stream from its checkpoint, so what a run has to remember comes from the state store.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions.times import iso_millis
from usagelens.operators import topk
from usagelens.plans import views as v
from usagelens.plans.dedup_queries import DEDUP_SQL, EVENT_COLS
from usagelens.plans.registry import query
from usagelens.plans.source_queries import CODEX_SQL, EV_COLS, rollout_lines
from usagelens.session import ensure_checkpoint_dir
from usagelens.sources import exports, rollouts, writers
from usagelens.streaming import jobs, stateful
from usagelens.streaming.file_state import stream_rollouts


def landing(spark: SparkSession) -> str:
    """A new folder in shared storage."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def arriving(slices: list[DataFrame], place: str, run: Callable[[DataFrame], object]) -> None:
    """Each slice lands as files, then ``run`` starts the stream over all that landed and goes on from its checkpoint."""
    for rows in slices:
        rows.write.mode("append").parquet(f"{place}/in")
        stream = rows.sparkSession.readStream.schema(rows.schema).parquet(f"{place}/in")
        run(stream).awaitTermination()


def collected(spark: SparkSession, slices: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """All rows a stream emits, with ``run`` rising by micro-batch."""
    place = landing(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        # a replayed micro-batch replaces its own folder
        batch.write.mode("overwrite").parquet(f"{place}/out/run={batch_id}")

    def run(stream: DataFrame):
        writer = build(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{place}/check")
        return writer.foreachBatch(write).trigger(availableNow=True).start()

    arriving(slices, place, run)
    return spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out")


def last_state(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The newest emitted row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "run").alias("s")).select(*keys, "s.*")


def halves(rows: DataFrame, by: str) -> list[DataFrame]:
    """Rows before and after the middle of a column."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    middle = ((low or 0) + (high or 0)) // 2
    return [rows.filter(F.col(by) <= middle), rows.filter(F.col(by) > middle)]


@query("stream_rollouts", CODEX_SQL)
def _(spark, d):
    found = collected(spark, halves(rollout_lines(spark, d), "pos"), stream_rollouts)
    return rollouts.codex_events(found.filter("kind <> 'call'")).select(*EV_COLS, "duration_ms")


@query(
    "stream_tool_calls",
    """SELECT 'codex:tc:file:u' || user_id || ':c' || event_id AS dedup_key, ts_ms, 'f' || k % 7 AS name FROM usage_rows WHERE k % 4 = 1""",
)
def _(spark, d):
    place = landing(spark)

    def run(stream: DataFrame):
        return jobs.stream_codex_events(stream, f"{place}/events", f"{place}/check", f"{place}/calls")

    arriving(halves(rollout_lines(spark, d), "pos"), place, run)
    return spark.read.parquet(f"{place}/calls").select("dedup_key", "ts_ms", "name")


@query("stream_events", DEDUP_SQL)
def _(spark, d):
    place = landing(spark)
    rows = v.usage_arrivals(spark, d).withColumn("path", F.lit("arrivals")).withColumn("block", F.col("arrival").cast("long"))
    rows = rows.withColumn("pos", F.col("event_id")).select(*EVENT_COLS, "path", "block", "pos", "arrival")
    slices = [rows.filter(F.col("arrival") == i).drop("arrival") for i in range(3)]
    arriving(slices, place, lambda stream: jobs.write_events_stream(stream, f"{place}/events", f"{place}/check"))
    return spark.read.parquet(f"{place}/events").select(*EVENT_COLS)


@query(
    "stream_rollup",
    """SELECT CAST(epoch_ms(ts_ms) AS DATE) AS day, tool, count(*) AS events, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
    FROM usage_events GROUP BY 1, 2""",
)
def _(spark, d):
    place = landing(spark)
    rows = v.usage_rows(spark, d).withColumn("path", F.lit("e")).withColumn("block", F.lit(0).cast("long")).withColumn("pos", F.col("event_id"))
    rows = rows.select(*EVENT_COLS, "path", "block", "pos")
    # the later half comes first, so the earlier one changes days that were summed already
    arriving(
        halves(rows, "pos")[::-1],
        place,
        lambda stream: jobs.write_events_stream(stream, f"{place}/events", f"{place}/check", f"{place}/rollup"),
    )
    stored = spark.read.parquet(f"{place}/rollup")
    return stored.groupBy("day", "tool").agg(F.sum("events").alias("events"), F.sum("total_tokens").alias("total_tokens"))


@query("stream_dedup_ledger", "SELECT dedup_key, ts_ms, tool, name FROM tool_calls")
def _(spark, d):
    calls = v.tool_calls(spark, d).select("dedup_key", "ts_ms", "tool", "name")
    first, rest = halves(calls, "ts_ms")
    return collected(spark, [first.unionByName(first), first.unionByName(rest)], jobs.stream_dedup_ledger).select(*calls.columns)


@query(
    "stream_daily_usage",
    """SELECT CAST(epoch_ms(ts_ms) AS DATE) AS day, tool, CAST(sum(total_tokens) AS BIGINT) AS total, count(*) AS n FROM usage_events GROUP BY 1, 2""",
)
def _(spark, d):
    rows = v.usage_events(spark, d).select("ts_ms", "tool", "total_tokens")
    return last_state(collected(spark, halves(rows, "ts_ms"), jobs.stream_daily_usage, "update"), ["day", "tool"], ["total", "n"])


@query("stream_freshness", "SELECT tool, max(ts_ms) AS last_ts, count(*) AS n FROM usage_events GROUP BY 1")
def _(spark, d):
    rows = v.usage_events(spark, d).select("ts_ms", "tool")
    return last_state(collected(spark, halves(rows, "ts_ms"), jobs.stream_freshness, "update"), ["tool"], ["last_ts", "n"])


@query(
    "stream_pair_latency",
    f"""WITH replies AS (SELECT event_id, user_id, k, ts_ms FROM usage_rows WHERE k % 3 <> 0),
    sends AS (SELECT user_id, k % 9 AS ref, ts_ms - 1000 - 100 * k AS at FROM usage_rows)
    SELECT 'r' || event_id AS dedup_key, r.ts_ms - max(s.at) AS duration_ms FROM replies r JOIN sends s
      ON s.user_id = r.user_id AND s.ref = r.k % 9 AND s.at < r.ts_ms
    GROUP BY event_id, r.ts_ms HAVING r.ts_ms - max(s.at) BETWEEN 1 AND {fixed.MAX_DURATION_MS}""",
)
def _(spark, d):
    rows = v.usage_rows(spark, d)
    path, ref = F.col("user_id").cast("string").alias("path"), (F.col("k") % 9).cast("string").alias("ref")
    sends = rows.select(path, ref, (F.col("ts_ms") - 1000 - 100 * F.col("k")).alias("at_ms"), F.lit(None).cast("string").alias("dedup_key"))
    replies = rows.filter("k % 3 <> 0").select(path, ref, F.col("ts_ms").alias("at_ms"), v._key("r", F.col("event_id")).alias("dedup_key"))

    def pair(stream: DataFrame) -> DataFrame:
        sent = stream.filter("dedup_key IS NULL").select("path", "ref", F.col("at_ms").alias("sent_ms"))
        return stateful.stream_pair_latency(sent, stream.filter("dedup_key IS NOT NULL").withColumnRenamed("at_ms", "ts_ms"))

    return collected(spark, halves(sends.unionByName(replies), "at_ms"), pair).select("dedup_key", "duration_ms")


GAP = 6 * fixed.HOUR_MS


@query(
    "stream_throttle",
    f"""WITH RECURSIVE c AS (SELECT user_id, event_id, ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS rn FROM usage_rows),
    g AS (SELECT user_id, event_id, ts_ms FROM c WHERE rn = 1
      UNION ALL
      SELECT c.user_id, c.event_id, c.ts_ms FROM g JOIN c ON c.user_id = g.user_id
        AND c.rn = (SELECT min(x.rn) FROM c x WHERE x.user_id = g.user_id AND x.ts_ms >= g.ts_ms + {GAP}))
    SELECT CAST(user_id AS VARCHAR) AS id, ts_ms AS received_ms, event_id AS ord FROM g""",
)
def _(spark, d):
    rows = v.usage_rows(spark, d).select(
        F.col("user_id").cast("string").alias("id"), F.col("ts_ms").alias("received_ms"), F.col("event_id").alias("ord")
    )
    found = collected(spark, halves(rows, "received_ms"), lambda stream: stateful.stream_throttle(stream, GAP))
    return found.select("id", "received_ms", "ord")


@query(
    "stream_live",
    """SELECT session_id, max(ts_ms) AS ts_ms, arg_max(input_tokens, (ts_ms, input_tokens)) AS context_tokens
    FROM usage_events WHERE session_id IS NOT NULL GROUP BY session_id""",
)
def _(spark, d):
    rows = v.usage_events(spark, d).filter("session_id IS NOT NULL").select("session_id", "ts_ms", F.col("input_tokens").alias("context_tokens"))
    found = collected(spark, halves(rows, "ts_ms"), stateful.stream_live, "update")
    return found.groupBy("session_id").agg(F.max(F.struct("ts_ms", "context_tokens")).alias("s")).select("session_id", "s.*")


@query(
    "alert_edges",
    f"""WITH l AS (SELECT tool AS key, CAST(ts_ms // {fixed.DAY_MS} AS BIGINT) AS round, CAST(CASE WHEN max(k) >= 95 THEN 2 ELSE 1 END AS INTEGER) AS level
      FROM usage_rows WHERE k % 10 >= 4 OR user_id % 3 = 0 GROUP BY 1, 2 HAVING max(k) >= 80),
    p AS (SELECT *, lag(round) OVER w AS last, lag(level) OVER w AS was FROM l WINDOW w AS (PARTITION BY key ORDER BY round))
    SELECT key, round, level, level > CASE WHEN last = round - 1 THEN was ELSE 0 END AS notify FROM p""",
)
def _(spark, d):
    levels = (
        v.usage_rows(spark, d)
        .filter("k % 10 >= 4 OR user_id % 3 = 0")
        .groupBy(F.col("tool").alias("key"), F.floor(F.col("ts_ms") / fixed.DAY_MS).alias("round"))
        .agg(F.max("k").alias("most"))
        .filter("most >= 80")
        .select("key", "round", F.when(F.col("most") >= 95, 2).otherwise(1).alias("level"))
    )
    found = collected(spark, halves(levels, "round"), lambda stream: stateful.alert_edges(stream, fixed.DAY_MS))
    return found.select("key", "round", "level", "notify")


# ------------------------------------------------------------------------ files written and read back


@query(
    "snapshot_table",
    """SELECT tool, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS total FROM usage_events GROUP BY tool""",
)
def _(spark, d):
    place = f"{landing(spark)}/snapshots"
    events = v.usage_events(spark, d)
    for day in ("2024-01-28", "2024-01-29", "2024-01-30"):
        kept = writers.snapshot_table(events, place, day, keep=2)
    stored = spark.read.parquet(place).filter(F.col("snapshot") == kept[-1])
    return stored.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("total"))


@query(
    "read_usage_csv",
    """SELECT ts_ms, input_tokens, cached_input, cache_write, output_tokens FROM usage_rows WHERE total_tokens > 0 AND model IS NOT NULL""",
)
def _(spark, d):
    place = f"{landing(spark)}/csv"
    rows = v.usage_rows(spark, d).select(
        F.col("output_tokens").cast("string").alias("Output Tokens"),
        F.concat(F.lit('say "'), F.col("model"), F.lit('", or\nnot')).alias("Note"),
        iso_millis(F.col("ts_ms")).alias("Date"),
        F.coalesce("model", F.lit("")).alias("Model"),
        F.col("cache_write").alias("Input (w/ Cache Write)"),
        F.col("input_tokens").alias("Input (w/o Cache Write)"),
        F.col("cached_input").alias("Cache Read"),
    )
    rows.write.option("header", "true").option("quote", '"').option("escape", '"').option("quoteAll", "true").csv(place)
    events = exports.norm_cursor(exports.read_usage_csv(spark, place))
    return events.select("ts_ms", "input_tokens", "cached_input", "cache_write", "output_tokens")


@query(
    "assign_slots",
    """WITH n AS (SELECT DISTINCT tool AS name FROM usage_rows), k AS (SELECT tool AS name, min(k) % 7 AS slot FROM usage_rows WHERE tool < 'cursor' GROUP BY 1),
    h AS (SELECT slot, min(name) AS name FROM k GROUP BY slot),
    f AS (SELECT name, row_number() OVER (ORDER BY name) AS nth FROM n WHERE name NOT IN (SELECT name FROM h)),
    s AS (SELECT range AS slot, row_number() OVER (ORDER BY range) AS nth FROM range(7) WHERE range NOT IN (SELECT slot FROM h))
    SELECT name, CAST(slot AS BIGINT) AS slot FROM h UNION ALL SELECT f.name, coalesce(s.slot, 6) FROM f LEFT JOIN s USING (nth)""",
)
def _(spark, d):
    rows = v.usage_rows(spark, d)
    known = rows.filter("tool < 'cursor'").groupBy(F.col("tool").alias("name")).agg((F.min("k") % 7).alias("slot"))
    return topk.assign_slots(rows.select(F.col("tool").alias("name")), known, 7)
