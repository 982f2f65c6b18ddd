"""Joins with their own semantics: dimension lookups, interval, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.operators.skew import running, salted_join


def lookup(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left lookup of a dimension with unique keys; the planner broadcasts it if it is small."""
    return facts.join(dimension, key, "left")


def pair_requests(
    requests: DataFrame, replies: DataFrame, keys: list[str], max_ms: int = fixed.MAX_DURATION_MS
) -> DataFrame:
    """Replies with the wait since their request: ``0 < reply - sent <= max_ms``, one row a reply.

    A request id sent more than once counts with its last send before the reply. That send is the
    running last one in time, so no pair of sends and replies is built.
    """
    rest = [c for c in replies.columns if c not in [*keys, "ts_ms"]]
    sends = requests.select(
        *keys, F.col("sent_ms").alias("ts_ms"), F.col("sent_ms").alias("_sent"),
        *[F.lit(None).cast(replies.schema[c].dataType).alias(c) for c in rest],
    )
    rows = replies.select(*keys, "ts_ms", F.lit(None).cast("long").alias("_sent"), *rest).unionByName(sends)
    # at one instant replies come first: a wait of nothing is no wait
    ordered = rows.withColumn("_send", F.col("_sent").isNotNull()).withColumn(
        "_slice", F.floor(F.col("ts_ms") / fixed.DAY_MS)
    )
    paired = asof_last(ordered, "_sent", keys, "_slice", ["ts_ms", "_send"], "sent_ms").filter("NOT _send")
    wait = F.col("ts_ms") - F.col("sent_ms")
    return (
        paired.withColumn("duration_ms", wait)
        .filter((F.col("duration_ms") > 0) & (F.col("duration_ms") <= max_ms))
        .drop("_sent", "_send", "_slice")
    )


def asof_last(
    rows: DataFrame, value: str, keys: list[str], chunk: str, order: list[str], out: str
) -> DataFrame:
    """Latest earlier value that is not null, as a running window rather than a join."""
    return running(rows, keys, chunk, order, {out: ("last_before", F.col(value))})


_COMMIT_SOURCES = ["claude-code", "ccmr", "codex"]


def session_outcomes(
    sessions: DataFrame,
    commits: DataFrame,
    tail_ms: int = 30 * fixed.MINUTE_MS,
    newest: int | None = None,
    slice_ms: int = fixed.DAY_MS,
) -> DataFrame:
    """Commits made during each session or shortly after, in its working directory.

    ``sessions`` has session_id, tool, cwd, first_ts and last_ts. The range join becomes a
    running commit count per directory, read at both ends of each session: no pair of session
    and commit is built for the count. The list fetches commits by their number, with ``newest`` only so many.
    Sessions without a known directory keep null.
    """
    known = F.col("tool").isin(_COMMIT_SOURCES) & F.col("cwd").isNotNull()
    blank = F.lit("")
    usable = sessions.filter(known)
    made = commits.filter("NOT is_merge")

    def point(df: DataFrame, at, kind: int, session: bool) -> DataFrame:
        return df.select(
            "cwd",
            at.alias("at"),
            F.lit(kind).alias("kind"),
            F.col("session_id") if session else blank.alias("session_id"),
            F.col("tool") if session else blank.alias("tool"),
            blank.alias("hash") if session else F.col("hash"),
            blank.alias("subject") if session else F.col("subject"),
        )

    # at equal instants: session start, then commits, then session end
    points = (
        point(usable, F.col("first_ts"), 0, True)
        .unionByName(point(made, F.col("ts_ms"), 1, False))
        .unionByName(point(usable, F.col("last_ts") + tail_ms, 2, True))
        .withColumn("slice", F.floor(F.col("at") / slice_ms))
    )
    is_commit = (F.col("kind") == 1).cast("long")
    counted = running(
        points, ["cwd"], "slice", ["at", "kind", "hash", "session_id", "tool"], {"nth": ("sum", is_commit)}
    )
    ends = (
        counted.filter(F.col("kind") != 1)
        .groupBy("session_id", "tool", "cwd")
        .agg(
            F.max(F.when(F.col("kind") == 0, F.col("nth"))).alias("before"),
            F.max(F.when(F.col("kind") == 2, F.col("nth"))).alias("upto"),
        )
    )
    start = F.col("before") if newest is None else F.greatest(F.col("before"), F.col("upto") - newest)
    wanted = ends.filter("upto > before").select(
        "session_id",
        "tool",
        "cwd",
        F.explode(F.sequence(start + 1, F.col("upto"))).alias("nth"),
    )
    numbered = counted.filter(F.col("kind") == 1).select("cwd", "nth", "hash", "subject", "at")
    lists = (
        wanted.join(numbered, ["cwd", "nth"])
        .groupBy("session_id", "tool")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("nth", "hash", "at", "subject")), asc=False),
                lambda e: F.struct(
                    e["hash"].alias("hash"), e["at"].alias("ts_ms"), e["subject"].alias("subject")
                ),
            ).alias("commit_list")
        )
    )
    counts = ends.select("session_id", "tool", (F.col("upto") - F.col("before")).alias("commits"))
    return sessions.join(counts, ["session_id", "tool"], "left").join(
        lists, ["session_id", "tool"], "left"
    )
