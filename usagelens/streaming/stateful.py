"""Stateful streams: latency pairing, throttling, live context, alert levels.

Each processor keeps a few typed values per key; keys come from the grouping, so state is spread over the cluster
and survives through the state store. Event-time timers drop what can no longer matter, so the number of keys with
state follows the traffic near the watermark, not the history.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from usagelens import fixed
from usagelens.session import use_keyed_state


def _in_order(rows: Iterator[Row], *by: str) -> list[Row]:
    """One key's rows of a micro-batch, sorted, nulls last."""
    return sorted(rows, key=lambda row: [(row[name] is None, row[name] or 0) for name in by])


class Keyed(StatefulProcessor):
    """Value state with one event-time timer: the state goes when the watermark passes the instant set last."""

    state, out = "", ""

    def prepared(self) -> Keyed:
        """Schemas are parsed on the driver."""
        self.schema = StructType.fromDDL(f"{self.state}, until_ms long")
        return self

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)
        self.row = Row(*[field.split()[0] for field in self.out.split(", ")])

    # every call to the state is a message to the JVM, and a key has few rows: what was read is not asked for again
    def get(self) -> tuple | None:
        self.held = self.value.get()
        return None if self.held is None else self.held[:-1]

    def put(self, values: tuple, until_ms: int) -> None:
        """New values of the key that :meth:`get` read."""
        before = None if self.held is None else self.held[-1]
        self.value.update((*values, until_ms))
        if before != until_ms:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.value.clear()
        return iter([])

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame, keys: list[str], processor: Keyed, time_ms: str, delay: str, mode: str = "append") -> DataFrame:
    use_keyed_state(rows.sparkSession)
    # a watermark begins at the epoch and what is not after it is late, so that instant itself needs a millisecond more
    timed = rows.withColumn("event_time", F.timestamp_millis(F.col(time_ms) + 1)).withWatermark("event_time", delay)
    return timed.groupBy(*keys).transformWithState(
        statefulProcessor=processor.prepared(), outputStructType=StructType.fromDDL(processor.out), outputMode=mode, timeMode="eventTime"
    )


# ------------------------------------------------------------------------ latency pairing


class LastSend(Keyed):
    """Replies with the wait since the last send of their reference before them."""

    state, out = "sent_ms long", "dedup_key string, duration_ms long"

    def __init__(self, max_ms: int) -> None:
        self.max_ms = max_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.get()
        sent = first = None if held is None else held[0]
        # at one instant replies come first: a wait of nothing is no wait
        for row in _in_order(rows, "at_ms", "is_send"):
            if row.at_ms is None:
                break
            if row.is_send:
                sent = row.at_ms
            elif sent is not None and 0 < row.at_ms - sent <= self.max_ms:
                yield self.row(row.dedup_key, row.at_ms - sent)
        if sent is not None and sent != first:
            self.put((sent,), sent + self.max_ms + 1)


def stream_pair_latency(
    requests: DataFrame, replies: DataFrame, max_ms: int = fixed.MAX_DURATION_MS, delay: str = "15 minutes"
) -> DataFrame:
    """One row per reply: the wait since the last send of its file and reference, within the time bound.

    ``requests`` has path, ref and sent_ms; ``replies`` path, ref, dedup_key and ts_ms. Both are lines of one log, so a send
    has to arrive before or with the replies that follow it: a reply pairs with what is known when it arrives, and one
    that comes before all sends of its reference gives no row. A send is forgotten once the watermark is past the
    last reply it could pair with.
    """
    sends = requests.select(
        "path", "ref", F.col("sent_ms").alias("at_ms"), F.lit(None).cast("string").alias("dedup_key"), F.lit(True).alias("is_send")
    )
    rows = sends.unionByName(replies.select("path", "ref", F.col("ts_ms").alias("at_ms"), "dedup_key", F.lit(False).alias("is_send")))
    return _keyed(rows, ["path", "ref"], LastSend(max_ms), "at_ms", delay)


# ---------------------------------------------------------------------------- throttling


class Spaced(Keyed):
    """Rows at least ``gap_ms`` after the last one that was kept."""

    state, out = "last_ms long", "id string, received_ms long, ord long"

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.get()
        last = first = None if held is None else held[0]
        for row in _in_order(rows, "received_ms", "ord"):
            at = row.received_ms
            if at is not None and (last is None or at - last >= self.gap_ms):
                last = at
                yield self.row(key[0], at, row.ord)
        if last != first:
            self.put((last,), last + self.gap_ms)


def stream_throttle(reports: DataFrame, gap_ms: int = fixed.THROTTLE_MS, delay: str = "10 minutes") -> DataFrame:
    """Accepted reports of a stream: at most one per id and gap; an instant per id, as long as it can reject one."""
    return _keyed(reports.select("id", "received_ms", "ord"), ["id"], Spaced(gap_ms), "received_ms", delay)


# --------------------------------------------------------------------------- live context


class Newest(Keyed):
    """Newest context of a session; once more, as ended, when nothing came for the time to live."""

    state, out = "ts_ms long, context_tokens long", "session_id string, ts_ms long, context_tokens long, live boolean"

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        ts, tokens = self.get() or (-1, 0)
        before = ts
        dated = [(row.ts_ms, row.context_tokens) for row in rows if row.ts_ms is not None]
        # of one instant the largest context
        newest = max(dated, key=lambda s: (s[0], s[1] is not None, s[1] or 0), default=(-1, 0))
        if newest[0] > ts:
            ts, tokens = newest
        if ts != before:
            self.put((ts, tokens), ts + self.ttl_ms)
        yield self.row(key[0], ts, tokens, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        ended = self.get()
        self.value.clear()
        if ended is not None:
            yield self.row(key[0], *ended, False)


def stream_live(snapshots: DataFrame, ttl_ms: int = fixed.LIVE_TTL_MS, delay: str = "1 minute") -> DataFrame:
    """Newest live context per session (session_id, ts_ms, context_tokens); a session without news for ten minutes ends."""
    rows = snapshots.select("session_id", "ts_ms", "context_tokens")
    return _keyed(rows, ["session_id"], Newest(ttl_ms), "ts_ms", delay, "update")


# --------------------------------------------------------------------------- alert levels


class Rising(Keyed):
    """Whether a key's level rose since the round before."""

    state, out = "level int, round long", "key string, round long, level int, notify boolean"

    def __init__(self, round_ms: int) -> None:
        self.round_ms = round_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        level, last = self.get() or (0, -1)
        for row in _in_order(rows, "round"):
            number, now = row["round"], row["level"]
            if number > last + 1:
                level = 0  # the condition was gone in between
            yield self.row(key[0], number, now, now > level)
            level, last = now, number
        # a key that is absent in the next round starts anew, so its state ends with that round
        self.put((level, last), (last + 2) * self.round_ms)


def alert_edges(levels: DataFrame, round_ms: int = 60_000, delay: str = "1 minute") -> DataFrame:
    """Notify only when the level of an alert key rises; a key that is absent for a round resets.

    ``levels`` has key, round (evaluation number) and level (1 warning, 2 critical); a round lasts ``round_ms`` of
    event time.
    """
    rows = levels.select("key", "round", "level", (F.col("round") * round_ms).alias("round_at"))
    return _keyed(rows, ["key"], Rising(round_ms), "round_at", delay)
