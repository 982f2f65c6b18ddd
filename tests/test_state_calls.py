"""Keyed streams: what a key costs in messages to the state store."""

from __future__ import annotations

from pyspark.sql import Row

from usagelens.streaming import file_state, stateful


class Store:
    """Value state and timers of one key that count what they are asked."""

    def __init__(self):
        self.stored, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802 - Spark's interface
        return self

    def exists(self):
        self.calls += 1
        return self.stored is not None

    def get(self):
        self.calls += 1
        return self.stored

    def update(self, value):
        self.calls, self.stored = self.calls + 1, value

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


def test_a_key_asks_for_its_state_once(spark):
    store, pairing = Store(), stateful.LastSend(1000).prepared()
    pairing.init(store)
    first = [Row(at_ms=30, is_send=False, dedup_key="r"), Row(at_ms=10, is_send=True, dedup_key=None)]
    assert [tuple(r) for r in pairing.handleInputRows(("p", "1"), iter(first), None)] == [("r", 20)]
    assert (store.stored, store.timers, store.calls) == ((10, 1011), {1011}, 3)
    later = [Row(at_ms=50, is_send=True, dedup_key=None), Row(at_ms=40, is_send=False, dedup_key="s")]
    assert [tuple(r) for r in pairing.handleInputRows(("p", "1"), iter(later), None)] == [("s", 30)]
    assert (store.stored, store.timers, store.calls) == ((50, 1051), {1051}, 7)


def test_live_context_keeps_the_newest(spark):
    store, live = Store(), stateful.Newest(100).prepared()
    live.init(store)
    rows = [Row(ts_ms=5, context_tokens=9), Row(ts_ms=7, context_tokens=1), Row(ts_ms=7, context_tokens=4)]
    assert [tuple(r) for r in live.handleInputRows(("s",), iter(rows), None)] == [("s", 7, 4, True)]
    assert (store.stored, store.timers, store.calls) == ((7, 4, 107), {107}, 3)


class Entries:
    """Map state of one key that counts what it is asked."""

    def __init__(self):
        self.stored, self.calls = {}, 0

    def iterator(self):
        self.calls += 1
        return iter(list(self.stored.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.calls, self.stored[key] = self.calls + 1, value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self.stored[key]


class Files(Store):
    def __init__(self):
        super().__init__()
        self.entries = Entries()

    def getValueState(self, name, schema, ttlDurationMs=None):  # noqa: N802, N803
        return self

    def getMapState(self, name, key, entry, ttlDurationMs=None):  # noqa: N802, N803
        return self.entries


def test_a_file_takes_plain_rows_and_few_messages(spark):
    names = ["path", "block", "pos", "after", "kind", "ts_ms", "named_model", "cwd_name", "sid", "name", "call_id", "response_id", "used", "total", "last"]

    def line(pos, **cells):
        return Row(**{**dict.fromkeys(names), "path": "f", "block": 0, "pos": pos, "after": pos + 10, "ts_ms": 2**60 + pos, **cells})

    def total(n):
        return Row(i=n, c=0, w=0, o=n, r=0, tt=2 * n)

    store = Files()
    fold = file_state.FileFold(
        file_state.follow_rollout, file_state.CODEX_OUT, file_state.CODEX_VALUE, file_state._TOTAL_DDL, "open boolean"
    )
    fold.init(store)
    first = [line(20, kind="count", total=total(5), last=total(5)), line(10, kind="model", named_model="m"), line(0, kind="meta", cwd_name="p", ts_ms=7)]
    out = [r.asDict() for r in fold.handleInputRows(("f",), iter(first), None)]
    assert [(r["kind"], r["ts_ms"], r["model"], r["project"], r["seq"], r["i"]) for r in out] == [("count", 2**60 + 20, "m", "p", 1, 5)]
    assert (store.calls, store.entries.calls) == (2, 1)
    later = [line(40, kind="call", name="n", call_id="c"), line(30, kind="count", total=total(9), last=total(4))]
    out = [r.asDict() for r in fold.handleInputRows(("f",), iter(later), None)]
    assert [(r["kind"], r["model"], r["seq"], r["i"], r["call_id"]) for r in out] == [("count", "m", 2, 4, None), ("call", "m", 2, 0, "c")]
    assert (store.calls, store.entries.calls) == (4, 4) and list(store.entries.stored) == [(9, 0, 0, 9, 0, 18)]
    # a file that became shorter begins anew
    out = [r.asDict() for r in fold.handleInputRows(("f",), iter([line(0, kind="count", total=total(3), last=total(3))]), None)]
    assert [(r["model"], r["seq"], r["i"]) for r in out] == [(None, 1, 3)] and list(store.entries.stored) == [(3, 0, 0, 3, 0, 6)]
