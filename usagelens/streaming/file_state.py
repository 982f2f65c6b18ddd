"""What a log file leaves behind for its next lines, kept in typed state while the file grows.

One processor holds for every file a value (the running values at its end) and a map (open totals, known steps)
and hands sorted new rows to a fold. With a time to live, the state of a file without new lines for so long is dropped; this
takes a stream that runs on, as Spark then plans one micro-batch after the other to look for expired state. Rows come from the same column functions as in a
batch; a fold is the sequential form of the windows that a batch puts over whole files.

A file whose new lines begin before the end of what was read became shorter: it starts again from nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from usagelens import fixed
from usagelens.session import use_keyed_state
from usagelens.sources import agents, rollouts, steps

#: a row's place in its file, and where its line ends
PLACE = "block long, pos long, after long"

Fold = Callable[[list[Row], dict | None, dict], tuple[list[tuple], dict, dict]]


def _ddl(schema: str) -> StructType:
    """A parsed schema. Needs a session, so it is called on the driver only."""
    return StructType.fromDDL(schema)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


class FileFold(StatefulProcessor):
    """Folds each file's rows, in order, from the state its earlier rows left.

    ``fold`` takes the sorted rows, the value state (None for a new file) and the map state, and returns rows (in the order
    of the columns), the new value and the new map. The value has ``after``, the end of what was read.
    """

    def __init__(self, fold: Fold, columns: str, value: str, key: str, entry: str, ttl_ms: int | None = None) -> None:
        self.fold, self.columns, self.ttl_ms = fold, _names(columns), ttl_ms
        self.value_schema, self.key_schema, self.entry_schema = _ddl(f"after long, {value}"), _ddl(key), _ddl(entry)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = Row(*self.columns)
        self.value = handle.getValueState("file", self.value_schema, ttlDurationMs=self.ttl_ms)
        self.entries = handle.getMapState("entries", self.key_schema, self.entry_schema, ttlDurationMs=self.ttl_ms)

    # every call to the state is a message to the JVM, and most files have few new lines
    def _load(self) -> tuple[dict | None, dict]:
        held = self.value.get()
        if held is None:
            return None, {}
        return dict(zip(self.value_schema.fieldNames(), held)), {tuple(k): tuple(v) for k, v in self.entries.iterator()}

    def _save(self, value: dict, entries: dict, old: dict) -> None:
        self.value.update(tuple(value[name] for name in self.value_schema.fieldNames()))
        for key in old.keys() - entries.keys():
            self.entries.removeKey(key)
        for key, entry in entries.items():
            if old.get(key) != entry:
                self.entries.updateValue(key, entry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's interface
        # a file's new narrow rows of one micro-batch; their order asks for all of them
        new = sorted(rows, key=lambda row: (_last(row.block), _last(row.pos)))
        value, entries = self._load()
        if value is not None and new[0].pos is not None and new[0].pos < value["after"]:
            value = None
        out, after, kept = self.fold(new, value, {} if value is None else dict(entries))
        self._save({**after, "after": max(row.after for row in new if row.after is not None)}, kept, entries)
        for cells in out:
            yield self.row(*cells)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        """A file that a batch has read: its value, and entries as a list of (key fields, entry fields)."""
        self.value.update(tuple(initialState[name] for name in self.value_schema.fieldNames()))
        for entry in initialState["entries"] or []:
            fields = tuple(entry[n] for n in self.key_schema.fieldNames())
            self.entries.updateValue(fields, tuple(entry[n] for n in self.entry_schema.fieldNames()))

    def close(self) -> None:
        pass


def _last(number) -> tuple:
    """Sorts nulls last."""
    return number is None, number or 0


def _missing(cell) -> bool:
    """No value, be it of a row or of a data frame."""
    return cell is None or cell is pd.NA or cell is pd.NaT or cell != cell


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def fold_files(rows: DataFrame, processor: FileFold, out: str, initial: DataFrame | None = None) -> DataFrame:
    """A stream of rows (path, block, pos, after, ...) through the state of their files."""
    use_keyed_state(rows.sparkSession)
    start = None if initial is None else initial.groupBy("path")
    clock = "none" if processor.ttl_ms is None else "processingTime"
    return rows.groupBy("path").transformWithState(
        statefulProcessor=processor, outputStructType=_ddl(out), outputMode="append", timeMode=clock, initialState=start
    )


# ---------------------------------------------------------------------------------- rollouts

_TOTAL = ["i", "c", "w", "o", "r", "tt"]
_TOTAL_DDL = ", ".join(f"{k} long" for k in _TOTAL)
CODEX_VALUE = (
    "model string, project string, begun boolean, replay_ms long, seq long, start_ms long, timing_start long, timing_end long, "
    "has_timing boolean, earlier array<long>, record_after long, record_block long, record_pos long, record_ts long, record_sid string, "
    "record_model string, record_project string, record_id string, record_used array<long>, compacted boolean"
)
CODEX_OUT = (
    "path string, block long, pos long, kind string, ts_ms long, sid string, model string, project string, name string, "
    "call_id string, response_id string, duration_ms long, seq long, " + _TOTAL_DDL
)
_NEW_ROLLOUT = {
    "model": None, "project": None, "begun": False, "replay_ms": None, "seq": 0, "start_ms": None, "timing_start": None,
    "timing_end": None, "has_timing": False, "earlier": None, "record_after": None, "record_block": None, "record_pos": None,
    "record_ts": None, "record_sid": None, "record_model": None, "record_project": None, "record_id": None,
    "record_used": None, "compacted": False,
}


def _total(cell) -> tuple | None:
    return None if cell is None else tuple(int(cell[k]) for k in _TOTAL)


def _follow(open_: dict, total: tuple, last: tuple | None, earlier: tuple | None) -> tuple | None:
    """Usage of a notice, None for a repeat or a first bare total; ``open_`` maps totals nothing has followed yet."""
    if total in open_:
        return None
    before = earlier if last is None else tuple(now - step for now, step in zip(total, last))
    open_.pop(before, None)
    open_[total] = (True,)
    if last is not None:
        return last
    return None if before is None else tuple(now - then for now, then in zip(total, before))


def fold_rollout(rows: pd.DataFrame, value: dict | None, open_: dict) -> tuple[pd.DataFrame, dict, dict]:
    """:func:`follow_rollout` over a data frame."""
    out, value, open_ = follow_rollout(rows.itertuples(index=False), value, open_)
    return pd.DataFrame(out, columns=_names(CODEX_OUT)).astype({"seq": "Int64", "duration_ms": "Int64"}), value, open_


def follow_rollout(rows: Iterable, value: dict | None, open_: dict) -> tuple[list[tuple], dict, dict]:
    """Rows of :func:`usagelens.sources.rollouts.records` of one file to requests, compactions and calls."""
    s = dict(value or _NEW_ROLLOUT)
    out = []

    def in_replay(ts) -> bool:
        if s["replay_ms"] is None:
            return False
        if ts is not None and 0 <= ts - s["replay_ms"] < fixed.REPLAY_GAP_MS:
            s["replay_ms"] = ts
            return True
        s["replay_ms"] = None
        return False

    def drop_record() -> None:
        s.update(record_id=None, record_after=None, compacted=False)

    def emit(block, pos, kind, ts, sid, model, project, name, call, response, wait, seq, used) -> None:
        out.append((path, block, pos, kind, ts, sid, model, project, name, call, response, wait, seq, *used))

    for row in rows:
        path, kind = row.path, row.kind
        ts = None if _missing(row.ts_ms) else int(row.ts_ms)
        if s["record_after"] is not None and not s["compacted"] and kind != "other":
            if kind == "compacted" and (row.block != s["record_block"] or row.pos == s["record_after"]):
                s["compacted"] = True
                continue
            drop_record()
        if kind == "trigger":
            s["start_ms"] = ts
            continue
        if kind in ("meta", "model", "call", "count", "other") and not s["begun"]:
            s["begun"] = True
            s["replay_ms"] = ts if kind == "meta" else None
        if kind == "record":
            if ts is not None:
                s.update(timing_start=s["start_ms"], timing_end=ts, has_timing=True, start_ms=ts)
            used = _total(row.used)
            if used is not None and _text(row.response_id) is not None and ts is not None:
                s.update(
                    record_after=int(row.after), record_block=int(row.block), record_pos=int(row.pos), record_ts=ts, record_sid=_text(row.sid),
                    record_model=s["model"], record_project=s["project"], record_id=row.response_id, record_used=list(used), compacted=False,
                )
        elif kind == "meta":
            s["project"] = _text(row.cwd_name) or s["project"]
        elif kind == "model":
            s["model"] = _text(row.named_model) or s["model"]
        elif kind == "call":
            if not in_replay(ts) and _text(row.name) is not None and ts is not None:
                emit(row.block, row.pos, "call", ts, _text(row.sid), s["model"], s["project"], row.name, _text(row.call_id), None, None, s["seq"], (0,) * 6)
        elif kind == "count" and row.total is not None and ts is not None:
            wait = s["timing_end"] - s["timing_start"] if s["has_timing"] and s["timing_start"] is not None else None
            s["has_timing"] = False
            replayed = in_replay(ts)
            compaction = dict(s) if s["compacted"] else None
            drop_record()
            total = _total(row.total)
            used = _follow(open_, total, _total(row.last), None if s["earlier"] is None else tuple(s["earlier"]))
            s["earlier"] = list(total)
            if replayed:
                continue
            if used is None:
                if compaction is not None:
                    c = compaction
                    emit(c["record_block"], c["record_pos"], "response", c["record_ts"], c["record_sid"], c["record_model"], c["record_project"],
                         None, None, c["record_id"], None, None, c["record_used"])
            elif used[0] > 0 or used[3] > 0 or used[5] > 0:
                s["seq"] += 1
                usable = wait if wait is not None and 1 <= wait <= fixed.MAX_DURATION_MS else None
                emit(row.block, row.pos, "count", ts, _text(row.sid), s["model"], s["project"], None, None, None, usable, s["seq"], used)
    return out, s, open_


def stream_rollouts(lines: DataFrame, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Requests, compactions and calls of growing rollouts, as :func:`rollouts.folded` gives them for whole files.

    ``initial`` (path, the columns of the value state, entries: list of open totals) continues files that a batch
    has read, see :func:`rollout_states`.
    """
    rows = rollouts.records(lines).select(
        "path", "block", "pos", "after", "kind", "ts_ms", "named_model", "cwd_name", "sid", "name", "call_id", "response_id",
        "used", "total", "last",
    )
    fold = FileFold(follow_rollout, CODEX_OUT, CODEX_VALUE, _TOTAL_DDL, "open boolean", ttl_ms)
    return fold_files(rows, fold, CODEX_OUT, initial)


def rollout_states(lines: DataFrame) -> DataFrame:
    """State of whole rollouts at their end, for the first batch of :func:`stream_rollouts`: one row a file.

    A file is read in order by one task; this is done once, when a table that batches filled becomes a stream.
    """
    rows = rollouts.records(lines)
    names = ["after", *_names(CODEX_VALUE)]

    def end(frames: pd.DataFrame) -> pd.DataFrame:
        new = frames.sort_values(["block", "pos"], kind="stable")
        _, value, open_ = fold_rollout(new, None, {})
        value["after"] = int(new["after"].max())
        entries = [{**dict(zip(_TOTAL, total)), "open": True} for total in open_]
        return pd.DataFrame([[new["path"].iloc[0], *(value[n] for n in names), entries]], columns=["path", *names, "entries"])

    out = f"path string, after long, {CODEX_VALUE}, entries array<struct<{_TOTAL_DDL.replace(' ', ':').replace(',:', ', ')}, open:boolean>>"
    return rows.groupBy("path").applyInPandas(end, out)


# -------------------------------------------------------------------------------------- kimi


def fold_kimi(rows: list[Row], value: dict | None, known: dict) -> tuple[list[tuple], dict, dict]:
    current, out = None if value is None else value["alias"], []
    for row in rows:
        current = current if row.alias is None else row.alias
        out.append((*row, current))
    return out, {"alias": current}, known


_KIMI_ROWS = (
    f"path string, {PLACE}, alias string, dedup_key string, ts_ms long, input_tokens long, cached_input long, "
    "cache_write long, output_tokens long"
)


def stream_kimi(lines: DataFrame, workspaces: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Events of growing kimi logs: the model is the last alias configured so far."""
    rows = _placed(agents.kimi_steps(lines), _KIMI_ROWS)
    out = _KIMI_ROWS + ", current string"
    return agents.kimi_events(fold_files(rows, FileFold(fold_kimi, out, "alias string", "k long", "v long", ttl_ms), out), workspaces)


# ------------------------------------------------------------------------------- antigravity

_STEP_ROWS = (
    f"path string, {PLACE}, session_id string, planner boolean, step_number double, step long, ts_ms long, chosen_model string, "
    "own_tokens long, est_output long, est_thinking long, exact_input long, exact_cached long, exact_output long, "
    "exact_thinking long, meta_model string, context_tokens long, exact boolean"
)


def fold_steps(rows: list[Row], value: dict | None, seen: dict) -> tuple[list[tuple], dict, dict]:
    total, model = (value["context"], value["model"]) if value is not None else (0, None)
    out = []
    for row in rows:
        number = None if _missing(row.step_number) else (float(row.step_number),)
        repeat = number is not None and number in seen
        if number is not None:
            seen[number] = (True,)
        before = total
        total += 0 if repeat else int(row.own_tokens)
        speaks = row.planner and (not repeat or row.exact)
        model = _text(row.meta_model if speaks else None if row.planner or repeat else row.chosen_model) or model
        out.append((*row, repeat, before, model))
    return out, {"context": total, "model": model}, seen


def stream_antigravity(lines: DataFrame, gen_meta: DataFrame, default_model: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Events of growing planner transcripts, with the context summed since their beginning."""
    rows = _placed(steps.with_step_facts(steps.steps(lines), gen_meta), _STEP_ROWS)
    out = _STEP_ROWS + ", repeat boolean, context long, current string"
    fold = FileFold(fold_steps, out, "context long, model string", "step double", "seen boolean", ttl_ms)
    return steps.antigravity_events(fold_files(rows, fold, out), default_model)


def _placed(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``; rows of a reader without line ends get a place after their own."""
    after = F.col("after") if "after" in rows.columns else F.col("pos") + 1
    return rows.withColumn("after", after).select(*[F.col(f.name).cast(f.dataType) for f in _ddl(schema).fields])
