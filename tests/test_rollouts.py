"""Counter streams of rollouts: the windows against the sequential rule; growing files against whole ones."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from usagelens.operators.dedup import dedup_events
from usagelens.schema import EVENT_SCHEMA, as_events
from usagelens.sources import agents, files, rollouts, steps, tail
from usagelens.streaming import file_state, jobs

from tests_support import iso, rollout_records

NAMES = EVENT_SCHEMA.fieldNames()
T0 = 1_710_000_000_000


@pytest.fixture(autouse=True)
def few_state_stores(spark):
    """Every partition of a stream has state stores of its own."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def random_rollout(seed: int) -> list[dict | str]:
    """Interleaved, resumed and repeating streams, bare totals, compactions, calls without ids, replays."""
    rng = random.Random(seed)
    at, totals, out = T0, [0, 0, 500], []
    if seed % 3:
        out.append({"timestamp": iso(at), "type": "session_meta", "payload": {"cwd": f"/w/p{seed}"}})

    def counters(n):
        return {"input_tokens": n, "cached_input_tokens": n // 3, "output_tokens": n // 5, "total_tokens": n + n // 5}

    def less(a, b):
        return {k: a[k] - b[k] for k in a}

    for i in range(70):
        at += rng.choice([0, 1, 400, 3000, 9000]) if i < 8 else rng.choice([1000, 5000, -200])
        kind = rng.random()
        if kind < 0.5:
            s = rng.randrange(3)
            before = totals[s]
            step = rng.choice([0, 0, 10, 20, 30])
            totals[s] += step
            if rng.random() < 0.1:
                totals[s], before = 10 * rng.randrange(4), 0  # the counter starts again
            info = {"total_token_usage": counters(totals[s])}
            if rng.random() < 0.8:
                info["last_token_usage"] = less(counters(totals[s]), counters(before))
            payload = {"type": "token_count", "info": info if rng.random() < 0.95 else None, "session_id": rng.choice([None, "sid"])}
            out.append({"timestamp": iso(at), "type": "event_msg", "payload": payload})
        elif kind < 0.62:
            payload = {"response_id": f"r{seed}-{i}" if rng.random() < 0.9 else None, "usage": counters(rng.randrange(90))}
            out.append({"timestamp": iso(at), "type": "token_usage_record", "payload": payload})
            if rng.random() < 0.6:
                out.append('{"timestamp":"x","type":"compacted","payload":{}}' if rng.random() < 0.8 else '{"type":"noise"}')
        elif kind < 0.75:
            call = {"type": "function_call", "name": "grep", "call_id": f"c{i}" if rng.random() < 0.6 else None}
            out.append({"timestamp": iso(at), "type": "response_item", "payload": call})
        elif kind < 0.85:
            out.append({"timestamp": iso(at), "type": "turn_context", "payload": {"model": rng.choice(["gpt-6", "o9", ""])}})
        else:
            out.append({"timestamp": iso(at), "type": "event_msg", "payload": {"type": rng.choice(["user_message", "task_started", "note"])}})
    return out


def sequential(lines):
    """Every file's rows through the sequential rule."""
    out = []
    rows = rollouts.records(lines).toPandas().astype(object)
    for _, group in rows.where(rows.notna(), None).groupby("path"):
        got, _, _ = file_state.fold_rollout(group.sort_values(["block", "pos"]), None, {})
        out += got.astype(object).where(got.notna(), None).values.tolist()
    return sorted(map(repr, _clean(out)))


def _clean(rows):
    return [tuple(v if v is None or isinstance(v, str) else int(v) for v in row) for row in rows]


COLUMNS = "path block pos kind ts_ms sid model project name call_id response_id duration_ms seq i c w o r tt".split()


@pytest.fixture(scope="module")
def many(spark):
    rows = []
    for seed in range(40):
        for n, record in enumerate(random_rollout(seed)):
            rows.append((f"/s/f{seed}.jsonl", "codex", n // 25, n, record if isinstance(record, str) else json.dumps(record)))
    return spark.createDataFrame(rows, "path string, tool string, block long, pos long, value string").repartition(4).cache()


@pytest.mark.parametrize("chunked", [False, True])
def test_windows_equal_the_sequential_rule(many, chunked):
    got = rollouts.folded(many, chunked=chunked).select(*COLUMNS).collect()
    assert sorted(map(repr, _clean(got))) == sequential(many)
    kinds = [r["kind"] for r in got]
    assert kinds.count("response") > 5 and kinds.count("count") > 300 and kinds.count("call") > 100


def test_rollouts_run_without_python_operators(many):
    plan = rollouts.norm_codex(many)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_calls_without_ids_are_numbered(many):
    calls = {r["dedup_key"] for r in rollouts.codex_tool_calls(many).collect()}
    folded = rollouts.folded(many).filter("kind = 'call'")
    want = rollouts.codex_calls(folded.withColumn("call_id", F.coalesce("call_id", F.col("seq").cast("string"))))
    assert calls == {r["dedup_key"] for r in want.collect()}


def test_equal_totals_in_two_streams(make_lines):
    def notice(i, total, last):
        info = {"total_token_usage": {"input_tokens": total}, "last_token_usage": {"input_tokens": last}}
        return {"timestamp": iso(T0 + 9000 * i), "type": "event_msg", "payload": {"type": "token_count", "info": info}}

    # the fourth notice repeats an open total, so it closes nothing and the fifth is a repeat too
    steps_ = [(100, 100), (200, 100), (100, 100), (200, 100), (100, 100), (300, 100)]
    lines = make_lines("codex", {"/s/x.jsonl": [notice(i, *s) for i, s in enumerate(steps_)]})
    got = rollouts.folded(lines).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [0, 1, 2, 5]


# ------------------------------------------------------------------------------ growing files


def write(path, records, mode="a", end="\n"):
    with open(path, mode) as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r, separators=(",", ":")) for r in records) + end)


def rows_of(df):
    return sorted(map(tuple, df.select(*NAMES).collect()), key=str)


def test_growing_rollouts_equal_one_batch(spark, tmp_path):
    folder = tmp_path / "logs" / "s"
    folder.mkdir(parents=True)
    table, calls, check = (str(tmp_path / n) for n in ("t", "c", "ck"))
    whole = {i: random_rollout(i) for i in range(5)} | {9: rollout_records(9)}

    def run():
        lines = tail.stream_tail(spark, str(tmp_path / "logs"), "codex")
        jobs.stream_codex_events(lines, table, check, calls).awaitTermination(300)

    for i, records in whole.items():
        write(folder / f"f{i}.jsonl", records[: 10 + 9 * i])
    run()
    for i, records in whole.items():
        write(folder / f"f{i}.jsonl", records[10 + 9 * i :])
    run()
    batch = tail.read_tail(spark, str(tmp_path / "logs"), "codex")
    events = as_events(rollouts.norm_codex(batch)).select(*NAMES, F.lit(0).cast("long").alias("ord"))
    assert rows_of(spark.read.parquet(table)) == rows_of(dedup_events(events))
    stored = {r["dedup_key"] for r in spark.read.parquet(calls).collect()}
    assert stored == {r["dedup_key"] for r in rollouts.codex_tool_calls(batch).collect()}
    before = spark.read.parquet(table).count()
    run()  # nothing new: no line is read
    assert spark.read.parquet(table).count() == before


def test_a_batch_table_goes_on_as_a_stream(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    records = rollout_records(3)
    write(folder / "f.jsonl", records[:7])
    old = tail.read_tail(spark, str(folder), "codex")
    initial = file_state.rollout_states(old).cache()
    first = rollouts.folded(old).select(*COLUMNS).collect()
    write(folder / "f.jsonl", records[7:])
    rest = tail.read_tail(spark, str(folder), "codex").filter(F.col("pos") >= initial.first()["after"])
    rest.write.parquet(str(tmp_path / "rest"))
    stream = spark.readStream.schema(rest.schema).parquet(str(tmp_path / "rest"))
    query = file_state.stream_rollouts(stream, initial=initial).writeStream.format("memory").queryName("cont").outputMode("append")
    query.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(200)
    got = first + spark.table("cont").select(*COLUMNS).collect()
    whole = rollouts.folded(tail.read_tail(spark, str(folder), "codex")).select(*[c for c in COLUMNS if c != "block"]).collect()
    assert sorted(map(repr, [tuple(r[c] for c in COLUMNS if c != "block") for r in got])) == sorted(map(repr, map(tuple, whole)))


def kimi_lines():
    def end(i):
        usage = {"inputOther": 10 + i, "inputCacheRead": i, "output": 5}
        return {"type": "step.end", "uuid": f"u{i}", "time": T0 + i, "usage": usage}

    return [{"type": "config.update", "modelAlias": "x/kimi-k3"}, end(1), end(2), end(3), {"type": "config.update", "modelAlias": "kimi-k4"}, end(4), end(5)]


def planner_lines():
    def step(i, kind="PLANNER_RESPONSE", **more):
        return {"type": kind, "status": "DONE", "step_index": i, "created_at": iso(T0 + 1000 * i), "content": "word " * (i + 3), **more}

    chosen = {"content": "The user changed the model to `Gemini 3 Pro`"}
    return [step(0, "USER_INPUT", **chosen), step(1), step(2, "TOOL"), step(3), step(1), step(4, input_tokens=5, cache_read_tokens=1, output_tokens=2), step(5), step(3)]


@pytest.mark.parametrize("tool,records,cuts", [("kimi", kimi_lines(), (3,)), ("antigravity", planner_lines(), (4,))])
def test_growing_logs_of_other_tools_equal_one_batch(spark, tmp_path, tool, records, cuts):
    folder = tmp_path / "logs" / "wd" / "sess" / "brain" / "b1"
    folder.mkdir(parents=True)
    meta = spark.createDataFrame([("anty-b1", 3, "Gemini 4", 900)], "session_id string, step long, model string, context_tokens long")
    table, check = str(tmp_path / "t"), str(tmp_path / "ck")

    def run():
        lines = tail.stream_tail(spark, str(tmp_path / "logs"), tool)
        if tool == "kimi":
            jobs.stream_kimi_events(lines, table, check).awaitTermination(200)
        else:
            jobs.stream_antigravity_events(lines, meta, table, check).awaitTermination(200)

    for at, to in zip((0, *cuts), (*cuts, None)):
        write(folder / "wire.jsonl", records[at:to])
        run()
    lines = tail.read_tail(spark, str(tmp_path / "logs"), tool)
    batch = agents.norm_kimi(lines) if tool == "kimi" else steps.norm_antigravity(lines, meta)
    got = spark.read.parquet(table)
    assert rows_of(got) == rows_of(as_events(batch)) and got.count() >= 4


# --------------------------------------------------------------------------------- log tail


def lines_of(df):
    return [(r["value"], r["after"]) for r in df.orderBy("path", "pos").collect()]


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_every_cut_gives_every_complete_line_once(tmp_path, split):
    path = str(tmp_path / "a.jsonl")
    text = "".join(f'{{"n":{i},"t":"{"é" * (i % 9)}"}}\n' for i in range(60)) + "\n" + "x" * 300 + "\r\n" + '{"half'
    (tmp_path / "a.jsonl").write_text(text, newline="")
    size = len(text.encode())
    got = [r for s in tail.spans(path, 0, size, split) for b in tail.read_span(s, "t") for r in b.to_pylist()]
    assert [r["value"] for r in got] == [v.removesuffix("\r") for v in text.split("\n")[:-1]]
    raw = text.encode()
    assert all(raw[r["pos"] : r["after"]].decode().rstrip("\r\n") == r["value"] for r in got)
    middle = size // 2
    cut = [r for a, b in ((0, middle), (middle, size)) for s in tail.spans(path, a, b, split) for x in tail.read_span(s, "t") for r in x.to_pylist()]
    assert [r["value"] for r in cut] == [r["value"] for r in got]


def test_long_lines_over_several_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK_BYTES", 64)
    lines = ["a" * 500, "b", "c" * 129, "", "d" * 63]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    got = [r["value"] for s in tail.spans(str(tmp_path / "a.jsonl"), 0, 698, 100) for b in tail.read_span(s, "t") for r in b.to_pylist()]
    assert got == lines


def test_tail_reads_what_was_added(spark, tmp_path):
    import zstandard

    folder = tmp_path / "x"
    folder.mkdir()
    write(folder / "a.jsonl", ['{"a":1}', '{"a":2}', '{"a":3'], end="")
    (folder / "notes.txt").write_text("no log\n")
    (folder / "a.sync-conflict-1.jsonl").write_text("{}\n")
    packed = zstandard.ZstdCompressor().compress(b'{"z":1}\n') + zstandard.ZstdCompressor().compress(b'{"z":2}')
    (folder / "b.jsonl.zst").write_bytes(packed)
    assert [v for v, _ in lines_of(tail.read_tail(spark, str(folder), "t"))] == ['{"a":1}', '{"a":2}', '{"z":1}', '{"z":2}']
    check, out = str(tmp_path / "ck"), str(tmp_path / "out")

    def run():
        before = spark.read.parquet(out).count() if (tmp_path / "out").exists() else 0
        query = tail.stream_tail(spark, str(folder), "t").writeStream.format("parquet").option("checkpointLocation", check)
        query.trigger(availableNow=True).start(out).awaitTermination(120)
        return spark.read.parquet(out).count() - before

    assert run() == 4
    assert run() == 0
    write(folder / "a.jsonl", ["}", '{"a":4}'])
    assert run() == 2
    assert '{"a":3}' in {r["value"] for r in spark.read.parquet(out).collect()}
    write(folder / "a.jsonl", ['{"new":1}'], mode="w")  # shorter: from its start
    assert run() == 1
    (folder / "c.jsonl").write_text("")
    assert run() == 0


def test_ledger_of_files_drives_the_read(spark, tmp_path):
    folder = tmp_path / "x"
    folder.mkdir()
    write(folder / "a.jsonl", ['{"a":1}'])
    write(folder / "b.jsonl", ['{"b":1}'])
    ledger_schema = "path string, tool string, size long, mtime_ms long, version int"
    none = spark.createDataFrame([], ledger_schema)
    listing = files.match_source_path(files.list_files(spark, str(folder), "pi"))
    assert len(lines_of(tail.read_changed(listing, none, 1))) == 2
    ledger = spark.createDataFrame([(*r, 1) for r in listing.collect()], ledger_schema)
    write(folder / "a.jsonl", ['{"a":2}'])
    now = files.list_files(spark, str(folder), "pi")
    assert [v for v, _ in lines_of(tail.read_changed(now, ledger, 1))] == ['{"a":2}']
    assert [v for v, _ in lines_of(tail.read_changed(now, ledger, 1, whole=True, split=5))] == ['{"a":1}', '{"a":2}']
    assert len(lines_of(tail.read_changed(now, ledger, 2))) == 3
