"""Small golden logs for every line normaliser."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens.operators.dedup import dedup_claude, dedup_events, dedup_quality, dedup_request_alias
from usagelens.sources import agents, contexts, exports, rollouts, steps, transcripts

T0 = 1_710_000_000_000


def iso(ms: int) -> str:
    from datetime import datetime, timezone

    return datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def with_ord(df):
    return df.withColumn("ord", F.col("block") * 1000 + F.col("pos"))


def by_key(df) -> dict:
    return {r["dedup_key"]: r.asDict() for r in df.collect()}


def reply(message_id, usage, at=T0, **extra):
    return {
        "timestamp": iso(at), "type": "assistant", "sessionId": "s1", "cwd": "/home/u/app",
        "message": {"id": message_id, "model": "Claude-Opus-5-5", "usage": usage}, **extra,
    }


def test_transcript_blocks_keep_the_final_output(make_lines):
    def usage(out):
        return {"input_tokens": 200, "cache_read_input_tokens": 20_000, "output_tokens": out}

    lines = make_lines("ccmr", {"/t/a.jsonl": [reply("m1", usage(o)) for o in (0, 0, 500)]
                                 + [{"type": "user", "message": {}}, "{broken"]})
    rows = by_key(dedup_events(with_ord(transcripts.norm_claude(lines, "ccmr")).drop("path", "block", "pos")))
    assert list(rows) == ["ccmr:m1:"]
    assert rows["ccmr:m1:"]["output_tokens"] == 500
    assert rows["ccmr:m1:"]["total_tokens"] == 20_700


def test_transcript_validity(make_lines):
    good = {"input_tokens": 1, "output_tokens": 2}
    lines = make_lines("claude-code", {"/t/file.jsonl": [
        reply("ok", good),
        reply("has:colon", good),
        reply("negative", {"input_tokens": -1}),
        reply("text", {"input_tokens": "5"}),
        reply("none", {}),
        {**reply("synthetic", good), "message": {"id": "synthetic", "model": "<synthetic>", "usage": good}},
        {**reply("audit", good), "_audit_timestamp": iso(T0), "sessionId": None},
        reply("fraction", {"input_tokens": 1.5}),
    ]})
    rows = by_key(transcripts.norm_claude(lines, "claude-code"))
    assert list(rows) == ["claude-code:message:ok"]
    assert rows["claude-code:message:ok"]["project"] == "app"
    assert rows["claude-code:message:ok"]["usage_quality"] == 2


def test_latency_uses_the_longest_block_and_the_limit(make_lines):
    def request(ref, at):
        return f'{{"type":"api-request","id":"{ref}","timestamp":"{iso(at)}","params":{{}}}}'

    usage = {"input_tokens": 1, "output_tokens": 1}
    lines = make_lines("claude-code", {"/t/f.jsonl": [
        request("r1", T0),
        reply("m1", usage, T0 + 2000, requestRef="r1"),
        reply("m1", usage, T0 + 5000, requestRef="r1"),
        request("r2", T0),
        reply("m2", usage, T0 + 900_001, requestRef="r2"),
        reply("m3", usage, T0 + 10, requestRef="later"),
        request("later", T0),
    ]})
    rows = by_key(transcripts.pair_request_latency(lines))
    assert {k: r["duration_ms"] for k, r in rows.items()} == {"claude-code:message:m1": 5000}


def counters(n):
    return {"input_tokens": n, "output_tokens": n // 10, "total_tokens": n + n // 10}


def notice(at, total, last=None, **payload):
    info = {"total_token_usage": total, **({"last_token_usage": last} if last else {})}
    return {"timestamp": iso(at), "type": "event_msg", "payload": {"type": "token_count", "info": info, **payload}}


def meta(at, **payload):
    return {"timestamp": iso(at), "type": "session_meta", "payload": {"cwd": "/w/proj", **payload}}


def test_rollout_replay_prefix_is_not_counted(make_lines):
    records = [
        meta(T0),
        notice(T0 + 2, counters(100), counters(100)),
        {"timestamp": iso(T0 + 4), "type": "response_item", "payload": {"type": "function_call", "name": "old", "call_id": "p"}},
        notice(T0 + 7, counters(300), counters(200)),
        notice(T0 + 8000, counters(350), counters(50)),
        {"timestamp": iso(T0 + 9000), "type": "response_item", "payload": {"type": "function_call", "name": "new", "call_id": "c"}},
        notice(T0 + 20_000, counters(420), counters(70)),
    ]
    lines = make_lines("codex", {"/s/rollout-a.jsonl": records})
    events = by_key(rollouts.norm_codex(lines))
    assert {k: r["ts_ms"] - T0 for k, r in events.items()} == {
        "codex:file:rollout-a:1": 8000, "codex:file:rollout-a:2": 20_000,
    }
    calls = by_key(rollouts.codex_tool_calls(lines))
    assert list(calls) == ["codex:tc:file:rollout-a:c"]


def test_rollout_interleaved_streams_and_repeats(make_lines):
    a, b, c, d, r = (counters(n) for n in (100, 50, 70, 30, 900))

    def plus(*parts):
        return {k: sum(p[k] for p in parts) for k in a}

    main2, main3, main4 = plus(a, b), plus(a, b, c), plus(a, b, c, d)
    at = iter(range(T0 + 10_000, T0 + 99_000, 1000))
    records = [
        meta(T0),
        notice(next(at), a, a), notice(next(at), main2, b), notice(next(at), r, r),
        notice(next(at), main3, c), notice(next(at), r, r), notice(next(at), main4, d), notice(next(at), main4, d),
    ]
    rows = by_key(rollouts.norm_codex(make_lines("codex", {"/s/x.jsonl": records})))
    assert len(rows) == 5
    assert sum(v["total_tokens"] for v in rows.values()) == sum(p["total_tokens"] for p in (a, b, c, d, r))


def test_rollout_without_last_uses_differences(make_lines):
    records = [meta(T0), notice(T0 + 9000, counters(100)), notice(T0 + 19_000, counters(160))]
    rows = by_key(rollouts.norm_codex(make_lines("codex", {"/s/x.jsonl": records})))
    assert [v["input_tokens"] for v in rows.values()] == [60]


def test_rollout_compaction_counts_from_its_record(make_lines):
    def record(at, rid):
        return {"timestamp": iso(at), "type": "token_usage_record",
                "payload": {"response_id": rid, "usage": counters(40)}}

    base = counters(100)
    records = [
        meta(T0), notice(T0 + 9000, base, base),
        record(T0 + 15_000, "r-compact"), '{"timestamp":"x","type":"compacted","payload":{}}',
        notice(T0 + 16_000, base, counters(5)),
        record(T0 + 20_000, "r-plain"), notice(T0 + 21_000, counters(140), counters(40)),
    ]
    rows = by_key(rollouts.norm_codex(make_lines("codex", {"/s/x.jsonl": records})))
    assert sorted(rows) == ["codex:file:x:1", "codex:file:x:2", "codex:resp:r-compact"]


def test_rollout_latency(make_lines):
    def trigger(at, kind):
        return {"timestamp": iso(at), "type": "event_msg", "payload": {"type": kind}}

    def record(at, rid):
        return {"timestamp": iso(at), "type": "token_usage_record", "payload": {"response_id": rid, "usage": counters(1)}}

    s = 1000
    records = [
        meta(T0), trigger(T0 + 10 * s, "user_message"), record(T0 + 16 * s, "a"),
        notice(T0 + 17 * s, counters(10), counters(10)),
        trigger(T0 + 18 * s, "function_call_output"), record(T0 + 21 * s, "b"),
        notice(T0 + 22 * s, counters(30), counters(20)),
        record(T0 + 28 * s, "c"), notice(T0 + 29 * s, counters(60), counters(30)),
        notice(T0 + 40 * s, counters(100), counters(40)),
    ]
    rows = by_key(rollouts.norm_codex(make_lines("codex", {"/s/x.jsonl": records})))
    found = [rows[f"codex:file:x:{i}"]["duration_ms"] for i in range(1, 5)]
    assert found == [6000, 3000, 7000, None]


def test_rollout_quota_filters_foreign_limits(make_lines):
    def limits(limit_id, *windows):
        out = {"limit_id": limit_id, "plan_type": "plus"}
        for name, w in zip(("primary", "secondary"), windows):
            out[name] = w
        return out

    week, five = {"window_minutes": 10080, "used_percent": 4}, {"window_minutes": 300, "used_percent": 9}
    u = counters(10)
    records = [
        meta(T0),
        notice(T0 + 9000, u, u, rate_limits=limits("codex", week, five)),
        notice(T0 + 10_000, counters(20), u, rate_limits=limits("other", week)),
        notice(T0 + 11_000, counters(30), u, rate_limits=limits(None, None)),
    ]
    rows = rollouts.codex_quota(make_lines("codex", {"/s/x.jsonl": records})).collect()
    assert [[w["window_minutes"] for w in r["windows"]] for r in rows] == [[300.0, 10080.0]]


def test_parent_model_chain(spark):
    uuid = "00000000-0000-0000-0000-00000000000{}"
    rows = [(f"rollout-2024-{uuid.format(i)}", "gpt-6" if i == 0 else None, uuid.format(i - 1) if i else None) for i in range(5)]
    frame = spark.createDataFrame(rows, "session_id string, model string, parent string")
    assert {r["model"] for r in rollouts.inherit_parent_model(frame).collect()} == {"gpt-6"}


def test_dsh_folds_chunk_and_message(make_lines, spark):
    def chunk(turn, out, seq):
        return {"type": "assistant/chunk", "time": T0, "seq": seq, "data": {"turn": turn, "step": 0, "chunk": {
            "type": "usage", "usage": {"inputTokens": 100, "cacheReadTokens": 1000, "outputTokens": out}}}}

    message = {"type": "assistant/message", "time": T0 + 5, "seq": 9, "data": {
        "turn": 1, "step": 0, "usage": {"inputTokens": 100, "cacheReadTokens": 1000, "outputTokens": 380},
        "message": {"source": {"model": "deepseek-v4-pro"}}}}
    records = [
        {"type": "session", "cwd": "/w/proj"},
        {"type": "request/header", "data": {"header": {"config": {"model": "DeepSeek-V4-Flash"}}}},
        chunk(1, 380, 8), message, chunk(2, 20, 10),
    ]
    lines = make_lines("dsh", {"/h/sess1/session.v3.jsonl": records})
    rows = by_key(agents.norm_dsh(lines))
    assert {k: (r["total_tokens"], r["model"]) for k, r in rows.items()} == {
        "dsh:request:sess1:1:0:100:1000:0": (1480, "deepseek-v4-pro"),
        "dsh:request:sess1:2:0:100:1000:0": (1120, "deepseek-v4.1-flash"),
    }
    stored = spark.createDataFrame([("dsh:sess1:8:1:0", "dsh"), ("dsh:sess1:99:1:0", "dsh")], "dedup_key string, tool string")
    kept = dedup_request_alias(stored, agents.dsh_legacy_keys(lines)).collect()
    assert [r["dedup_key"] for r in kept] == ["dsh:sess1:99:1:0"]


def test_grok_turn_and_live(make_lines):
    usage = {"inputTokens": 1500, "cachedReadTokens": 500, "outputTokens": 600}
    turn = {"timestamp": T0 // 1000, "params": {"sessionId": "g1", "_meta": {"totalTokens": 77}, "update": {
        "sessionUpdate": "turn_completed", "prompt_id": "p1", "usage": {**usage, "modelUsage": {"Grok-4.7": usage}}}}}
    call = {"timestamp": T0, "params": {"sessionId": "g1", "update": {"sessionUpdate": "tool_call", "title": "grep", "toolCallId": "c1"}}}
    lines = make_lines("grok", {"/h/sessions/%2FUsers%2Fx%2Fmy%20app/sess/updates.jsonl": [turn, call]})
    rows = by_key(agents.norm_grok(lines))
    event = rows["grok:g1:p1:Grok-4.7"]
    assert (event["total_tokens"], event["input_tokens"], event["model"], event["project"], event["ts_ms"]) == (
        2100, 1000, "grok-4.7", "my app", T0)
    assert list(by_key(agents.grok_tool_calls(lines))) == ["grok:tc:c1"]
    live = agents.grok_live_context(lines)
    assert agents.live_view(live, T0 + 600_000).first()["context_tokens"] == 77
    assert agents.live_view(live, T0 + 600_001).count() == 0


def test_kimi_layouts(make_lines, spark):
    def end(uuid, usage, wrapped):
        event = {"type": "step.end", "uuid": uuid, "usage": usage}
        return {"type": "context.append_loop_event", "event": event, "time": T0} if wrapped else {**event, "time": T0}

    lines = make_lines("kimi", {"/k/wd1/x/session_9/agents/main/wire.jsonl": [
        {"type": "config.update", "modelAlias": "kimi-code/k3"},
        end("u1", {"inputOther": 1000, "inputCacheRead": 2000, "output": 50}, True),
        end("u2", {"input_tokens": 700, "cache_read_input_tokens": 100, "output_tokens": 5}, False),
        end("u3", {"input_tokens": 800, "input_tokens_details": {"cached_tokens": 600}, "output_tokens": 10}, True),
        end("u4", {"inputOther": 0}, True),
    ]})
    rows = by_key(agents.norm_kimi(lines))
    assert {k: r["total_tokens"] for k, r in rows.items()} == {"kimi:u1": 3050, "kimi:u2": 805, "kimi:u3": 810}
    assert (rows["kimi:u3"]["input_tokens"], rows["kimi:u3"]["cached_input"], rows["kimi:u3"]["model"]) == (200, 600, "k3")


def test_antigravity_quality_and_context(make_lines, spark):
    def step(i, kind="PLANNER_RESPONSE", **fields):
        return {"type": kind, "step_index": i, "created_at": iso(T0 + i), "content": "abcd" * 10, **fields}

    lines = make_lines("antigravity", {"/v/brain/u1/.system_generated/logs/transcript.jsonl": [
        step(0, "USER_INPUT"),
        step(1),
        step(2, status="ACTIVE", input_tokens=1, cache_read_tokens=1, output_tokens=1),
        step(2, input_tokens=500, cache_read_tokens=200, output_tokens=9, thinking_tokens=50),
        step(3, thinking="abcd" * 5),
        step(3),
    ]})
    gen = spark.createDataFrame([("anty-u1", 3, "Gemini 3.8 Flash (Medium)", 25_713)], "session_id string, step long, model string, context_tokens long")
    rows = by_key(steps.norm_antigravity(lines, gen))
    got = {k[-1]: (r["input_tokens"], r["output_tokens"], r["reasoning_tokens"], r["usage_quality"]) for k, r in rows.items()}
    assert got == {"1": (10, 10, 0, 1), "2": (500, 9, 9, 3), "3": (25_713, 15, 5, 2)}
    first_run = steps.norm_antigravity(lines, gen.limit(0))
    late = steps.backfill_context(first_run, gen)
    both = with_ord(first_run).unionByName(with_ord(late).withColumn("ord", F.lit(99).cast("long")))
    merged = by_key(dedup_quality(both.drop("path", "block", "pos")))
    assert merged["antigravity:anty-u1:3"]["input_tokens"] == 25_713
    assert merged["antigravity:anty-u1:1"]["usage_quality"] == 1


def test_malformed_context_records_are_told(spark):
    rows = [("doubao", '{"context_window_usage": '), ("doubao", "no record"), ("doubao", '{"a":{"context_window_usage":{"messages":1}}}')]
    records = spark.createDataFrame(rows, "tool string, value string")
    assert [tuple(r) for r in contexts.rejected_records(records).collect()] == [("doubao", rows[0][1], "malformed")]
    assert contexts.owners(records, levels=1).count() == 1


def test_context_records_nested_and_flat(spark):
    import json

    cwu = json.dumps({"system_prompt": 1000, "messages": 4000, "total_window_size": 256000})
    flat = {"conversation_id": "c1", "message_id": "m1", "create_time": T0, "ext": {"context_window_usage": cwu, "model_id": 38}}
    rows = [("doubao", json.dumps(flat)), ("doubao", json.dumps({"list": [{"deep": flat}, flat]})),
            ("doubao", json.dumps({**flat, "create_time": 5}))]
    frame = spark.createDataFrame(rows, "tool string, value string")
    events = contexts.norm_context_records(frame, T0).collect()
    assert len(events) == 3 and len({e["dedup_key"] for e in events}) == 1
    assert (events[0]["input_tokens"], events[0]["model"]) == (5000, "doubao-model-38")


def test_context_records_are_what_sparks_parser_reads(spark):
    def owner(fields: str, usage: str = '{"messages":5}') -> str:
        return '{"create_time":%d,%s,"context_window_usage":%s}' % (T0, fields, usage)

    rows = [
        ("number", owner('"model_id":100.0,"message_id":1e5')),
        ("text", owner('"model_id":"\\u0033\\u0038","message_id":" \\ud83d\\ude00\\" "')),
        ("object", owner('"message_id":{"b":1.50,"a":["x",null,true]}', '{"used_tokens":"0012","messages":5}')),
        ("tail", owner('"message_id":1') + " tail"),
        ("space", " \n" + owner('"message_id":null', '" {\\"tools\\":7.0}"')),
        ("twice", owner('"message_id":1,"message_id":2')),
        ("cut", owner('"message_id":1')[:-1]),
        ("key", '{"context\\u005fwindow_usage":{"messages":5},"x":"context_window_usage","create_time":%d}' % T0),
    ]
    events = contexts.norm_context_records(spark.createDataFrame(rows, "tool string, value string"), T0).collect()
    ids = {e["tool"]: (e["dedup_key"].split(":-:")[1].rsplit(":", 1)[0], e["model"], e["input_tokens"]) for e in events}
    assert len(events) == 6
    assert {tool: ids[tool] for tool in ("number", "text", "object", "tail")} == {
        "number": ("100000.0", "doubao-model-100", 5),
        "text": ('\U0001f600"', "doubao-model-38", 5),
        "object": ('{"a":["x",null,true],"b":1.5}', None, 12),
        "tail": ("1", None, 5),
    }
    assert (ids["space"][2], ids["key"][2]) == (7, 5)


def test_owners_come_with_whole_ancestors(spark):
    from pyspark.sql import functions as F

    record = '{"n":1.50,"l":[{"k":"v","context_window_usage":{"context_window_usage":null}},{"context_window_usage":""},{"k":2}]}'
    chains = contexts.owners(spark.createDataFrame([("doubao", record)], "tool string, value string")).select(
        F.transform("chain", lambda o: F.to_json(o)).alias("c")
    )
    root = '{"l":[{"context_window_usage":{"context_window_usage":null},"k":"v"},{"context_window_usage":""},{"k":2}],"n":1.5}'
    first = '{"context_window_usage":{"context_window_usage":null},"k":"v"}'
    assert sorted(r["c"] for r in chains.collect()) == sorted([
        ['{"context_window_usage":""}', root], [first, root], ['{"context_window_usage":null}', first, root],
    ])


def test_usage_csv(spark, tmp_path):
    head = "Date,User,Model,Input (w/ Cache Write),Input (w/o Cache Write),Cache Read,Output Tokens"
    row = '2026-01-02T03:04:05.000Z,"a, ""b""\nc",cursor-grok-4.6-medium,1,2,3,4'
    path = tmp_path / "usage.csv"
    path.write_text("\n".join([head, row, row, "2026-01-02T03:04:05.000Z,x,m,0,0,0,0"]) + "\n")
    events = exports.norm_cursor(exports.read_usage_csv(spark, str(path))).collect()
    assert sorted(e["dedup_key"][-2:] for e in events) == [":0", ":1"]
    assert {(e["model"], e["total_tokens"]) for e in events} == {("grok-4.6", 10)}
    (tmp_path / "other.csv").write_text("Date,Model\n1,2\n")
    assert exports.read_usage_csv(spark, str(tmp_path / "other.csv")).count() == 0


def test_claude_merge_is_independent_of_arrival_order(spark):
    rows = [
        ("claude-code:message:m", 1, 900, 10, "audit", "p1"),
        ("claude-code:message:m", 2, 100, 5, None, None),
        ("claude-code:message:m", 2, 100, 20, None, "p2"),
    ]
    schema = "dedup_key string, usage_quality int, input_tokens long, output_tokens long, model string, project string, ord long"
    results = set()
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        frame = spark.createDataFrame([(*rows[i], n) for n, i in enumerate(order)], schema)
        full = frame.select(
            "*", F.lit(T0).alias("ts_ms"), F.lit("claude-code").alias("tool"), F.lit("s").alias("session_id"),
            F.lit(None).cast("string").alias("trace_id"), F.lit("local").alias("device"),
            *[F.lit(0).cast("long").alias(c) for c in ("cached_input", "cache_write", "reasoning_tokens")],
            (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        )
        winner = dedup_claude(full).first()
        results.add((winner["usage_quality"], winner["output_tokens"], winner["project"]))
    assert results == {(2, 20, "p2")}
