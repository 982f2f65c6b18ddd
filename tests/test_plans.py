"""What plans must not do: carry tables of steps to the driver, walk parsed records over and over."""

from __future__ import annotations

import json

from usagelens.sources import contexts, steps, writers

T0 = 1_706_000_000_000


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeated_steps_are_told_without_a_broadcast(make_lines, spark):
    def step(i, **fields):
        return {"type": "PLANNER_RESPONSE", "step_index": i, "created_at": "2024-01-05T10:00:00Z", "content": "abcd", **fields}

    exact = {"input_tokens": 5, "cache_read_tokens": 1, "output_tokens": 2}
    lines = make_lines("antigravity", {"/v/brain/u1/l.jsonl": [step(1), step(2), step(None), step(1), step(2, **exact), step(3)]})
    meta = spark.createDataFrame([("anty-u1", 3, "Gemini 3", 7)], "session_id string, step long, model string, context_tokens long")
    events = steps.norm_antigravity(lines, meta)
    assert "Broadcast" not in plan(events)
    found = sorted((r["dedup_key"], r["input_tokens"], r["usage_quality"]) for r in events.collect())
    assert found == [("antigravity:anty-u1:1", 0, 1), ("antigravity:anty-u1:2", 1, 1), ("antigravity:anty-u1:2", 5, 3), ("antigravity:anty-u1:3", 7, 2)]


def test_context_fields_are_read_once(spark):
    breakdown = {"context_window_usage": {"messages": 9}, "ext": "x" * 100}
    record = {"workspace": "/w/p", "bulk": ["y" * 1000], "a": {"conversation_id": "c", "model_id": 3, "b": [{**breakdown, "create_time": T0}]}}
    for _ in range(12):
        record = {"d": [record], "model_id": 99}
    records = spark.createDataFrame([("doubao", json.dumps(record))], "tool string, value string")
    events = contexts.norm_context_records(records, T0)
    assert [(e["session_id"], e["model"], e["project"], e["input_tokens"]) for e in events.collect()] == [("c", "doubao-model-3", "p", 9)]
    # a field is read a few times (1,628 reads before), not once more for every use of its value
    assert plan(events).count("try_variant_get") < 300


def test_context_records_are_walked_in_one_pass(spark):
    record = {"create_time": T0, "message_id": "m", "ext": {"context_window_usage": {"messages": 9}, "model_id": 3}}
    for i in range(300):
        record = {"d": [record], "conversation_id": f"c{i}", "model_id": 99}
    records = spark.createDataFrame([("doubao", json.dumps(record))], "tool string, value string")
    context = spark.sparkContext
    context.setJobGroup("walk", "")
    try:
        events = contexts.norm_context_records(records, T0)
        # ten levels were one stored job before, 60 here, and every level a generator of its own
        assert not context.statusTracker().getJobIdsForGroup("walk")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert plan(events).count("MapInArrow") == 1 and plan(events).count("Generate") < 10
    assert [(e["session_id"], e["model"], e["input_tokens"]) for e in events.collect()] == [("c0", "doubao-model-3", 9)]


def test_masked_rollouts_are_converted_once(make_lines):
    used = {"input_tokens": 5, "total_tokens": 6}
    payload = {"type": "token_count", "info": {"total_token_usage": used, "last_token_usage": {"input_tokens": -1}}, "session_id": "s"}
    lines = make_lines("codex", {"/r.jsonl": [{"timestamp": "2024-01-05T10:00:00Z", "type": "event_msg", "payload": payload}]})
    out = writers.export_masked_usage(lines, "codex")
    text = out.first()["value"]
    assert json.loads(text)["payload"]["info"] == {"total_token_usage": used} and '"session_id"' in text
    # 712 reads and 14 renderings before: each predicate had copies of its own
    assert plan(out).count("try_variant_get") < 100 and plan(out).count("StructsToJson") == 1
