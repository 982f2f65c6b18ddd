"""Upsert, rollup, snapshots, CSV files and streams."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from usagelens.operators import rollup
from usagelens.operators.dedup import dedup_events, merge_upsert
from usagelens.plans import views
from usagelens.sources import files, transcripts, writers
from usagelens.streaming import jobs, stateful
from usagelens.schema import EVENT_SCHEMA, USAGE_COLUMNS, as_events

SF = "/root/testdata/sf0.001"
NAMES = EVENT_SCHEMA.fieldNames()


def rows_of(df):
    return sorted(map(tuple, df.select(*NAMES).collect()), key=str)


def test_upsert_is_idempotent_and_equals_batch_dedup(spark, tmp_path):
    arrivals = as_events(views.usage_arrivals(spark, SF)).select(*NAMES, "ord", "arrival")
    path = str(tmp_path / "events")
    for number in (0, 1, 2):
        batch = arrivals.filter(F.col("arrival") == number)
        writers.upsert_events(spark, batch, path)
    expected = rows_of(dedup_events(arrivals.drop("arrival")))
    assert rows_of(spark.read.parquet(path)) == expected
    # the last batch once more changes nothing
    writers.upsert_events(spark, arrivals.filter("arrival = 2"), path)
    assert rows_of(spark.read.parquet(path)) == expected


def test_upsert_keeps_the_day_of_the_first_arrival(spark, tmp_path):
    one = views.usage_events(spark, SF).limit(1)
    path = str(tmp_path / "events")
    writers.upsert_events(spark, one.withColumn("ord", F.lit(1).cast("long")), path)
    later = one.withColumn("ts_ms", F.col("ts_ms") + 3 * 86_400_000).withColumn(
        "output_tokens", F.col("output_tokens") + 1
    )
    writers.upsert_events(spark, later.withColumn("ord", F.lit(2).cast("long")), path)
    stored = spark.read.parquet(path).collect()
    assert len(stored) == 1
    assert stored[0]["ts_ms"] == one.first()["ts_ms"]
    assert stored[0]["output_tokens"] == one.first()["output_tokens"] + 1


def test_merge_upsert_order_independence_of_usage(spark):
    arrivals = as_events(views.usage_arrivals(spark, SF)).select(*NAMES, "ord")
    reverse = arrivals.withColumn("ord", -F.col("ord"))
    usage = ["dedup_key", "output_tokens", "total_tokens"]
    a = dedup_events(arrivals).select(*usage)
    b = dedup_events(reverse).select(*usage)
    assert a.exceptAll(b).count() == 0
    once = dedup_events(arrivals)
    again = merge_upsert(once.select(*NAMES), arrivals)
    assert again.select(*NAMES).exceptAll(once.select(*NAMES)).count() == 0


def test_stored_rollup_refresh_equals_direct(spark, tmp_path):
    events = views.usage_events(spark, SF)
    table, stored = str(tmp_path / "t"), str(tmp_path / "r")
    numbered = events.withColumn("ord", F.lit(0).cast("long"))
    first = writers.upsert_events(spark, numbered.filter("tool <> 'pi'"), table)
    jobs.refresh_stored_rollup(spark, table, stored, first)
    late = numbered.filter("tool = 'pi'")
    jobs.refresh_stored_rollup(spark, table, stored, writers.upsert_events(spark, late, table))
    direct = rollup.daily_rollup(as_events(events))
    got = spark.read.parquet(stored).select(*direct.columns)
    assert got.exceptAll(direct).count() == 0 and direct.exceptAll(got).count() == 0


def test_partition_pruning_and_pushdown(spark, tmp_path):
    from usagelens.functions.predicates import since

    path = str(tmp_path / "events")
    writers.write_events(views.usage_events(spark, SF), path)
    recent = since(spark.read.parquet(path), views.NOW_MS - 86_400_000).select("tool", "total_tokens")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert "GreaterThanOrEqual(ts_ms" in plan
    assert "session_id" not in plan.split("ReadSchema")[1]


def test_snapshots_keep_the_newest(spark, tmp_path):
    df = spark.range(3)
    kept = [writers.snapshot_table(df, str(tmp_path / "s"), f"2024-01-{i:02d}", keep=3) for i in range(1, 6)]
    assert kept[-1] == ["2024-01-03", "2024-01-04", "2024-01-05"]
    assert spark.read.parquet(str(tmp_path / "s" / "snapshot=2024-01-04")).count() == 3


def test_csv_and_cube_files(spark, tmp_path):
    from usagelens.operators.aggregate import sessions_report

    events = as_events(views.usage_events(spark, SF))
    writers.export_daily_csv(events, str(tmp_path / "d"), 30, views.NOW_MS)
    header = spark.read.text(str(tmp_path / "d")).first()["value"]
    assert header == "day,tool,input,cached_input,cache_write,output,total,calls"
    writers.export_sessions_csv(sessions_report(events), str(tmp_path / "s"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "s"))
    assert back.count() == sessions_report(events).count()
    writers.export_usage_cube(events, str(tmp_path / "c"), views.NOW_MS)
    cube = spark.read.json(str(tmp_path / "c" / "daily-usage-json"))
    total = events.filter(F.col("ts_ms") < views.NOW_MS).agg(F.sum("total_tokens")).first()[0]
    assert cube.agg(F.sum("tokens")).first()[0] == total
    assert spark.read.json(str(tmp_path / "c" / "checks")).first()["duplicate_keys"] == 0


def _reply(i: int, out: int) -> str:
    usage = {"input_tokens": 10, "output_tokens": out}
    body = {"timestamp": f"2024-03-0{1 + i % 3}T10:00:0{i % 10}.000Z", "type": "assistant", "sessionId": "s",
            "message": {"id": f"m{i}", "model": "kimi-k3", "usage": usage}}
    return json.dumps(body)


def test_log_reader_and_stream_equals_batch(spark, tmp_path):
    logs = tmp_path / "logs" / "p"
    logs.mkdir(parents=True)
    (logs / "a.jsonl").write_text("\n".join(_reply(i, 0) for i in range(5)) + "\n" + _reply(9, 1)[:20])
    (logs / "a.sync-conflict-1.jsonl").write_text(_reply(7, 7) + "\n")
    table, check = str(tmp_path / "t"), str(tmp_path / "ck")
    normalise = lambda lines: transcripts.norm_claude(lines, "ccmr")

    def run():
        stream = jobs.stream_lines(spark, str(tmp_path / "logs"), "ccmr")
        wanted = stream.filter(~F.col("path").contains("sync-conflict"))
        jobs.stream_events(wanted, normalise, table, check, str(tmp_path / "r")).awaitTermination(120)

    run()
    assert spark.read.parquet(table).count() == 5
    (logs / "b.jsonl").write_text("\n".join(_reply(i, 50 + i) for i in range(3, 8)) + "\n")
    run()
    stored = spark.read.parquet(table)
    batch = dedup_events(
        as_events(normalise(files.read_log_lines(spark, str(tmp_path / "logs"), "ccmr")))
        .select(*NAMES, "path", "pos")
        .withColumn("ord", F.col("path").contains("/b.").cast("long") * 1000 + F.col("pos") % 100)
        .drop("path", "pos")
    )
    assert rows_of(stored) == rows_of(batch)
    refreshed = spark.read.parquet(str(tmp_path / "r")).agg(F.sum("events")).first()[0]
    assert refreshed == stored.count() == 8


def test_incremental_listing(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.jsonl").write_text("{}\n")
    (tmp_path / "x" / "b.jsonl").write_text("{}\n{}\n")
    listing = files.list_files(spark, str(tmp_path / "x"), "pi")
    ledger = spark.createDataFrame(
        [tuple(r) + (1,) for r in listing.collect()], "path string, tool string, size long, mtime_ms long, version int"
    )
    assert files.new_or_changed_files(listing, ledger, 1).count() == 0
    assert files.new_or_changed_files(listing, ledger, 2).count() == 2
    (tmp_path / "x" / "b.jsonl").write_text("{}\n")
    changed = files.new_or_changed_files(files.list_files(spark, str(tmp_path / "x"), "pi"), ledger, 1).collect()
    assert [(r["path"].endswith("b.jsonl"), r["restart"]) for r in changed] == [(True, True)]
    gone = files.prune_ledger(ledger, listing.limit(0).select("path"), ["file:" + str(tmp_path / "elsewhere")])
    assert gone.count() == 2


def run_memory(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def source(spark, tmp_path, name, df, schema=None):
    """A stream over one parquet file per part."""
    folder = str(tmp_path / name)
    df.write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_throttle_equals_batch(spark, tmp_path):
    from usagelens.operators.leaderboard import throttle

    reports = spark.createDataFrame(
        [("a", t, n) for n, t in enumerate([0, 30_000, 60_000, 61_000, 119_999, 120_000, 400_000])]
        + [("b", 5, 100), ("b", 5, 101)], "id string, received_ms long, ord long")
    stream = source(spark, tmp_path, "rep", reports.coalesce(1))
    got = {(r["id"], r["received_ms"]) for r in run_memory(spark, stateful.stream_throttle(stream), "thr").collect()}
    batch = {(r["id"], r["received_ms"]) for r in throttle(reports).collect()}
    assert got == batch == {("a", 0), ("a", 60_000), ("a", 120_000), ("a", 400_000), ("b", 5)}


def test_stream_alert_edges(spark, tmp_path):
    levels = spark.createDataFrame(
        [("balance", 1, 1), ("balance", 2, 1), ("balance", 3, 2), ("balance", 4, 1), ("balance", 6, 1)],
        "key string, round long, level int")
    out = run_memory(spark, stateful.alert_edges(source(spark, tmp_path, "lv", levels.coalesce(1))), "edg")
    assert [r["notify"] for r in out.orderBy("round").collect()] == [True, False, True, False, True]


def test_stream_pair_latency_and_ledgers(spark, tmp_path):
    # the last send before the reply counts; the sends of a log arrive with or before its replies
    sent = spark.createDataFrame([("/f", "r1", 500), ("/f", "r1", 1000), ("/f", "r1", 4000), ("/f", "r2", 1000)],
                                 "path string, ref string, sent_ms long")
    got = spark.createDataFrame([("/f", "r1", "k1", 3000), ("/f", "r2", "k2", 2_000_000)],
                                "path string, ref string, dedup_key string, ts_ms long")
    pairs = stateful.stream_pair_latency(source(spark, tmp_path, "q", sent.coalesce(1)), source(spark, tmp_path, "a", got.coalesce(1)))
    assert [tuple(r) for r in run_memory(spark, pairs, "prs").collect()] == [("k1", 2000)]
    calls = views.tool_calls(spark, SF)
    twice = calls.unionByName(calls)
    unique = run_memory(spark, jobs.stream_dedup_ledger(source(spark, tmp_path, "tc", twice.coalesce(1))), "led")
    assert unique.count() == calls.count()


def test_stream_daily_usage_and_freshness(spark, tmp_path):
    events = views.usage_events(spark, SF)
    daily = run_memory(spark, jobs.stream_daily_usage(source(spark, tmp_path, "ev", events.coalesce(1))), "dly", "complete")
    from usagelens.operators.aggregate import by_day_tool

    batch = by_day_tool(events, 0, views.NOW_MS)
    assert daily.select("day", "tool", "total").exceptAll(batch).count() == 0
    fresh = run_memory(spark, jobs.stream_freshness(source(spark, tmp_path, "ev2", events.coalesce(1))), "frs", "complete")
    assert fresh.agg(F.sum("n")).first()[0] == events.count()


def test_stream_live_context(spark, tmp_path):
    snaps = spark.createDataFrame([("s", 1000, 5), ("s", 2000, 9), ("t", 1500, 1)], "session_id string, ts_ms long, context_tokens long")
    out = run_memory(spark, stateful.stream_live(source(spark, tmp_path, "lc", snaps.coalesce(1))), "liv", "update")
    newest = {r["session_id"]: r["context_tokens"] for r in out.filter("live").orderBy("ts_ms").collect()}
    assert newest == {"s": 9, "t": 1}


def _message_rows(seed: int) -> list[dict]:
    rng, rows = random.Random(seed), []
    for n in range(400):
        message = rng.randint(0, 30)
        key = f"claude-code:message:{message}" if rng.random() < 0.6 else f"claude-code:{message}:r{rng.randint(0, 2)}"
        fields = {c: rng.choice([None, None, f"{c}{rng.randint(0, 9)}"]) for c in ("model", "project", "session_id")}
        rows.append({"dedup_key": key, "ord": n, "tool": "claude-code", "usage_quality": rng.randint(0, 2), **fields,
                     "output_tokens": rng.randint(0, 3), "total_tokens": rng.randint(0, 2), "duration_ms": rng.choice([None, -5, rng.randint(0, 9)]),
                     "device": rng.choice(["unknown", "unknown", "laptop", "tower"])})
    return rows


def test_merge_upsert_of_messages_against_brute_force(spark, tmp_path):
    rows = _message_rows(3)
    names = ["dedup_key", "ts_ms", "trace_id", *USAGE_COLUMNS, "tool", "model", "project", "session_id", "duration_ms", "device", "usage_quality"]
    kinds = {c: "long" for c in ["ts_ms", "duration_ms", *USAGE_COLUMNS]} | {"usage_quality": "int"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names) + ", ord long"
    spark.createDataFrame([tuple(r.get(c) for c in [*names, "ord"]) for r in rows], schema).write.parquet(str(tmp_path / "rows"))
    arrivals = spark.read.parquet(str(tmp_path / "rows"))
    merged = merge_upsert(arrivals.filter("ord < 0").drop("ord"), arrivals)

    new = {r["dedup_key"] for r in rows if ":message:" in r["dedup_key"]}
    groups: dict[str, list] = {}
    for r in rows:
        joined = "claude-code:message:" + r["dedup_key"].split(":")[1]
        groups.setdefault(r["dedup_key"] if r["dedup_key"] in new or joined not in new else joined, []).append(r)
    expected = []
    for key, group in groups.items():
        w = dict(max(group, key=lambda r: (r["usage_quality"] or 2, r["output_tokens"], r["total_tokens"], -r["ord"])))
        for c in ("model", "project", "session_id"):
            # the fields of a message's later arrivals; an unobserved old key has none
            after = [r[c] for r in group if r["ord"] > w["ord"] and r[c] is not None] if key in new else []
            w[c] = w[c] if w[c] is not None else next(iter(after), None)
        own = [r for r in rows if r["dedup_key"] == key]
        longest = max((r["duration_ms"] for r in own if (r["duration_ms"] or 0) > 0), default=None)
        known = next((r["device"] for r in own if r["device"] != "unknown"), None)
        expected.append((key, w["model"], w["project"], w["session_id"], max((x for x in (w["duration_ms"], longest) if x is not None), default=None),
                         known or w["device"], w["usage_quality"] or 2))
    got = merged.select("dedup_key", "model", "project", "session_id", "duration_ms", "device", "usage_quality")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    # one pass folds all rules; what reads the rows again are the two look-backs
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 8
