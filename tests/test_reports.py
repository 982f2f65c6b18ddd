"""Calendar, prices, leaderboard, alerts, speed, slots and plan shape on small tables."""

from __future__ import annotations

from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions import names, predicates, times
from usagelens.operators import alerts, cost, leaderboard, quantiles, sequence, topk
from usagelens.operators.skew import literal_table, running, salted_join
from usagelens.sources import configs, exports, files


def ms(*parts) -> int:
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize(
    "zone, now, days, start",
    [
        ("America/New_York", ms(2026, 3, 9, 12), 7, ms(2026, 3, 3, 5)),
        ("America/New_York", ms(2026, 11, 2, 12), 7, ms(2026, 10, 27, 4)),
        ("Europe/Berlin", ms(2026, 3, 30, 12), 2, ms(2026, 3, 28, 23)),
        ("Asia/Shanghai", ms(2026, 1, 1, 1), 30, ms(2025, 12, 2, 16)),
    ],
)
def test_range_starts_follow_the_calendar(spark, zone, now, days, start):
    assert times.local_range_start(days, now, zone) == start
    column = times.local_day_start_col(F.lit(now), 1 - days, zone)
    assert spark.range(1).select(column.alias("s")).first()["s"] == start


def test_peak_hours(spark):
    cases = {
        ms(2026, 9, 14, 0, 59): False, ms(2026, 9, 14, 1): True, ms(2026, 9, 14, 3, 59): True,
        ms(2026, 9, 14, 4): False, ms(2026, 9, 14, 5, 59): False, ms(2026, 9, 14, 6): True,
        ms(2026, 9, 14, 9, 59): True, ms(2026, 9, 14, 10): False, ms(2026, 9, 12, 2): False,
        ms(2026, 9, 13, 7): False, ms(2026, 9, 18, 9): True, ms(2026, 9, 19, 9): False,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t long")
    got = {r["t"]: r["p"] for r in rows.withColumn("p", times.is_peak(F.col("t"))).collect()}
    assert got == cases


def one_million(spark, rows, now=ms(2026, 10, 20)):
    """Cost of a million tokens of each kind per (tool, model), outside peak time, rate 2."""
    frame = spark.createDataFrame(
        [(t, m, False, False, *[1_000_000] * 4) for t, m in rows],
        "tool string, model string, peak boolean, long_context boolean, fi long, ci long, cw long, oi long",
    )
    priced = cost.price_groups(cost.resolve_price(frame, now, "2"))
    return {(r["tool"], r["model"]): r["c"] for r in priced.select("*", cost.money(F.col("cost_e6")).alias("c")).collect()}


def test_official_prices_and_aliases(spark):
    got = one_million(spark, [
        ("antigravity", "gemini-3.8-flash-n"), ("kimi", "k3"), ("pi", "k3"), ("workbuddy", "hy4-preview-f"),
        ("grok", "grok-4.6-build"), ("cursor", "claude-opus-5-5-max"), ("pi", "claude-opus-5-5-max"),
        ("claude-code", "claude-opus-5-5"), ("opencode", "mimo-v2.5-free"), ("pi", "qwen4-max"),
        ("pi", "deepseek-v4-pro"), ("pi", None),
    ])
    assert got == {
        ("antigravity", "gemini-3.8-flash-n"): 9.15, ("kimi", "k3"): 142.0, ("pi", "k3"): None,
        ("workbuddy", "hy4-preview-f"): 24.3, ("grok", "grok-4.6-build"): 17.0,
        ("cursor", "claude-opus-5-5-max"): 70.08, ("pi", "claude-opus-5-5-max"): None,
        ("claude-code", "claude-opus-5-5"): 58.4, ("opencode", "mimo-v2.5-free"): 0.0,
        ("pi", "qwen4-max"): 53.0, ("pi", "deepseek-v4-pro"): 5.324, ("pi", None): None,
    }
    later = one_million(spark, [("pi", "gemini-4-argon")], ms(2026, 12, 1))
    assert later == {("pi", "gemini-4-argon"): 48.4}


def test_long_context_border(spark):
    rows = spark.createDataFrame(
        [("pi", 199_999, 0), ("pi", 199_000, 1000), ("cursor", 900_000, 0)], "tool string, i long, c long")
    flag = predicates.is_long_context(F.col("tool"), F.col("i"), F.col("c"), F.lit(0))
    assert [r["x"] for r in rows.select(flag.alias("x")).collect()] == [False, True, False]


def test_config_files(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"usd_to_cny": 7.1, "usd_to_cny_manual": true, "models": {"m": {"currency": "USD", "input_miss": 1, "input_hit": 0.1, "output": 2}}}')
    book, rate = configs.load_price_book(spark, str(tmp_path / "p.json"))
    assert [r["book_model"] for r in book.collect()] == ["m"] and rate == Decimal("7.1")
    (tmp_path / "bad.json").write_text("{")
    assert configs.load_price_book(spark, str(tmp_path / "bad.json"))[0].count() == len(fixed.SEED_PRICES)
    assert configs.load_subscriptions(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "s.json").write_text('{"monthly": {"_note": "x", "zcode-glm": {"tool": "zcode", "models": "GLM", "price_cny": 49}}}')
    assert [(r["tool"], r["price_cny"]) for r in configs.load_subscriptions(spark, str(tmp_path / "s.json")).collect()] == [("zcode", 49.0)]
    (tmp_path / "a.json").write_text('{"version": 1, "rules": [{"id": "x", "metric": "balance", "enabled": true, "warn": 1, "crit": 5}]}')
    assert configs.load_alert_rules(spark, str(tmp_path / "a.json")).count() == 4
    (tmp_path / "c.json").write_text(
        '{"azure/m": {"input_cost_per_token": 3e-6}, "vendor/m": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6},'
        '"openrouter/m": {"input_cost_per_token": 9e-6}, "free": {"output_cost_per_token": 1}}')
    rows = configs.load_price_catalog(spark, str(tmp_path / "c.json")).collect()
    assert [(r["catalog_model"], float(r["input"]), float(r["output"])) for r in rows] == [("m", 1.0, 2.0)]


def test_path_layouts(spark):
    base = "/x/local-agent-mode-sessions/a/b/agent/local_ditto_1"
    rows = [
        ("/h/.claude/projects/p/s.jsonl", "claude-code", True), (f"{base}/audit.jsonl", "claude-code", True),
        (f"{base}/.claude/projects/p/t.jsonl", "claude-code", True), (f"{base}/outputs/t.jsonl", "claude-code", False),
        ("/s/r.jsonl.zst", "codex", True), ("/s/r.jsonl.zst", "pi", False), ("/k/wire.jsonl", "kimi", True),
        ("/k/other.jsonl", "kimi", False), ("/a/transcript-2.jsonl", "antigravity", True), ("/a/meta.jsonl", "antigravity", False),
    ]
    frame = spark.createDataFrame(rows, "path string, tool string, keep boolean")
    kept = {(r["path"], r["tool"]) for r in files.match_source_path(frame).collect()}
    assert kept == {(p, t) for p, t, keep in rows if keep}


def test_quantiles_match_the_definition(spark):
    import math
    import random

    rng = random.Random(7)
    groups = {n: [rng.choice([0.5, 2.25, rng.random() * 50 + 0.01]) for _ in range(n)] for n in (1, 2, 3, 10, 51, 300)}
    rows = spark.createDataFrame([(n, x) for n, xs in groups.items() for x in xs], "g long, value double")
    for r in quantiles.median_and_p90(rows, ["g"]).collect():
        xs = sorted(groups[r["g"]])
        n = len(xs)
        median = xs[n // 2] if n % 2 else (xs[n // 2 - 1] + xs[n // 2]) / 2
        assert (r["n"], r["median"], r["p90"]) == (n, median, xs[max(1, math.ceil(0.9 * n)) - 1])


def test_running_values_do_not_depend_on_chunks(spark):
    rows = spark.createDataFrame([(k, i, i % 3 or None) for k in "ab" for i in range(20)], "k string, i long, x long")
    results = []
    for size in (1, 4, 100):
        chunked = rows.withColumn("c", F.floor(F.col("i") / size))
        out = running(chunked, ["k"], "c", ["i"], {
            "s": ("sum", F.col("x")), "b": ("sum_before", F.col("x")), "l": ("last_before", F.col("x")), "m": ("max", F.col("x"))})
        results.append(sorted(map(tuple, out.select("k", "i", "s", "b", "l", "m").collect())))
    assert results[0] == results[1] == results[2]


def test_salted_join_equals_join(spark):
    big = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), (None, 2)], "k string, i long")
    small = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "k string, s int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, salted = big.join(small, ["k"], how), salted_join(big, small, ["k"], how, spread_by="i")
        assert plain.exceptAll(salted).count() == 0 and salted.count() == plain.count()


def test_blocks_are_anchored_at_their_first_event(spark):
    now, hour = ms(2026, 1, 10, 12), fixed.HOUR_MS
    rows = [("a", now - 9 * hour), ("a", now - 5 * hour), ("a", now - 4 * hour + 1), ("a", now - hour), (None, now - 5 * hour), ("b", now - 6 * hour)]
    events = spark.createDataFrame(rows, "session_id string, ts_ms long").select(
        "*", F.lit("claude-code").alias("tool"), F.lit(10).cast("long").alias("total_tokens"))
    r = sequence.anchored_blocks(events, now).first()
    assert (r["active"], r["window_calls"], r["window_start"]) == (True, 2, now - 4 * hour + 1)


def test_player_board_and_plausibility(spark):
    now = ms(2026, 9, 20, 6)
    schema = "day_tokens double, day_requests double, week_tokens double, month_tokens double"
    cases = [
        ((1.1e9, 6355.0, 5e9, 9e9), None), ((-1.0, 1.0, 1.0, 1.0), fixed.REASON_NUMBERS), ((None, 1.0, 1.0, 1.0), fixed.REASON_NUMBERS),
        ((2.1e10, 9e4, 3e10, 3e10), fixed.REASON_DAY), ((1.0, 3e5, 1.0, 1.0), fixed.REASON_REQUESTS),
        ((5.0, 0.0, 5.0, 5.0), fixed.REASON_NO_REQUESTS), ((1e8, 10.0, 1e8, 1e8), fixed.REASON_PER_REQUEST),
        ((10.0, 1.0, 9.0, 10.0), fixed.REASON_WINDOWS), ((10.0, 1.0, 2e11, None), fixed.REASON_TOTALS), ((10.0, 1.0, 10.0, None), None),
        ((float("nan"), 1.0, 1.0, 1.0), fixed.REASON_NUMBERS),
    ]
    frame = spark.createDataFrame([(*row, i) for i, (row, _) in enumerate(cases)], schema + ", i int")
    got = {r["i"]: r["reason"] for r in leaderboard.validate_reports(frame, now).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(cases)}
    early = leaderboard.validate_reports(frame.limit(1).withColumn("day_tokens", F.lit(6e9)).withColumn("day_requests", F.lit(9e4)), ms(2026, 9, 20)).first()
    assert early["reason"] == fixed.REASON_GROWTH

    players = spark.range(206).select(
        F.concat(F.lit("id"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("id"),
        F.lit("2026-09-20").alias("day"), (F.lit(1000) - F.floor(F.col("id") / 2)).alias("day_tokens"),
        F.lit(now - 1000).alias("updated_at"))
    board = leaderboard.leaderboard(players, "day", "tokens", now, "id204").collect()
    assert len(board) == 51 and {r["player_count"] for r in board} == {206}
    assert [r["position"] for r in board if r["is_me"]] == [205]
    ranked = leaderboard.rank_players(players, "day_tokens").orderBy("position").collect()
    assert [r["position"] for r in ranked] == list(range(1, 207))
    assert [r["id"] for r in ranked] == [f"id{i:03d}" for i in range(206)]


def test_server_windows_roll(spark):
    rows = [("u", f"2026-09-{d:02d}", 600_000_000 if d == 1 else 100_000_000, 1) for d in range(1, 10)]
    daily = spark.createDataFrame(rows, "id string, day string, tokens long, updated_at long")
    r = leaderboard.server_windows(daily, "2026-09-09").first()
    assert (r["week_tokens"], r["month_tokens"]) == (700_000_000, 1_400_000_000)


def test_alert_keys_and_order(spark):
    values = spark.createDataFrame(
        [("balance", "a b", "a b", 1.5, "CNY"), ("codex_quota_pct", None, None, 80.0, None)],
        "metric string, suffix string, provider string, value double, currency string")
    rules = literal_table(spark, [*[(*r, None) for r in fixed.DEFAULT_ALERT_RULES], ("own~rule (1)", "balance", True, 5.0, None, "a b")], alerts.RULE_SCHEMA)
    got = [(r["key"], r["level"]) for r in alerts.evaluate_alerts(values, rules).collect()]
    assert got == [("balance:a%20b", "crit"), ("balance:a%20b:rule:own~rule%20(1)", "warn"), ("codex_quota_pct", "warn")]


def test_slots_stay_with_their_names(spark):
    known = spark.createDataFrame([("b", 0), ("gone", 1), ("c", 9)], "name string, slot long")
    drawn = spark.createDataFrame([("c",), ("b",), ("a",)], "name string")
    got = {r["name"]: r["slot"] for r in topk.assign_slots(drawn, known, 4).collect()}
    assert got == {"b": 0, "a": 1, "c": 2}


def test_arguments():
    assert [predicates.parse_range_days(x) for x in (None, " ", "7", "0", "-1", "1.5", "x", "99999", "nan")] == [30, 30, 7, 0, 30, 30, 30, 3650, 30]
    assert predicates.parse_device("vps") == "vps" and predicates.parse_device("mac") is None
    with pytest.raises(ValueError):
        predicates.scope_device({}, "mac")


def test_number_formats(spark):
    cases = [(999.0, "999"), (1250.0, "1.3K"), (1_005_000_000.0, "1.00B"), (1_125_000_000.0, "1.13B"), (12_345_678.0, "12.3M")]
    rows = spark.createDataFrame([(x,) for x, _ in cases], "x double")
    assert [r["t"] for r in rows.select(names.fmt_compact(F.col("x")).alias("t")).collect()] == [t for _, t in cases]


def test_quota_payload_shapes(spark):
    bodies = ['{"five_hour":{"used_percent":140},"weekly_scoped":[{"label":"Opus","percent":3}]}',
              '{"seven_day_opus":{"percent":1}}', '{"limits":[{"kind":"session","percent":1}]}', "{}", "[", '{"seven_day":{"x":1}}']
    frame = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "ts_ms long, body string")
    got = {(r["ts_ms"], r["label"], r["used_percent"]) for r in exports.norm_official_quota(frame).collect()}
    assert got == {(0, "five_hour", 100.0), (0, "Opus", 3.0)}


def test_small_dimensions_broadcast_and_groups_are_priced(spark):
    from usagelens.plans import views

    priced = cost.costs(views.usage_events(spark, "/root/testdata/sf0.001"), views.NOW_MS)
    plan = priced._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 3
    assert plan.count("Exchange hashpartitioning") == 1
