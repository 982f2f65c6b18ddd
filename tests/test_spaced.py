"""Greedy selection with a minimum gap against the sequential rule."""

from __future__ import annotations

import random

import pytest

from usagelens.operators import leaderboard, sequence
from usagelens.operators.spaced import spaced


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def sequential(rows, gap):
    out, last = [], {}
    for key, at in sorted(set(rows), key=lambda r: (str(r[0]), r[1])):
        if key not in last or at - last[key] >= gap:
            last[key] = at
            out.append((key, at))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,gap", [(1, 10)])
def test_equals_the_sequential_rule(spark, seed, gap):
    rng = random.Random(seed)
    # a hot key without pauses over many slices, keys with pauses, one of repeated instants, one without a name
    rows = [("hot", t) for t in range(0, 1500, 3)] + [("one", 5)] * 3 + [(None, rng.randrange(300)) for _ in range(60)]
    for key in "abcd":
        at = rng.randrange(1000)
        for _ in range(60):
            at += rng.choice([0, 1, 2, gap - 1, gap, gap + 1, 65 * gap])
            rows.append((key, at))
    df = spark.createDataFrame(rows, "id string, t long").repartition(3)
    assert sorted(map(tuple, spaced(df, ["id"], "t", gap).collect()), key=str) == sequential(rows, gap)
    assert spaced(df.limit(0), ["id"], "t", gap).collect() == []


def test_throttle_takes_no_python(spark):
    reports = spark.createDataFrame([("a", t, n) for n, t in enumerate([0, 30, 60, 61, 119, 120, 400, 400])], "id string, received_ms long, ord long")
    kept = leaderboard.throttle(reports, 60)
    assert sorted(r["ord"] for r in kept.collect()) == [0, 2, 5, 6]
    assert "Python" not in kept._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_a_session_of_several_days(spark):
    hour = 3_600_000
    # an event every two hours for six days: blocks start every six hours
    rows = [("s", 2 * hour * i, "claude-code", 1) for i in range(72)]
    events = spark.createDataFrame(rows, "session_id string, ts_ms long, tool string, total_tokens long")
    now = 2 * hour * 71 + 1
    got = sequence.anchored_blocks(events, now).first()
    assert (got["active"], got["window_start"], got["window_tokens"]) == (True, 138 * hour, 3)
    shifted = sequence.anchored_blocks(events, now, lookback_ms=20 * hour).first()
    assert shifted["window_start"] != got["window_start"]
