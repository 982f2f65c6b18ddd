"""The ingest call: what it reads, what it stores, and what a second run does."""

from __future__ import annotations

import json

import pytest

from usagelens.operators.dedup import dedup_events
from usagelens.schema import EVENT_SCHEMA, as_events
from usagelens.sources import rollouts, tail, transcripts
from usagelens.streaming import ingest
from pyspark.sql import functions as F

from tests_support import iso, rollout_records

NAMES = EVENT_SCHEMA.fieldNames()


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def write(path, records, mode="a"):
    with open(path, mode) as f:
        f.write("".join(json.dumps(r, separators=(",", ":")) + "\n" for r in records))


def rows_of(df):
    return sorted(map(tuple, df.select(*NAMES).collect()), key=str)


def reply(i):
    usage = {"input_tokens": 10 + i, "output_tokens": 5}
    return {"timestamp": iso(1_710_000_000_000 + 1000 * i), "type": "assistant", "sessionId": "s", "message": {"id": f"m{i}", "model": "kimi-k3", "usage": usage}}


def test_rollouts_are_read_again_only_when_they_change(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    table, ledger = str(tmp_path / "t"), str(tmp_path / "l")
    records = {i: rollout_records(i) for i in range(3)}
    for i, all_ in records.items():
        write(folder / f"f{i}.jsonl", all_[:6])

    def run():
        return ingest.ingest_folder(spark, str(folder), "codex", rollouts.norm_codex, table, ledger)

    assert run() == 3
    assert run() == 0
    write(folder / "f1.jsonl", records[1][6:])
    assert run() == 1
    lines = tail.read_tail(spark, str(folder), "codex")
    batch = as_events(rollouts.norm_codex(lines)).select(*NAMES, F.lit(0).cast("long").alias("ord"))
    assert rows_of(spark.read.parquet(table)) == rows_of(dedup_events(batch))
    assert len(ingest._versions(spark, ledger)) == 2


def test_lines_that_stand_alone_are_read_from_the_cursor(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    table, ledger = str(tmp_path / "t"), str(tmp_path / "l")
    seen = []

    def normalise(lines):
        seen.append(lines.count())
        return transcripts.norm_claude(lines, "ccmr")

    def run(**more):
        return ingest.ingest_folder(spark, str(folder), "ccmr", normalise, table, ledger, whole=False, **more)

    write(folder / "a.jsonl", [reply(i) for i in range(4)])
    write(folder / "b.jsonl", [reply(9)])
    run()
    write(folder / "a.jsonl", [reply(4)])
    run()
    assert seen == [5, 1] and spark.read.parquet(table).count() == 6
    assert run(version=2) == 2 and seen[-1] == 6
    (folder / "b.jsonl").unlink()
    assert run(version=2, live_roots=[f"file:{folder}"]) == 0
    assert [r["path"].rsplit("/", 1)[1] for r in ingest.load_ledger(spark, ledger).collect()] == ["a.jsonl"]
    assert spark.read.parquet(table).count() == 6
