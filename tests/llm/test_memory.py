"""What the operators leave in an executor: Python workers, rows gathered around a row, Arrow's unused memory."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from usagelens.llm import common, jaccard_join
from usagelens.llm.byte_bpe import decode_ids, encode_texts, read_ranks
from usagelens.llm.queries import byte_bpe_digests

from .conftest import words


def operators(df):
    """The physical plan as (name, operators above it in the same stage, all operators below it)."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        root = df.select("*")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

    def walk(node, above):
        name, children = node.nodeName(), node.children()
        over = [] if "Exchange" in name else [*above, name]
        below = []
        for i in range(children.size()):
            for found in walk(children.apply(i), over):
                below.append(found[0])
                yield found
        yield name, above, below

    return list(walk(root, []))


def test_tokeniser_has_one_python_function_a_stage(awkward):
    found = operators(byte_bpe_digests(awkward))
    python = [(name, above) for name, above, _ in found if name == "MapInArrow"]
    assert python and not any("MapInArrow" in above for _, above in python)


@pytest.mark.parametrize("chunk,overlap", [(32_768, 1_024), (50, 8)])
def test_decoding_in_the_same_task(awkward, nothing, chunk, overlap):
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    apart = decode_ids(encode_texts(awkward, ranks, public_tokenizers.PATTERN, chunk, overlap), ranks)
    once = encode_texts(awkward, ranks, public_tokenizers.PATTERN, chunk, overlap, decoded=True)
    assert once.schema == apart.schema
    assert sorted(map(repr, once.collect())) == sorted(map(repr, apart.collect()))
    assert encode_texts(nothing, ranks, public_tokenizers.PATTERN, decoded=True).count() == 0


def test_entries_of_one_set_are_not_windowed_over(spark):
    rows = spark.createDataFrame([(i, " ".join(words(i, 30))) for i in range(20)], "doc_id long, text string")
    rows = rows.withColumn("text", F.col("text").cast("binary"))
    none = (np.empty(0, np.uint64), np.empty(0, np.int64))
    entries = jaccard_join.index_entries(rows, none)
    windows = [below for name, _, below in operators(entries) if name == "Window"]
    # the keys' sizes are counted first; the rows around a row come after the filter by size
    assert len(windows) >= 2 and any("Filter" in below[below.index("Window") :] for below in windows if "Window" in below)
    assert entries.rdd.getNumPartitions() == jaccard_join.ENTRY_TASKS * common.tasks_for(rows)


def test_workers_give_back_unused_memory(monkeypatch):
    class Pool:
        given_back = 0

        def release_unused(self):
            self.given_back += 1

    pool = Pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    assert list(common.tidy(lambda rows: (2 * r for r in rows))(iter([1, 2]))) == [2, 4]
    assert pool.given_back == 1
