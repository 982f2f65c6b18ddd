"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.scratch import Scratch


def connected(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, root for every node of ``edges(a, b)``: the least node of its component.

    In each round a node takes the least root among its neighbours' and then the root of that one, so the reach
    of a node doubles at least. A round is one job: its table is written to shared storage, and the rows that
    changed are counted on the way. It ends when none did. Least values are partly formed before every shuffle, and
    joins precede another exchange, so that a hub's rows can be split.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    first = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels, turn = scratch.save(first.select(F.col("a").alias("node"), "root"), f"{name}-0"), 0
    while True:
        roots = labels.select(F.col("node").alias("b"), "root")
        near = both.join(roots, "b").groupBy("a").agg(F.min("root").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("root").alias("up"))
        jumped = stepped.join(up, "next").select("node", F.least("next", "up").alias("root"), (F.col("root") != F.least("next", "up")).alias("moved"))
        saved, seen = scratch.save_and_count(jumped, f"{name}-{turn + 1}", moved=F.count_if("moved"))
        scratch.drop(f"{name}-{turn}")
        labels, turn = saved.select("node", "root"), turn + 1
        if not seen["moved"]:
            return labels
