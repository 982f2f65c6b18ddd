"""Greedy selection with a minimum gap: the first instant of a key, then always the first one a gap or more later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.operators.skew import running
from usagelens.session import cut_lineage

#: gaps in a time slice, the unit in which a key's instants are ordered
SLICE_GAPS = 64


def _followers(instants: DataFrame, keys: list[str], time: str, gap_ms: int) -> DataFrame:
    """keys, time, prev (the instant before), next (the first one ``gap_ms`` or more later); null where there is none.

    Instants and the targets a gap behind them are put in one descending order, in which the next instant is the last
    one seen; a slice of a key's time is one window partition, so a key spreads over as many tasks as it has slices.
    """
    width = SLICE_GAPS * gap_ms
    own = instants.select(*keys, F.col(time).alias("_at"), F.floor(F.col(time) / width).alias("_slice"))
    before = running(own, keys, "_slice", ["_at"], {"prev": ("max_before", F.col("_at"))}, null_keys=True)
    targets = own.select(*keys, (-F.col("_at") - gap_ms).alias("_down"), F.lit(1).alias("_tie"), F.lit(None).cast("long").alias("_seen"), F.col("_at").alias("_of"))
    marks = own.select(*keys, (-F.col("_at")).alias("_down"), F.lit(0).alias("_tie"), F.col("_at").alias("_seen"), F.lit(None).cast("long").alias("_of"))
    both = targets.unionByName(marks).withColumn("_slice", F.floor(F.col("_down") / width))
    after = running(both, keys, "_slice", ["_down", "_tie"], {"next": ("last", F.col("_seen"))}, null_keys=True).filter("_tie = 1")
    named = after.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_of", "next")
    return before.join(named, _same(keys, F.col("_at") == F.col("_of"))).select(*keys, F.col("_at").alias(time), "prev", "next")


def spaced(rows: DataFrame, keys: list[str], time: str, gap_ms: int) -> DataFrame:
    """The selected instants (keys, time) of every key; nulls of a key are a key.

    An instant that comes a gap or more after the one before it is selected whatever came earlier, so keys fall apart
    into stretches without such gaps. Inside a stretch, pointers to the next candidate double: in round n the selected
    ones mark those 2^n steps on, and pointers that leave the stretch are gone. A stretch of m selected instants takes
    log2(m) rounds, each over the shared-storage result of the one before.
    """
    instants = rows.select(*keys, time).distinct()
    linked = _followers(instants, keys, time, gap_ms)
    first = F.col("prev").isNull() | (F.col(time) - F.col("prev") >= gap_ms)
    linked = cut_lineage(linked.select(*keys, F.col(time).alias("at"), first.alias("first"), "next"))
    chosen = linked.filter("first").select(*keys, "at")
    # a pointer to a start of a stretch has nothing to mark
    starts = chosen.select(*[F.col(c).alias(f"_k_{c}") for c in chosen.columns])
    inner = linked.filter("next IS NOT NULL").join(starts, _same(keys, F.col("next") == F.col("_k_at")), "left_anti")
    steps = cut_lineage(inner.select(*keys, "at", "next"))
    while not steps.isEmpty():
        ahead = steps.select(*[F.col(c).alias(f"_k_{c}") for c in steps.columns])
        marked = chosen.join(ahead, _same(keys, F.col("at") == F.col("_k_at"))).select(*keys, F.col("_k_next").alias("at"))
        doubled = steps.join(ahead, _same(keys, F.col("next") == F.col("_k_at"))).select(*keys, "at", F.col("_k_next").alias("next"))
        chosen, steps = cut_lineage(chosen.unionByName(marked).distinct()), cut_lineage(doubled)
    return chosen.select(*keys, F.col("at").alias(time))


def _same(keys: list[str], condition: Column) -> Column:
    """``condition`` for rows of one key; the right side's columns begin with _k_."""
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return condition
