"""SimHash near-duplicates by multi-index hashing.

Equal fingerprints are one node. A fingerprint is cut into segments, each with a table from its value to the
fingerprints that have it. Two fingerprints that differ in at most r bits differ in at most r // m bits in one of
the first r % m + 1 of m segments, or in at most r // m - 1 in one of the others. So the small Hamming ball
around the value of each segment is enumerated, the table is asked for every value of the ball, and what it
returns is verified on the whole fingerprints. Of each ball only the values not above the own one are asked for:
the other side of a pair asks for the rest.

A value that more than ``HOT`` fingerprints share is not looked up in its table, where it would give the square
of their number: its probes enumerate the ball of the remaining segments too and ask for whole fingerprints, a
number of probes that doesn't depend on how many share the value.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import FOLD_BYTES, tasks_for, text_rows
from usagelens.llm.components import connected
from usagelens.llm.scratch import Scratch
from usagelens.operators.skew import BROADCAST_ROWS, salted_join

BITS = 64
SHINGLE = 3
SEED = 42
#: shingles that are hashed and counted at once
AT_ONCE = 65_536
#: fingerprints under one value of a segment that are compared one by one
HOT = 512


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of a text over the XXH64 of its shingles, repeats included; 0 without words."""
    words = text.translate(FOLD_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    take = min(size, len(words))
    begins, ends = begins[: len(words) - take + 1], ends[take - 1 :]
    votes = np.zeros(BITS, np.int64)
    for start in range(0, len(begins), AT_ONCE):
        spans = zip(begins[start : start + AT_ONCE].tolist(), ends[start : start + AT_ONCE].tolist())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, (joined[i:j] for i, j in spans), repeat(SEED)), np.dtype("<u8"))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    marks = np.packbits(2 * votes > len(begins), bitorder="little")
    return int(marks.view(np.dtype("<u8"))[0])


def fingerprints(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of ``rows(doc_id, text as binary)``."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py(), size) for text in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(describe, "doc_id long, fp long")


def segment_balls(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of the segments that have to be searched."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    radius, full = divmod(distance, segments)
    found = [(edges[i], edges[i + 1] - edges[i], radius if i <= full else radius - 1) for i in range(segments)]
    return [segment for segment in found if segment[2] >= 0]


def flips(first: int, bits: int, least: int, most: int) -> list[int]:
    """Signed masks of ``least`` to ``most`` of the given bits."""
    masks = [
        sum(1 << (first + i) for i in chosen) for n in range(least, most + 1) for chosen in combinations(range(bits), n)
    ]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _value(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _constants(masks: list[int]) -> Column:
    """An array of longs that the optimiser folds to one constant."""
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")


def _listed(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys, key, how)


def similar_pairs(nodes: DataFrame, distance: int, segments: int, hot: int, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: all pairs of ``nodes(fp)``, distinct fingerprints, that differ in at most ``distance`` bits."""
    pairs = None
    for number, (first, bits, radius) in enumerate(segment_balls(distance, segments)):
        value = _value(F.col("fp"), first, bits)
        masks = _constants(flips(0, bits, 0, radius))
        held = nodes.select("fp", value.alias("value"))
        asked = nodes.select("fp", value.alias("own"), F.explode(masks).alias("mask")).select(
            "fp", "own", F.col("own").bitwiseXOR(F.col("mask")).alias("value")
        )
        asked = asked.filter(F.col("value") <= F.col("own"))
        often = scratch.save(held.groupBy("value").count().filter(F.col("count") > hot).select("value"), f"often-{number}")
        any_often = not often.isEmpty()
        if any_often:
            warm = _listed(asked, often, "value", "left_semi")
            held, asked = _listed(held, often, "value", "left_anti"), _listed(asked, often, "value", "left_anti")
        differ = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp")))
        found = (
            asked.alias("p")
            .join(held.alias("t"), F.col("p.value") == F.col("t.value"))
            .filter((differ <= distance) & ((F.col("p.own") != F.col("p.value")) | (F.col("p.fp") < F.col("t.fp"))))
            .select(F.least("p.fp", "t.fp").alias("a"), F.greatest("p.fp", "t.fp").alias("b"))
        )
        pairs = found if pairs is None else pairs.union(found)
        if any_often:
            rest = [m for at, n in ((0, first), (first + bits, BITS - first - bits)) for m in flips(at, n, 1, 1)]
            for spent in range(radius + 1):
                step = warm.filter(F.bit_count(F.col("own").bitwiseXOR(F.col("value"))) == spent)
                near = [_xor_of(chosen) for n in range(0, distance - spent + 1) for chosen in combinations(rest, n)]
                moved = F.shiftleft(F.col("own").bitwiseXOR(F.col("value")), first)
                probes = step.select(
                    "fp", F.explode(_constants(near)).alias("mask"), moved.alias("moved")
                ).select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("moved")).bitwiseXOR(F.col("mask")).alias("b"))
                probes = probes.filter(F.col("a") != F.col("b"))
                hits = probes.join(nodes.select(F.col("fp").alias("b")), "b", "left_semi")
                pairs = pairs.union(hits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return pairs.distinct()


def _xor_of(masks: tuple[int, ...]) -> int:
    out = 0
    for m in masks:
        out ^= m
    return out


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    distance: int = 2,
    segments: int = 2,
    hot: int = HOT,
) -> DataFrame:
    """doc_id, fingerprint, component_id for every row.

    A-Z are lower-cased, words are split at ASCII white space, shingles of ``size`` words are joined by a space
    (of fewer words, the whole sequence). A text without words, null among them, has fingerprint zero and is linked
    like any other. Fingerprints link at ``distance`` or fewer differing bits; ``component_id`` is the smallest id
    reachable. Rows that repeat an id are rows of their own; rows of a null id link others but never name a
    component: it is null where all its rows have none. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    base = text_rows(docs, id_col, text_col)
    rows = scratch.save(fingerprints(base.withColumn("text", base["text"].cast("binary")), size), "fingerprints")
    nodes = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    pairs = scratch.save(similar_pairs(nodes.select("fp"), distance, segments, hot, scratch), "pairs")
    roots = connected(pairs, scratch)
    named = roots.join(nodes, roots["node"] == nodes["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    labels = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # many rows may share a fingerprint: each label is copied to every salt
    return salted_join(rows, labels, ["fp"], spread_by="doc_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
