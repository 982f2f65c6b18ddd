"""Substring deduplication by prefix-partitioned suffix trees.

A suffix starts at every word; only its first WINDOW words matter, so a tree ends at that depth, and its
internal nodes there are the repeated windows. The suffixes are dealt to groups by an anchor: of the
8-word stretches among the window's words, the one of least hash. Equal windows have equal anchors, and
neighbouring suffixes mostly share theirs.

1. Anchors: those that occur in one document only lead to no internal node; their suffixes are dropped.
2. Subtrees: every task sorts the remaining suffixes that it holds by their path (the leaves of its tree)
   and settles what it can: of a node's documents all but the first lose the window. Only the leaves of
   the node's first document go on to the anchor's group, so a passage that a third of all documents share
   is one node a task there.
3. Groups merge the subtrees below their anchors in the same way. There are as many as the count of suffixes
   asks for, and an anchor with too many of them is split further by the paths, each piece a group of its own.
4. Every document loses the words its windows cover.

Paths are compared by 64-bit fingerprints of the window's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import reliable, tasks_for, text_rows
from usagelens.llm.shingles import _BASE, _INVERSE, _MIX_A, _mix, run_hashes, slices, word_hashes

WINDOW = 50
ANCHOR = 8
#: suffixes that a task sorts at once
TASK_SUFFIXES = 2_000_000
#: suffixes of a group, of which a group has half on average; an anchor with more than a quarter is split
GROUP_LEAVES = 2_000_000
#: an anchor with fewer suffixes is never split
WHOLE_ANCHOR = 1_000


def _paths(words: np.ndarray, window: int) -> np.ndarray:
    """Fingerprint of every ``window`` consecutive words, from running sums."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    ups, downs = np.full(len(words), _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    ups[0] = downs[0] = 1
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum((words * _MIX_A) * np.multiply.accumulate(ups), out=sums[1:])
        return _mix((sums[window:] - sums[:n]) * np.multiply.accumulate(downs))


def _anchors(words: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Least anchor hash of every window, by doubling the span of the minimum."""
    low, span, want = run_hashes(words, anchor), 1, window - anchor + 1
    while 2 * span <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = want - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _documents(batch_rows: Iterator[tuple], window: int):
    """(row without text, word hashes) of the documents with at least one window."""
    for part in slices(batch_rows):
        words, first = word_hashes([row[-1] for row in part])
        for row, begin, end in zip(part, first[:-1].tolist(), first[1:].tolist()):
            if end - begin >= window:
                yield row[:-1], words[begin:end]


def document_anchors(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, anchor, leaves: the distinct anchors of every document and the windows that have them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, many = [], [], []
            pairs = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            for (doc_id,), words in _documents(pairs, window):
                own, leaves = np.unique(_anchors(words, window, anchor), return_counts=True)
                many.append(leaves.astype(np.int64))
                ids.append(np.full(len(own), doc_id, np.int64))
                found.append(own)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (ids, [own.view(np.int64) for own in found], many)],
                    names=["doc_id", "anchor", "leaves"],
                )

    return rows.mapInArrow(find, "doc_id long, anchor long, leaves long")


def split_anchors(shared: DataFrame, parts: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The number of groups; the anchors to split, sorted, with their first piece's group and number of pieces.

    ``shared``: anchor, leaves. At most about as many anchors are split as there are groups.
    """
    total = shared.agg(F.sum("leaves")).first()[0] or 0
    groups = max(parts, -(-2 * total // GROUP_LEAVES))
    room = max(1, min(GROUP_LEAVES // 4, max(WHOLE_ANCHOR, total // groups)))
    hot = shared.filter(F.col("leaves") > room).collect()
    anchors = np.array([row["anchor"] for row in hot], np.int64).view(np.uint64)
    pieces = np.array([-(-row["leaves"] // room) for row in hot], np.int64)
    order = np.argsort(anchors)
    anchors, pieces = anchors[order], pieces[order]
    return groups, anchors, groups + np.cumsum(pieces) - pieces, pieces


def _groups_of(anchors: np.ndarray, paths: np.ndarray, split: tuple) -> np.ndarray:
    """The group of every leaf; leaves of one path have one group."""
    groups, hot, first, pieces = split
    out = (anchors % np.uint64(groups)).astype(np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, anchors), len(hot) - 1)
        often = hot[at] == anchors
        at = at[often]
        out[often] = first[at] + (paths[often] % pieces[at].astype(np.uint64)).astype(np.int64)
    return out


def _first_document(paths: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of every leaf the least document of its node: leaves sorted by path, then document."""
    order = np.lexsort((docs, paths))
    sorted_paths = paths[order]
    starts = np.flatnonzero(np.r_[True, sorted_paths[1:] != sorted_paths[:-1]])
    least = np.repeat(docs[order[starts]], np.diff(np.r_[starts, len(paths)]))
    out = np.empty_like(docs)
    out[order] = least
    return out


_LEAVES = "part int, paths binary, docs binary, places binary"


def local_subtrees(candidates: DataFrame, split: tuple, window: int, anchor: int, held: int = TASK_SUFFIXES) -> DataFrame:
    """The leaves that still have to be merged, by part, and under negative parts what is settled.

    ``candidates``: doc_id, text (binary), anchors (the document's anchors that other documents have). ``split``: see ``split_anchors``.
    """
    known = candidates.sparkSession.sparkContext.broadcast(split)  # about as many anchors as groups

    def leaves(part: int, paths: np.ndarray, docs: np.ndarray, places: np.ndarray) -> dict:
        return {"part": part, "paths": paths.tobytes(), "docs": docs.tobytes(), "places": places.tobytes()}

    def settle(held_now: list[tuple]) -> pa.RecordBatch:
        paths, anchors, docs, places = (np.concatenate(column) for column in zip(*held_now))
        first = _first_document(paths, docs) == docs
        group = _groups_of(anchors, paths, known.value)
        rows = []
        for part in np.unique(group[first]).tolist():
            at = np.flatnonzero(first & (group == part))
            rows.append(leaves(part, paths[at], docs[at], places[at]))
        at = np.flatnonzero(~first)
        if len(at):
            rows.append(leaves(-1 - int(docs[0] % known.value[0]), paths[:0], docs[at], places[at]))
        schema = pa.schema([("part", pa.int32()), ("paths", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())])
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = [], 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "anchors", "text"))
            for (doc_id, shared), words in _documents(zip(*columns), window):
                anchors = _anchors(words, window, anchor)
                at = np.flatnonzero(np.isin(anchors, np.array(shared, np.int64).view(np.uint64)))
                now.append((_paths(words, window)[at], anchors[at], np.full(len(at), doc_id), at.astype(np.uint32)))
                total += len(at)
                if total >= held:
                    yield settle(now)
                    now, total = [], 0
        if total:
            yield settle(now)

    return candidates.mapInArrow(build, _LEAVES)


def subtrees(known: DataFrame, window: int, anchor: int) -> DataFrame:
    """The leaves of ``local_subtrees`` over rows of doc_id and text (binary)."""
    anchors = document_anchors(known, window, anchor)
    shared = anchors.groupBy("anchor").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("leaves").alias("leaves")
    )
    shared = reliable(shared.filter("least < most").select("anchor", "leaves"))
    found = anchors.select("doc_id", "anchor").join(shared.select("anchor"), "anchor")
    by_doc = found.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    candidates = known.join(by_doc, "doc_id").select("doc_id", "anchors", "text")
    return local_subtrees(candidates, split_anchors(shared, tasks_for(known)), window, anchor)


def merge_subtrees(leaves: DataFrame) -> DataFrame:
    """doc_id, places (starts of windows to remove as unsigned 32-bit integers) from each group."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        docs = np.frombuffer(b"".join(rows["docs"]), np.int64)
        places = np.frombuffer(b"".join(rows["places"]), np.uint32)
        if key[0] >= 0:
            paths = np.frombuffer(b"".join(rows["paths"]), np.uint64)
            gone = _first_document(paths, docs) != docs
            docs, places = docs[gone], places[gone]
        order = np.lexsort((places, docs))
        docs, places = docs[order], places[order]
        starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, np.int64)
        return pd.DataFrame(
            {"doc_id": docs[starts], "places": [p.tobytes() for p in np.split(places, starts[1:])] if len(docs) else []}
        )

    return leaves.groupBy("part").applyInPandas(merge, "doc_id long, places binary")


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row.

    Words are the runs of other characters than the six ASCII white space ones. Every word is removed that
    is covered by a window of ``window`` words which also starts in a document of smaller id; windows are
    judged on the input. ``kept`` has the other words with one space between them, as UTF-8 bytes. Null
    texts have no words; texts shorter than a window lose nothing. Rows that repeat an id are one
    document to each other: neither makes the other lose words. Rows with a null id neither lose words
    nor make others lose any. An empty table gives no rows.
    """
    base = text_rows(docs, id_col, text_col)
    rows = base.withColumn("text", base["text"].cast("binary"))
    known = rows.filter("doc_id IS NOT NULL")
    leaves = subtrees(known, window, anchor)
    gone = merge_subtrees(leaves).groupBy("doc_id").agg(F.collect_list("places").alias("places"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                words = text.split()
                counts.append(len(words))
                if places:
                    at = np.frombuffer(b"".join(places), np.uint32).astype(np.int64)
                    at = at[at + window <= len(words)]  # of rows that repeat an id the longest has the places
                    cover = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + window, minlength=len(words) + 1)
                    stays = np.cumsum(cover)[: len(words)] == 0
                    words = list(compress(words, stays.tolist()))
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = rows.join(gone, "doc_id", "left").select("doc_id", "text", "places")
    return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept binary")
