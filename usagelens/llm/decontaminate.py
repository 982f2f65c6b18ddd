"""Benchmark decontamination by the q-gram lemma.

A text holds an item of m characters within e edits only if some run of e + 1 diagonals has at least
(m - q + 1) - q * e of the item's q-grams in common with it. Shared q-grams are therefore counted in
overlapping diagonal bands; bands that meet the bound are verified by banded alignment.

The items go to the tasks in blocks of bounded size, so documents are only scanned, never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import text_rows

Q = 12
#: edits allowed per character of an item
EDIT_RATE = 0.06
#: shorter items are no evidence of a leak
LEAST_CHARS = 32
#: text of the items that are sent to the tasks at once
BLOCK_BYTES = 4_000_000
#: characters of documents that are looked at together
_SLICE_CHARS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SLOT_BITS = 22


def normalise(text: str) -> str:
    """Lower case, white space runs as one space."""
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def qgram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Polynomial hash of every q consecutive codes, built by doubling."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        whole, size = None, 0
        power, span, step = codes + np.uint64(1), 1, _BASE
        rest = q
        while rest:
            if rest & 1:
                if whole is None:
                    whole, size = power, span
                else:
                    n = len(codes) - size - span + 1
                    whole, size = whole[:n] * step + power[size : size + n], size + span
            rest >>= 1
            if rest:
                n = len(codes) - 2 * span + 1
                power = power[:n] * step + power[span : span + n]
                span, step = 2 * span, step * step
        return whole * _MIX


def edit_budget(chars: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """Edits allowed to an item: a share of its length, as far as the lemma leaves a positive bound."""
    return max(0, min(int(rate * chars), (chars - q) // q))


def band_align(item: np.ndarray, region: np.ndarray, low: int, width: int, anchored: bool = False) -> tuple[int, int]:
    """(edits, end) of the best alignment of ``item`` to a stretch of ``region``.

    Only cells whose diagonal (place in region less place in item) is within [low, low + width) count.
    The stretch may begin anywhere, or only at 0 if ``anchored``; it may end anywhere.
    """
    far = len(item) + len(region) + 1
    lanes = np.arange(width)
    places = low + lanes
    row = np.where((places >= 0) & (places <= len(region)), 0, far)
    if anchored:
        row = np.where((places >= 0) & (places <= len(region)), places, far)
    padded = np.concatenate([region, np.array([2**40], dtype=np.int64)])
    for i, code in enumerate(item, start=1):
        places = i + low + lanes
        inside = (places >= 1) & (places <= len(region))
        same = padded[np.where(inside, places - 1, len(region))] == code
        step = np.where(inside, row + np.where(same, 0, 1), far)
        above = np.append(row[1:], far) + 1
        best = np.minimum(step, np.where((places >= 0) & (places <= len(region)), above, far))
        row = np.minimum.accumulate(best - lanes) + lanes
        row = np.where((places >= 0) & (places <= len(region)), np.minimum(row, far), far)
    k = int(row.argmin())
    return int(row[k]), len(item) + low + k


class Screen:
    """The items of one block, ready for counting and verification."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE) -> None:
        texts = [(item_id, normalise(text)) for item_id, text in items]
        texts = [(item_id, text) for item_id, text in texts if len(text) >= max(LEAST_CHARS, q)]
        self.q, self.ids = q, [item_id for item_id, _ in texts]
        self.codes = [_codes(text).astype(np.int64) for _, text in texts]
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([edit_budget(n, q, rate) for n in self.length.tolist()], np.int64)
        self.least = np.maximum(1, self.length - q + 1 - q * self.budget)
        self.band = self.budget + 1
        grams = [qgram_hashes(c.astype(np.uint64), q) for c in self.codes]
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.hashes, self.first, self.many = np.unique(hashes[order], return_index=True, return_counts=True)
        self.slots = np.zeros(1 << _SLOT_BITS, bool)
        self.slots[(self.hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)] = True

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text's place, item id, begin, end, edits) for texts in normal form."""
        if not self.ids:
            return []
        codes = _codes("\n".join(texts))
        hashes = qgram_hashes(codes, self.q)
        at = np.flatnonzero(self.slots[(hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)])
        if not len(at):
            return []
        found = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        true = self.hashes[found] == hashes[at]
        at, found = at[true], found[true]
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        doc = np.searchsorted(begins, at, side="right") - 1
        # a text with fewer hits than the smallest bound holds no item
        enough = np.bincount(doc, minlength=len(texts)) >= self.least.min()
        keep = enough[doc]
        at, found, doc = at[keep], found[keep], doc[keep]
        if not len(at):
            return []
        many = self.many[found]
        entry = np.repeat(self.first[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        doc, at = np.repeat(doc, many), np.repeat(at, many)
        item = self.owner[entry]
        diagonal = at - begins[doc] - self.place[entry] + self.length[item]
        pair, pair_of = np.unique(doc * len(self.ids) + item, return_inverse=True)
        upper = diagonal // self.band[item]
        key = np.concatenate([(pair_of << 32) + upper + 1, (pair_of << 32) + upper])  # a diagonal is in two bands
        key, shared = np.unique(key, return_counts=True)
        item_of = pair[key >> 32] % len(self.ids)
        meets = shared >= self.least[item_of]
        out = []
        best: dict[int, tuple[int, int, int]] = {}
        for code, n in sorted(zip(key[meets].tolist(), shared[meets].tolist()), key=lambda x: (-x[1], x[0])):
            which = code >> 32
            if which not in best:
                place, item_at = divmod(int(pair[which]), len(self.ids))
                hit = self._verify(codes[begins[place] : begins[place + 1] - 1], item_at, (code & 0xFFFFFFFF) - 1)
                if hit is not None:
                    best[which] = hit
        for which, (begin, end, edits) in sorted(best.items()):
            place, item_at = divmod(int(pair[which]), len(self.ids))
            out.append((place, self.ids[item_at], begin, end, edits))
        return out

    def _verify(self, text: np.ndarray, item_at: int, band: int) -> tuple[int, int, int] | None:
        item, edits = self.codes[item_at], int(self.budget[item_at])
        width = int(self.band[item_at])
        start = band * width - len(item)
        low = max(0, start - edits)
        region = text[low : max(low, start + 2 * width + len(item) + edits)].astype(np.int64)
        cost, end = band_align(item, region, start - edits - low, 2 * width + 2 * edits + 1)
        if cost > edits:
            return None
        # backwards from its end, the cheapest stretch tells the beginning
        back = region[:end][::-1]
        _, length = band_align(item[::-1], back, -edits, 2 * edits + 1, anchored=True)
        return low + end - length, low + end, cost


def _slices(rows: Iterator[tuple[int, str]]) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, chars = [], [], 0
    for doc_id, text in rows:
        ids.append(doc_id)
        texts.append(text)
        chars += len(text)
        if chars >= _SLICE_CHARS:
            yield ids, texts
            ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    rows = items.select(items[item_col].cast("long").alias("item_id"), items[text_col].cast("string").alias("text"))
    rows = rows.filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(2 * size / BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    for part in range(parts):
        block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else rows
        yield sorted((r["item_id"], r["text"]) for r in block.collect())


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    q: int = Q,
    rate: float = EDIT_RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, begin, end, edits: the documents that hold a benchmark item, and where.

    Texts are compared in lower case with single spaces; places are in that form. An item counts as held
    when some stretch of the text is within ``rate`` edits a character of it; one stretch is given for
    each pair. Items with null ids or texts, or under 32 characters, are never reported; a null text
    holds nothing; repeated rows give repeated results; empty tables give no rows.
    """
    rows = text_rows(docs, id_col, text_col)
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most about BLOCK_BYTES

        def screen(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tool = Screen(shared.value, q, rate)
            for batch in batches:
                pairs = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                for ids, texts in _slices((doc_id, normalise(text)) for doc_id, text in pairs):
                    found = tool.leaks(texts)
                    columns = list(zip(*found)) if found else [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[place] for place in columns[0]], pa.int64()),
                            *(pa.array(column, pa.int64()) for column in columns[1:]),
                        ],
                        names=["doc_id", "item_id", "begin", "end", "edits"],
                    )

        part = rows.mapInArrow(screen, "doc_id long, item_id long, begin long, end long, edits long")
        out = part if out is None else out.unionByName(part)
    return out


def _holds(shared):
    """Column function: whether a text holds an item of the broadcast block."""

    @F.pandas_udf("boolean")
    def holds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = Screen(shared.value)
        for texts in parts:
            held = np.zeros(len(texts), bool)
            for places, slice_texts in _slices((i, normalise(text or "")) for i, text in enumerate(texts)):
                held[[places[leak[0]] for leak in tool.leaks(slice_texts)]] = True
            yield pd.Series(held)

    return holds


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns; judged where they are read."""
    for block in _blocks(benchmark, item_col, "text"):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most about BLOCK_BYTES
        docs = docs.filter(~_holds(shared)(docs[text_col].cast("string")))
    return docs
