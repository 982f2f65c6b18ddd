"""Byte-pair merging over one short unit, and a bounded memory of finished units."""

from __future__ import annotations

import heapq
from collections.abc import Callable

#: finished units of the newer half of a worker's memory; the older half is as large
MEMO_UNITS = 120_000
#: longer units are not remembered
MEMO_CHARS = 64


def merge_pairs(symbols: list, ranks: dict) -> list:
    """Merge adjacent symbols, lowest rank first and leftmost among equals, until no pair has a rank.

    ``symbols`` are strings or bytes; a pair's rank is that of its concatenation. A heap holds the open
    pairs and links hold the neighbours, so a unit of n symbols takes O(n log n).
    """
    n = len(symbols)
    rank_of = ranks.get
    heap = []
    for i in range(n - 1):
        pair = symbols[i] + symbols[i + 1]
        rank = rank_of(pair)
        if rank is not None:
            heap.append((rank, i, len(pair)))
    if not heap:
        return symbols
    heapq.heapify(heap)
    held = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while heap:
        _, i, size = heapq.heappop(heap)
        left, j = held[i], after[i]
        if left is None or j >= n or len(left) + len(held[j]) != size:
            continue  # one of the two has been merged meanwhile
        merged = left + held[j]
        held[i], held[j] = merged, None
        j = after[i] = after[j]
        if j < n:
            before[j] = i
            pair = merged + held[j]
            rank = rank_of(pair)
            if rank is not None:
                heapq.heappush(heap, (rank, i, len(pair)))
        h = before[i]
        if h >= 0:
            pair = held[h] + merged
            rank = rank_of(pair)
            if rank is not None:
                heapq.heappush(heap, (rank, h, len(pair)))
    return [s for s in held if s is not None]


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id, right id) as one number -> id of the merged token, for every way to split a token in two.

    For vocabularies in which a token's id is its rank.
    """
    table = {}
    for token, merged in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                table[left << 32 | right] = merged
    return table


def merge_short(ids: list[int], table: dict[int, int]) -> list[int]:
    """What merge_pairs gives, over ids and by scanning all pairs each time: faster for a few symbols."""
    merged_of, none = table.get, 1 << 62
    held = list(ids)
    open_pairs = [merged_of(a << 32 | b, none) for a, b in zip(held, held[1:])]
    while open_pairs:
        least = min(open_pairs)
        if least == none:
            break
        i = open_pairs.index(least)
        held[i] = least
        del held[i + 1], open_pairs[i]
        if i:
            open_pairs[i - 1] = merged_of(held[i - 1] << 32 | least, none)
        if i < len(open_pairs):
            open_pairs[i] = merged_of(least << 32 | held[i + 1], none)
    return held


class Memo(dict):
    """unit -> result, computed at the first use; bounded, so memory does not follow the vocabulary.

    Two halves: when the newer one is full it becomes the older one, and what is used again moves back.
    """

    def __init__(self, compute: Callable, units: int = MEMO_UNITS) -> None:
        super().__init__()
        self._compute, self._units, self._older = compute, units, {}

    def __missing__(self, unit):
        result = self._older.get(unit)
        if result is None:
            result = self._compute(unit)
        if len(unit) <= MEMO_CHARS:
            if len(self) >= self._units:
                self._older = dict(self)
                self.clear()
            self[unit] = result
        return result
