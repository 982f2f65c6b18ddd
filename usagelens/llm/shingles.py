"""Word and shingle hashes of many texts at once.

Words are runs of other bytes than the six ASCII white space bytes. A word's hash is a polynomial over its
bytes, taken from running sums over the whole slice; a shingle's hash mixes those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: bytes of text that are hashed together
SLICE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX_A
        h = (h ^ (h >> np.uint64(27))) * _MIX_B
        return h ^ (h >> np.uint64(31))


#: one value for each byte, and multipliers for the places of a shingle's words
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_PLACE = _mix(np.arange(1001, 1257, dtype=np.uint64)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of the base and of its inverse, grown as longer slices come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            ups = np.full(n, _BASE, np.uint64)
            downs = np.full(n, _INVERSE, np.uint64)
            ups[0] = downs[0] = 1
            with np.errstate(over="ignore"):
                self.up, self.down = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
        return self.up, self.down


_POWERS = Powers()


def slices(rows: Iterator[tuple], size: int = SLICE_BYTES) -> Iterator[list[tuple]]:
    """Rows (..., text as bytes) in lists of about ``size`` bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[-1]) + 1
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after the other, and where each text's words begin (and the end)."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    begin = np.flatnonzero(~space & before)
    end = np.flatnonzero(space & ~before)
    up, down = _POWERS.get(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
        hashes = _mix((sums[end] - sums[begin]) * down[begin])
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(begin, edges)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = words[:n] * _PLACE[0]
        for i in range(1, size):
            total += words[i : i + n] * _PLACE[i]
    return _mix(total)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; of fewer words, the whole sequence as one."""
    words, first = word_hashes(texts)
    runs = run_hashes(words, size)
    out = []
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist()):
        n = end - begin
        if n >= size:
            out.append(np.unique(runs[begin : end - size + 1]))
        elif n:
            with np.errstate(over="ignore"):
                short = (words[begin:end] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(_mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
