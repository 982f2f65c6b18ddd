"""SimHash near-duplicates against all pairs."""

from __future__ import annotations

import random
import re

import pytest
import xxhash

from usagelens.llm import simhash
from usagelens.llm.common import table
from usagelens.llm.scratch import Scratch
from usagelens.llm.simhash import fingerprint, segment_balls, similar_pairs, simhash_components

from .conftest import SF, awkward_rows
from .test_dedup import folded

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    w = WORD.findall(folded(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, distance=2):
    prints = [brute_fingerprint(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {i: min((d for d in ids if d is not None), default=None) for i, ids in groups.items()}
    return sorted((str(d), f"{p:016x}", str(least[find(i)])) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def rows_of(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def near_rows():
    """Long texts of one word changed, so that fingerprints are a few bits apart, and chains of them."""
    rng = random.Random(8)
    rows = []
    for group in range(6):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
        for copy in range(12):
            rows.append((100 * group + 50 - copy, " ".join(words)))
            words = list(words)
            words[rng.randrange(400)] = f"x{copy}"
    return rows


def test_awkward(awkward):
    assert rows_of(simhash_components(awkward)) == brute(awkward_rows())


@pytest.mark.parametrize("hot", [512, 1])
def test_near_copies_with_and_without_hot_values(spark, hot):
    rows = near_rows()
    want = brute(rows)
    assert 6 < len({c for _, _, c in want}) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(simhash_components(df, hot=hot)) == want


@pytest.mark.parametrize("distance,segments,hot", [(2, 2, 1000), (2, 2, 2), (3, 2, 1), (3, 4, 1)])
def test_pairs_equal_all_pairs(spark, distance, segments, hot):
    rng = random.Random(distance * 10 + segments)
    centres = [rng.getrandbits(64) for _ in range(5)] + [0, (1 << 64) - 1]
    prints = set(centres)
    for c in centres:
        for _ in range(25):
            prints.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = [tuple(r) for r in similar_pairs(nodes, distance, segments, hot, Scratch(spark)).collect()]
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a & mask) ^ (b & mask)).bit_count() <= distance}
    assert len(got) == len(set(got)) and set(got) == want


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"Word{i % 977}" for i in range(3000)).encode()
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "AT_ONCE", 100)
    assert fingerprint(text) == whole == brute_fingerprint(text.decode())


def test_balls_and_empty_table(nothing):
    assert segment_balls(2, 2) == [(0, 32, 1), (32, 32, 0)]
    assert segment_balls(3, 4) == [(0, 16, 0), (16, 16, 0), (32, 16, 0), (48, 16, 0)]
    assert simhash_components(nothing).count() == 0


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(simhash_components(docs)) == brute(rows)
