"""Exact deduplication, Jaccard join and substring deduplication against brute force."""

from __future__ import annotations

import hashlib
import re
import tracemalloc

import numpy as np

from usagelens.llm import jaccard_join, substring_dedup
from usagelens.llm.common import FOLD_BYTES, table
from usagelens.llm.exact_dedup import exact_duplicates, keep_one_copy
from usagelens.llm.jaccard_join import jaccard_components, keep_one_of_each
from usagelens.llm.shingles import run_hashes, shingle_sets, word_hashes
from usagelens.llm.substring_dedup import remove_repeats

from .conftest import SF, awkward_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def folded(text):
    return (text or "").encode().translate(FOLD_BYTES).decode()


def test_exact_dedup_awkward(awkward):
    got = exact_duplicates(awkward).collect()
    assert len(got) == len(awkward_rows())
    groups: dict[str, list] = {}
    for doc_id, text in awkward_rows():
        groups.setdefault(folded(text), []).append(doc_id)
    expected = sorted(
        (str(doc_id), max((d for d in groups[folded(text)] if d is not None), default=None), len(groups[folded(text)]),
         hashlib.sha256(folded(text).encode()).hexdigest())
        for doc_id, text in awkward_rows()
    )
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_dedup_compares_contents_under_one_digest(awkward):
    weak = exact_duplicates(awkward, digest=lambda content: str(len(content) % 3))
    strong = exact_duplicates(awkward)
    assert sorted(map(str, weak.collect())) == sorted(map(str, strong.collect()))


def test_exact_dedup_empty_and_stage(nothing, awkward):
    assert exact_duplicates(nothing).count() == 0
    kept = keep_one_copy(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} >= {8, 15, 16}


def shingles(text):
    w = WORD.findall(folded(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for group in by.values() for a in group for b in group if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        known = [d for d in groups[find(i)] if d is not None] if sets[i] else []
        out.append((str(doc_id), len(sets[i]), min(known, default=doc_id)))
    return sorted(out, key=str)


def as_rows(df):
    return sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_jaccard_awkward(awkward, nothing):
    assert as_rows(jaccard_components(awkward)) == brute_components(awkward_rows())
    assert jaccard_components(nothing).count() == 0


def test_jaccard_with_frequent_tokens(spark):
    # Blocks of common words make many tokens frequent: pairs of tokens and single ones of large sets are needed.
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(60):
        text = common[: 20 + i % 7] + [f"u{i}a", f"u{i}b"][: i % 3]
        rows.append((i, " ".join(text)))
    for i in range(60, 90):
        rows.append((i, " ".join(common + [f"w{i % 5}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for combined in (0, 3, 24):
        got = as_rows(jaccard_components(docs, frequent_from=3, combined=combined))
        assert got == brute_components(rows), combined


def brute_links(rows):
    sets = {frozenset(shingles(text)) for _, text in rows} - {frozenset()}
    n_links = {s: sum(s != o and 100 * len(s & o) >= 75 * len(s | o) for o in sets) for s in sets}
    return sorted((doc_id, n_links.get(frozenset(shingles(text)), 0)) for doc_id, text in rows)


def test_jaccard_counts_all_links(spark, monkeypatch):
    # Near copies of a hub that are similar to each other or not, chains whose ends differ, sizes across classes.
    base = words(21, 130)
    rows = [(0, " ".join(base)), (1, " ".join(base))]
    for i in range(40):
        text = base[: 118 + i % 13]
        for at in range(i % 4):
            text = text[: 9 + 31 * at + i % 3] + [f"u{i}x{at}"] + text[10 + 31 * at + i % 3 :]
        rows.append((2 + i, " ".join(text)))
    for i in range(12):
        rows.append((100 + i, " ".join(words(22, 200)[5 * i : 5 * i + 70])))
    rows += [(200, "a b c d e f"), (201, "a b c d e f"), (202, "lone text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    expected = brute_links(rows)
    assert max(n for _, n in expected) > 20
    for block in (256, 3):
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
        got = jaccard_components(docs)
        assert sorted((r.doc_id, r.n_links) for r in got.collect()) == expected, block


def test_jaccard_large_group_makes_few_pairs(spark, monkeypatch):
    # Near copies of one text, half of them too far from it and from each other: what is verified follows their number.
    base, rows = words(41, 150), []
    for i in range(400):
        text = list(base)
        for at in range(3 if i % 2 else 5):
            text[(i * 37 + at * 29) % 150] = f"u{i}x{at}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    expected, links, plain = brute_components(rows), brute_links(rows), jaccard_join.verify_pairs
    for held in (8192, 40):
        seen = []
        monkeypatch.setattr(jaccard_join, "KEY_SETS", held)
        monkeypatch.setattr(jaccard_join, "verify_pairs", lambda pairs, sets: seen.append(pairs.count()) or plain(pairs, sets))
        got = jaccard_components(docs)
        assert as_rows(got) == expected
        assert sorted((r.doc_id, r.n_links) for r in got.collect()) == links
        assert sum(seen) < 5 * len(rows), (held, seen)


def test_bit_maps_bound_what_sets_share():
    rng = np.random.default_rng(7)
    for n, m, both in ((40, 40, 30), (146, 150, 110), (300, 400, 300), (1, 1, 0)):
        tokens = rng.integers(0, 2**64 - 1, n + m - both, np.uint64)
        x, y = tokens[:n], tokens[n - both :]
        most = jaccard_join.most_common(jaccard_join.signature(x), jaccard_join.signature(y), n, m)
        assert both <= most <= both + max(5, 0.35 * (n + m - 2 * both)), (n, m, most)
        known = jaccard_join.Maps([jaccard_join.signature(x), jaccard_join.signature(y)])
        assert (n + m - known.apart(np.array([0, 1]), np.array([1, 0]))).tolist() in ([2 * most] * 2, [2 * most + 1] * 2)


def test_key_blocks_and_nearest_find_every_pair(monkeypatch):
    rng = np.random.default_rng(8)
    n = np.sort(rng.integers(8, 14, 60))
    sets = [np.unique(rng.integers(0, 16, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in n]
    sets.sort(key=len)
    n, maps = np.array([len(s) for s in sets]), [jaccard_join.signature(s) for s in sets]
    node, label, none = np.arange(60), np.arange(60) % 7, np.zeros(60, np.int64)
    similar = {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 7 != b % 7
               and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    for large in (64, 5):
        monkeypatch.setattr(jaccard_join, "LARGE_KEY", large)
        closest, found = jaccard_join.Nearest(), set()
        for x, y, share in jaccard_join.similar_under_keys(none, none, node, n, none, none > 0, label, maps):
            found |= set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
            closest.add(x, y, share)
        assert similar and similar <= found
        best = closest.take()
        assert set(best.column("node").to_pylist()) == {i for pair in found for i in pair} and not closest.best
        parts = set()
        for x, y, _ in jaccard_join.similar_under_keys(node // 20, none, node, n, none, none > 0, label, maps):
            parts |= set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
        assert parts == {(a, b) for a, b in found if a // 20 == b // 20}


def test_jaccard_links_through_rows_without_id(spark):
    """A chain whose middle has no id, with copies of it, and a pair without any id."""
    base = words(31, 100)
    rows = [
        (1, " ".join(base)), (None, " ".join(base[:88] + ["n"])), (None, " ".join(base[:88] + ["n"])), (2, " ".join(base[:76])),
        (None, " ".join(words(32, 80))), (None, " ".join(words(32, 80)[:78])), (9, "alone"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = jaccard_components(docs)
    assert as_rows(got) == brute_components(rows)
    links = brute_links([(str(i), t) for i, t in rows])
    assert sorted((str(r.doc_id), r.n_links) for r in got.collect()) == links
    assert {r.component_id for r in got.filter("doc_id IN (1, 2)").collect()} == {1}


def test_jaccard_on_documents(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert as_rows(jaccard_components(docs)) == brute_components(rows)


def test_jaccard_stage(awkward):
    kept = keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 8 not in ids and 9 not in ids and 7 in ids and ids.count(None) == 2


def brute_removal(rows, window=50):
    starts = {}
    tokens = [WORD.findall(text or "") for _, text in rows]
    for (doc_id, _), w in zip(rows, tokens):
        if doc_id is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                starts[key] = min(starts.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(rows, tokens):
        gone = set()
        if doc_id is not None:
            for i in range(len(w) - window + 1):
                if starts[tuple(w[i : i + window])] < doc_id:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(doc_id), len(w), len(gone), kept))
    return sorted(out)


def removal_rows(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, bytes(r.kept).decode()) for r in df.collect())


def test_substring_awkward(awkward, nothing):
    rows = [(i, t) for i, t in awkward_rows() if (i, t) != (15, "a b c d e")]  # one text for each id
    got = removal_rows(remove_repeats(awkward.filter("NOT (doc_id <=> 15 AND text <=> 'a b c d e')")))
    assert got == brute_removal(rows)
    assert remove_repeats(nothing).count() == 0


def test_substring_on_documents(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert removal_rows(remove_repeats(docs)) == brute_removal(rows)


def test_substring_splits_a_hot_anchor(spark, monkeypatch):
    # A stretch of eight words in other surroundings in every document is the anchor of 43 windows in each.
    some = words(31, 20_000)
    hashes, _ = word_hashes([" ".join(some).encode()])
    at = int(run_hashes(hashes, 8).argmin())
    rows = [(i, " ".join(words(500 + 2 * i, 60) + some[at : at + 8] + words(501 + 2 * i, 60))) for i in range(120)]
    rows += [(200, rows[3][1]), (201, rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substring_dedup, "GROUP_LEAVES", 2_000)
    known = docs.selectExpr("doc_id", "cast(text AS binary) AS text")
    sizes = {}
    for part, held in substring_dedup.subtrees(known, 50, 8).select("part", "docs").collect():
        if part >= 0:
            sizes[part] = sizes.get(part, 0) + len(held) // 8
    assert sum(sizes.values()) > 5_000 and max(sizes.values()) < 1_000
    assert removal_rows(remove_repeats(docs)) == brute_removal(rows)


def test_repeated_tokens_are_counted_in_place():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 5, 300_000):
        tokens = rng.integers(0, 2**64 - 1, n, np.uint64) if n > 5 else np.zeros(n, np.uint64)
        tokens = np.concatenate([tokens, tokens[: n // 3], tokens[: n // 7]])
        values, counts = np.unique(tokens, return_counts=True)
        held = tokens.copy()
        tracemalloc.start()
        found, many = jaccard_join.repeated(held)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found.tolist() == values[counts > 1].tolist() and many.tolist() == counts[counts > 1].tolist()
        assert most <= 2 * held.nbytes + 10_000


def test_frequent_tokens_in_small_pieces(spark, monkeypatch):
    rows = [(i, " ".join(words(900 + i % 3, 30) + words(i, 5 + i % 40))) for i in range(300)] + [(300, None), (301, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).selectExpr("doc_id", "coalesce(cast(text AS binary), X'') AS text")
    whole = jaccard_join.frequent_tokens(docs, least=64)
    sets = shingle_sets([(text or "").encode() for _, text in rows])
    values, counts = np.unique(np.concatenate(list({s.tobytes(): s for s in sets}.values())), return_counts=True)
    assert len(whole[0]) > 0 and whole[0].tolist() == values[counts > 64].tolist()
    monkeypatch.setattr(jaccard_join, "TASK_TOKENS", 50)  # less than a set's
    pieces = jaccard_join.frequent_tokens(docs, least=0)
    assert set(pieces[0].tolist()) <= set(values[counts > 1].tolist())
