"""Tokenisers, language model, toxicity, quality, URL filter and decontamination."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from usagelens.llm import toxicity
from usagelens.llm.bpe import merge_pairs, merge_short, pair_table
from usagelens.llm.byte_bpe import PieceEncoder, decode_ids, encode_texts, read_ranks, windows_of
from usagelens.llm.common import FOLD_BYTES, table
from usagelens.llm.decontaminate import Screen, drop_leaks, edit_budget, find_leaks, normalise
from usagelens.llm.language_model import fit_weights, score_language_model
from usagelens.llm.quality import score_quality, train_quality
from usagelens.llm.token_counts import PieceCounter, count_tokens, read_pieces
from usagelens.llm.toxicity import ToxicityModel, drop_toxic, fit_label_model, score_toxicity, train_toxicity
from usagelens.llm.url_filter import Rule, judge_urls, split_url, train_url_model

from .conftest import SF, awkward_rows

PIECES = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
RANKS = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PAIRS = pair_table(RANKS)
COUNTER = PieceCounter(PIECES)
ENCODER = PieceEncoder(RANKS, public_tokenizers.PATTERN)
SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXT = st.text(alphabet="ab 's'll\n\t\r▁é漢字😀12  \xa0\x1c<s>theinr", max_size=80)


def ids_of(text):
    return b"".join(i.to_bytes(4, "little") for i in TIK.encode_ordinary(text))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_tokenisers_agree_with_the_libraries(text):
    assert COUNTER.count(text) == len(SP.encode(text))
    assert ENCODER.encode(text) == ids_of(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=24))
def test_both_mergers_agree(raw):
    by_scan = merge_short([RANKS[bytes([b])] for b in raw], PAIRS)
    by_heap = merge_pairs([bytes([b]) for b in raw], RANKS)
    assert by_scan == [RANKS[token] for token in by_heap]


def test_token_counts_awkward(awkward, nothing):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(awkward, PIECES).collect())
    want = sorted(
        (str(i), len((t or "").encode()), len(SP.encode(t or "")), len(SP.encode(t or "")) > 4096) for i, t in awkward_rows()
    )
    assert got == want
    assert count_tokens(nothing, PIECES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 1,\n漢", max_size=200))
def test_windows_cover_a_text(text):
    windows = list(windows_of(text, 7, 3))
    assert windows[0][0] == 0 and windows[-1][2] == len(text)
    for (_, _, reach, _), (start, head_to, _, _) in zip(windows, windows[1:]):
        assert head_to == reach and start < reach


@pytest.mark.parametrize("chunk,overlap", [(32_768, 1_024), (50, 8), (7, 2)])
def test_byte_bpe_awkward(awkward, nothing, chunk, overlap):
    coded = encode_texts(awkward, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    got = sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in decode_ids(coded, RANKS).collect())
    want = sorted((str(i), len(ids_of(t or "")) // 4, ids_of(t or ""), (t or "").encode()) for i, t in awkward_rows())
    assert got == want
    assert encode_texts(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_language_model_awkward(awkward, nothing):
    rows = awkward_rows()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    tokens = [word.findall((t or "").encode().translate(FOLD_BYTES).decode()) + [None] for _, t in rows]
    fold = [zlib.crc32(str(i).encode()) % 7 if i is not None else None for i, _ in rows]
    seen = collections.Counter(w for f, ws in zip(fold, tokens) if f != 2 for w in ws)
    n, v = sum(seen.values()), len(seen)
    got = sorted(score_language_model(awkward).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    want = sorted(zip(rows, fold, tokens), key=lambda x: (str(x[0][0]), len(x[2])))
    for r, ((doc_id, _), f, ws) in zip(got, want, strict=True):
        assert (r.doc_id, r.n_tokens, r.train_tokens) == (doc_id, len(ws), n)
        assert r.n_known == sum(seen[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0 and r.held_out == (None if f is None else f == 2)
    assert score_language_model(nothing).count() == 0


def test_language_model_beats_its_base_on_held_out_texts(spark):
    held = [r for r in score_language_model(table(spark, SF, "documents")).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_mixture_weights_follow_the_held_out_counts():
    strong = [(5, -80, -8, 100)]  # the bigram explains all
    weak = [(5, -80, -100_000, 100)]
    assert fit_weights(strong, 1000)[5][2] > 0.9 > 0.1 > fit_weights(weak, 1000)[5][2]


def test_label_model_finds_accuracies_and_correlation():
    rng = random.Random(1)
    patterns, truth = collections.Counter(), collections.defaultdict(list)
    for _ in range(20_000):
        y = rng.random() < 0.2
        vote = [rng.random() < (0.9 if y else 0.05) for _ in range(4)]
        vote.append(vote[3] if rng.random() < 0.95 else not vote[3])  # a voter that copies another
        code = sum(v << j for j, v in enumerate(vote))
        patterns[code] += 1
        truth[code].append(y)
    posterior = fit_label_model(patterns, 5)
    error = sum(abs(posterior[c] - sum(t) / len(t)) * len(t) for c, t in truth.items()) / 20_000
    assert error < 0.02


def test_toxicity_on_documents(spark, awkward, nothing):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = train_toxicity(docs, labels)
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in score_toxicity(docs, model).collect() if r.held_out and r.doc_id in marked]
    right = sum(r.predicted == marked[r.doc_id] for r in held)
    assert right >= 0.9 * len(held)
    assert len(score_toxicity(awkward, model).collect()) == len(awkward_rows())
    assert all(0 <= r.score <= 1 for r in score_toxicity(awkward, model).collect())
    assert score_toxicity(nothing, model).count() == 0
    assert drop_toxic(awkward, model).columns == awkward.columns
    unlabelled = train_toxicity(awkward, labels.limit(0))
    assert unlabelled == ToxicityModel() and drop_toxic(awkward, unlabelled).count() == len(awkward_rows())


def test_toxicity_folds_only_copies(spark):
    from pyspark.sql import functions as F

    # All share one long word; two copies differ in case and space, one text has both labels.
    texts = [f"passageword text number{i}" for i in range(20)] + ["Passageword  text\nNUMBER3", "passageword text number4"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i in (0, 4))) for i in range(22)], "doc_id long, toxic int")
    got = toxicity._labelled(docs, labels, "toxic", F.lit(True), 12_000)
    expected = [(t, int(i in (0, 4))) for i, t in enumerate(texts) if i != 20]
    assert sorted(tuple(r) for r in got.select("text", "label").collect()) == sorted(expected)


def test_toxicity_fit_uses_all_texts_in_any_order(spark):
    rows = [(i % 2, [0] if i % 2 else [], 1 + i) for i in range(40)]
    fits = []
    for parts in (1, 7):
        alike = spark.createDataFrame(rows, "votes int, hits array<int>, n long").repartition(parts)
        weights, bias = toxicity._fit_logistic(alike, {0: 0.1, 1: 0.8}, 1)
        fits.append((weights.tolist(), bias))
    assert fits[0] == fits[1]
    assert abs(fits[0][1] - math.log(0.1 / 0.9)) < 0.01 and abs(sum(fits[0][0]) + bias - math.log(0.8 / 0.2)) < 0.01


def test_quality(spark, awkward, nothing):
    from pyspark.sql import functions as F

    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = train_quality(docs, labels)
    marked = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in score_quality(docs, model, F.col("source"), F.col("lang")).collect()}
    known = [d for d in marked if d in got and zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(got[d].keep == bool(marked[d]) for d in known) >= 0.9 * len(known)
    odd = score_quality(awkward, model, F.col("source"), F.col("lang")).collect()
    assert len(odd) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in odd)
    assert score_quality(nothing, model, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_shrink_to_the_level_above(spark):
    from pyspark.sql import functions as F

    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = train_quality(docs, labels)
    rows = [(i, "%%% ### $$$ *** " * 30, "bad", "p") for i in range(40)] + [(99, "%%% ### $$$ *** " * 30, "new", "p")]
    rows += [(100 + i, "The plain words of that text were read by them, and so on. " * 4, "good", "p") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in score_quality(frame, model, F.col("source"), F.col("lang")).collect()}
    assert got[0].path_rate < got[99].path_rate < got[100].path_rate


def test_url_rules_and_model(spark):
    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1")]
    model = train_url_model([("http://casino-win.x.net/", True), ("http://school.y.net/", False)])
    urls = [
        None, "", "no scheme/at/all", "HTTP://WWW.Example.ORG/es/1?x#y", "http://example.org", "http://example.org/en/12",
        "http://a.org/en/12", "http://casino-win.z.net/a", "http://school.q.net/b", "x://h?p=/", "http://Ä.org/é", "a://b://c/d",
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in judge_urls(pages, rules, model).collect()}
    for i, url in enumerate(urls):
        host, path = split_url(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best.text)
        assert best is None or got[i].verdict == best.verdict
    assert got[7].verdict == "block" and got[8].verdict == "allow"
    assert judge_urls(pages.limit(0), rules, model).count() == 0


def edited(text, edits, rng):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = "#"
        elif kind == 1:
            chars.insert(at, "#")
        else:
            del chars[at]
    return "".join(chars)


def test_leaks_within_and_beyond_the_budget(spark):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    rng, screen = random.Random(4), Screen(items)
    for item_id, text in items[:40]:
        text = normalise(text)
        budget = edit_budget(len(text))
        for edits in (0, budget // 2, budget):
            held = normalise("zz yy " * rng.randrange(20) + edited(text, edits, rng) + " xx" * rng.randrange(20))
            assert item_id in {leak[1] for leak in screen.leaks([held])}
        far = edited(text, 3 * budget + 15, rng)
        assert item_id not in {leak[1] for leak in screen.leaks([normalise(far)])}


def test_decontaminate_frames(spark, awkward, nothing):
    benchmark = table(spark, SF, "benchmark")
    texts = {r.item_id: normalise(r.text) for r in benchmark.collect()}
    docs = table(spark, SF, "documents")
    held = {
        (r.doc_id, item) for r in docs.collect() for item, text in texts.items() if text in normalise(r.text) and len(text) >= 32
    }
    found = {(r.doc_id, r.item_id): r for r in find_leaks(docs, benchmark).collect()}
    assert held and held <= set(found)
    for key in held:
        assert found[key].edits == 0 and found[key].end - found[key].begin == len(texts[key[1]])
    clean = drop_leaks(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len({d for d, _ in found})
    assert drop_leaks(awkward, benchmark).count() == len(awkward_rows())
    assert find_leaks(nothing, benchmark).count() == 0 and find_leaks(docs, benchmark.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x" * 99), (1, None), (2, "short"), (3, "")], "item_id long, text string")
    assert find_leaks(awkward, odd).count() == 0


def test_digests_in_the_query(spark):
    import __spark_entry__ as entry_point

    got = {r.doc_id: r for r in entry_point.queries()["op10_byte_bpe"](spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(ids_of(r.text)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_long_texts_go_to_python_in_small_batches(spark):
    from pyspark.sql import functions as F

    from usagelens.llm.common import BATCH_BYTES, text_rows

    def describe(batches):
        for batch in batches:
            yield batch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    docs = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long "), 2_000).alias("text"))
    got = text_rows(docs).mapInArrow(describe, "rows long, size long").collect()
    assert sum(row["rows"] for row in got) == 2_000
    assert max(row["size"] for row in got) <= 2 * BATCH_BYTES


def test_the_classifier_is_the_same_in_slices(spark, monkeypatch):
    rows = [(i % 4, [j for j in range(6) if (i * 7 + j) % 3 == 0], 1 + i % 5) for i in range(500)]
    alike = spark.createDataFrame(rows, "votes int, hits array<int>, n long").coalesce(1)
    posterior = {0: 0.1, 1: 0.4, 2: 0.6, 3: 0.9}
    monkeypatch.setattr(toxicity, "MATRIX_ROWS", 1_000)
    whole, bias = toxicity._fit_logistic(alike, posterior, 6)
    monkeypatch.setattr(toxicity, "MATRIX_ROWS", 64)
    sliced, same_bias = toxicity._fit_logistic(alike, posterior, 6)
    assert (whole == sliced).all() and bias == same_bias
