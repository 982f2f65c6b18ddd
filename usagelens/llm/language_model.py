"""Scores of a bigram language model by deleted interpolation.

Tokens are words and one end per text. The model mixes the uniform, unigram and bigram maximum-likelihood
estimates; the weights depend on how frequent the context is, and are learnt by expectation-maximisation on
the counts of a deleted slice of the training texts, whose own occurrences are taken out of the estimates.

Documents are dealt to buckets of a few megabytes by a hash of their ids. A bucket sends its distinct
unigrams and bigrams, as packed hashes with their counts, to the partition of the n-gram; that sums them
over all buckets and returns the totals in the bucket's own order. So every n-gram crosses the network
once per bucket, however frequent it is, and no table of the whole vocabulary is held anywhere.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import FOLD_BYTES, crc_bucket, reliable, tasks_for, text_rows
from usagelens.llm.shingles import _mix, slices, word_hashes

#: context-frequency buckets: unseen, then powers of two
CONTEXTS = 18
#: steps per binary order of magnitude in which the learner sees estimates
_STEPS = 8
_NEVER = -100_000

_END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)
_HELD_OUT, _DELETED = 2, 4


@dataclass
class Mixture:
    """Weights (context bucket x uniform, unigram, bigram) and what the estimates are relative to."""

    weights: np.ndarray
    tokens: int
    types: int


def context_bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(CONTEXTS - 1, np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0)).astype(np.int64)


class Tokens:
    """Tokens of a bucket's documents: hashes, contexts, the document of each, and its fold."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.ids, self.folds = rows["doc_id"].tolist(), rows["fold"].to_numpy(np.int64)
        words, lengths = [], []
        texts = ((zlib.decompress(z).translate(FOLD_BYTES),) for z in rows["packed"])
        for part in slices(texts):
            hashes, first = word_hashes([row[0] for row in part])
            words.append(hashes)
            lengths.append(np.diff(first))
        n = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.lengths = n + 1
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        total = int(self.lengths.sum())
        ends = self.begins + n
        self.token = np.empty(total, np.uint64)
        is_word = np.ones(total, bool)
        is_word[ends] = False
        self.token[is_word] = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.token[ends] = _END
        self.context = np.empty(total, np.uint64)
        self.context[1:] = self.token[:-1]
        self.context[self.begins] = _START
        with np.errstate(over="ignore"):
            self.pair = _mix(self.context * np.uint64(0x9FB21C651E98DF25) + self.token)
        self.fold = np.repeat(self.folds, self.lengths)

    def grams(self):
        """(kind, sorted distinct hashes, place of every token's gram among them)."""
        for kind, hashes in ((1, self.token), (2, self.pair)):
            distinct, place = np.unique(hashes, return_inverse=True)
            yield kind, distinct, place


def _pack(values: np.ndarray) -> bytes:
    """Counts, mostly small: compressed."""
    return zlib.compress(values.astype("<u4").tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)


_SENT = "bucket long, kind int, part int, grams binary, seen binary, deleted binary"
_RETURNED = "bucket long, kind int, part int, seen binary, deleted binary, types long, tokens long, deleted_tokens long"


def _send(parts: int):
    """Bucket -> its distinct n-grams by partition, with training and deleted counts."""

    def send(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tokens, out = Tokens(rows), []
        training = tokens.fold != _HELD_OUT
        deleted = tokens.fold == _DELETED
        for kind, distinct, place in tokens.grams():
            seen = np.bincount(place[training], minlength=len(distinct))
            slice_seen = np.bincount(place[deleted], minlength=len(distinct))
            edges = np.searchsorted(distinct, _edges(parts))
            for part in range(parts):
                a, b = int(edges[part]), int(edges[part + 1]) if part + 1 < parts else len(distinct)
                if a < b:
                    out.append((key[0], kind, part, _gram_bytes(distinct[a:b]), _pack(seen[a:b]), _pack(slice_seen[a:b])))
        return pd.DataFrame(out, columns=["bucket", "kind", "part", "grams", "seen", "deleted"])

    return send


def _edges(parts: int) -> np.ndarray:
    """Least hash of each partition."""
    return np.array([(i << 64) // parts for i in range(parts)], dtype=np.uint64)


def _gram_bytes(grams: np.ndarray) -> bytes:
    """Sorted hashes byte plane by byte plane, high bytes first: those repeat and compress in the shuffle."""
    return grams.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _gram_hashes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(">u8").reshape(-1).astype(np.uint64)


def _total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Partition of one kind -> totals of every row's n-grams, in the row's order."""
    grams = [_gram_hashes(raw) for raw in rows["grams"]]
    distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
    totals = []
    for column in ("seen", "deleted"):
        own = np.concatenate([_unpack(raw) for raw in rows[column]])
        totals.append(np.bincount(place, weights=own, minlength=len(distinct)).astype(np.int64))
    cuts = np.cumsum([len(g) for g in grams])[:-1]
    # the partition's own sums go with its first row only
    facts = np.zeros((len(grams), 3), np.int64)
    if key[1] == 1:
        facts[0] = [(totals[0] > 0).sum(), totals[0].sum(), totals[1].sum()]
    out = pd.DataFrame({"bucket": rows["bucket"].to_numpy(), "kind": key[1], "part": key[0]})
    for name, total in zip(("seen", "deleted"), totals):
        out[name] = [_pack(t) for t in np.split(total[place], cuts)]
    out[["types", "tokens", "deleted_tokens"]] = facts
    return out


def _counts(tokens: Tokens, returned: pd.DataFrame) -> dict[str, np.ndarray]:
    """Per token: totals of its unigram, its bigram and its context, with the deleted slice's share."""
    out = {}
    for kind, distinct, place in tokens.grams():
        rows = returned[returned["kind"] == kind].sort_values("part")
        for name, short in (("seen", "c"), ("deleted", "d")):
            total = np.concatenate([_unpack(raw) for raw in rows[name]]) if len(rows) else np.zeros(0, np.int64)
            out[f"{short}{kind}"] = total[place]
    for short in "cd":
        of_token = out[f"{short}1"]
        context = np.empty_like(of_token)
        context[1:] = of_token[:-1]
        # a text's first context is as frequent as texts are, which is how often the end occurs
        ends = tokens.begins + tokens.lengths - 1
        context[tokens.begins] = of_token[ends]
        out[f"{short}v"] = context
    return out


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _learner(tokens_without_slice: int):
    """Bucket of deleted texts -> how many tokens have which estimates, in steps."""

    def learn(key: tuple, rows: pd.DataFrame, returned: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"context": [], "one": [], "two": [], "n": []}).astype("int64")
        if not len(rows):
            return empty
        tokens = Tokens(rows)
        c = _counts(tokens, returned)
        use = tokens.fold == _DELETED
        context = (c["cv"] - c["dv"])[use]
        one = _share((c["c1"] - c["d1"])[use], np.full(use.sum(), tokens_without_slice))
        two = _share((c["c2"] - c["d2"])[use], context)
        cells = [context_bucket(context)]
        for p in (one, two):
            cells.append(np.where(p > 0, np.round(_STEPS * np.log2(np.maximum(p, 1e-300))), _NEVER).astype(np.int64))
        grid, n = np.unique(np.stack(cells, axis=1), axis=0, return_counts=True)
        return pd.DataFrame({"context": grid[:, 0], "one": grid[:, 1], "two": grid[:, 2], "n": n})

    return learn


def fit_weights(cells: list[tuple[int, int, int, int]], types: int, rounds: int = 200) -> np.ndarray:
    """Mixture weights of every context bucket by EM; buckets without tokens take the even start."""
    weights = np.full((CONTEXTS, 3), 1 / 3)
    weights[0] = [0.5, 0.5, 0.0]
    grid = np.array(cells, dtype=float).reshape(-1, 4)
    for bucket in range(CONTEXTS):
        rows = grid[grid[:, 0] == bucket]
        if not len(rows):
            continue
        p = np.stack(
            [np.full(len(rows), 1 / (types + 1))]
            + [np.where(rows[:, k] > _NEVER, 2.0 ** np.maximum(rows[:, k] / _STEPS, -1000), 0) for k in (1, 2)],
            axis=1,
        )
        w = weights[bucket]
        for _ in range(rounds):
            share = p * w
            w = (rows[:, 3:4] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / rows[:, 3].sum()
        weights[bucket] = w
    weights = np.maximum(weights, [1e-6, 0, 0])  # every token keeps a probability
    return weights / weights.sum(axis=1, keepdims=True)


def _scorer(mixture: Mixture):
    def score(key: tuple, rows: pd.DataFrame, returned: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        if not len(rows):
            return pd.DataFrame({name: [] for name in columns})
        tokens = Tokens(rows)
        c = _counts(tokens, returned)
        w = mixture.weights[context_bucket(c["cv"])]
        p = w[:, 0] / (mixture.types + 1) + w[:, 1] * c["c1"] / max(1, mixture.tokens) + w[:, 2] * _share(c["c2"], c["cv"])
        base = np.log10((c["c1"] + 1) / (mixture.tokens + mixture.types + 1))
        each = {
            "n_tokens": tokens.lengths,
            "n_known": np.add.reduceat((c["c1"] > 0).astype(np.int64), tokens.begins),
            "base_score": np.add.reduceat(base, tokens.begins),
            "score": np.add.reduceat(np.log10(p), tokens.begins),
        }
        return pd.DataFrame({"doc_id": pd.array(tokens.ids, dtype="Int64"), **each})[columns]

    return score


def score_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    The model learns from texts whose id's crc32 (as text) modulo 7 is not 2; the deleted slice is that of
    remainder 4. ``base_score`` is the add-one unigram score, ``score`` the mixture's log10 probability. A
    null text is empty: its only token is the end. Rows that repeat an id count each; a row with a null id
    is training text and its held_out is null. Without training texts every token has the uniform
    probability of one unseen type. An empty table gives no rows.
    """

    def pack(batches):
        for batch in batches:
            packed = [zlib.compress(text, 1) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(packed, pa.binary())], names=[*batch.schema.names[:-1], "packed"]
            )

    base = text_rows(docs, id_col, text_col)
    parts = tasks_for(docs)
    fold = F.coalesce(crc_bucket(F.col("doc_id"), 7), F.lit(0)).cast("long")
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(2 * parts))
    # Deleted texts have buckets of their own, so that the learner reads no others.
    bucket = F.when(fold == _DELETED, F.pmod(spread, F.lit(max(1, 2 * parts // 7))) - 2 * parts).otherwise(spread)
    dealt = base.select(
        bucket.cast("long").alias("bucket"), "doc_id", fold.alias("fold"), base["text"].cast("binary").alias("text")
    )
    schema = "bucket long, doc_id long, fold long, packed binary"
    rows = dealt.mapInArrow(pack, schema)

    sent = rows.groupBy("bucket").applyInPandas(_send(parts), _SENT)
    returned = reliable(sent.groupBy("part", "kind").applyInPandas(_total, _RETURNED))
    sums = returned.agg(F.sum("types").alias("v"), F.sum("tokens").alias("n"), F.sum("deleted_tokens").alias("d")).first()
    types, total, slice_total = (int(sums[k] or 0) for k in ("v", "n", "d"))

    totals = returned.select("bucket", "kind", "part", "seen", "deleted")
    learnt = (
        dealt.filter("bucket < 0")
        .mapInArrow(pack, schema)
        .groupBy("bucket")
        .cogroup(totals.filter("bucket < 0").groupBy("bucket"))
        .applyInPandas(_learner(total - slice_total), "context long, one long, two long, n long")
        .groupBy("context", "one", "two")
        .agg(F.sum("n").alias("n"))
    )
    # Cells of the grid: bounded by its steps, not by the texts.
    cells = [(r["context"], r["one"], r["two"], r["n"]) for r in learnt.collect()]
    mixture = Mixture(fit_weights(cells, types), total, types)
    scored = rows.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInPandas(
        _scorer(mixture), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        "doc_id",
        (crc_bucket(F.col("doc_id"), 7) == _HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )

