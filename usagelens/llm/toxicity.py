"""Toxicity by weak supervision.

1. Lexicons: words and word beginnings that mark toxic texts, from a bounded sample of labelled rows.
2. Voters: several lexicons and patterns vote on every training text; the vote patterns are counted.
3. Label model: a generative model of the votes. It estimates by expectation-maximisation each voter's
   accuracy on either class and, as a tree over the voters, their correlations given the class.
4. Classifier: logistic regression on word features, trained on the model's posterior labels.

Scoring is a map over the rows without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import crc_bucket, reliable, tasks_for, text_rows

#: labelled rows from which lexicons are taken
LABELLED_ROWS = 12_000
#: features the classifier may use
MAX_FEATURES = 400
#: rows of the classifier's matrix that a task holds at once
MATRIX_ROWS = 1024
#: a text from this score on is toxic
THRESHOLD = 0.3
#: prefixes that stand for compounds and inflected forms
PREFIX_CHARS = (4, 5)
#: word lexicons besides one lexicon for each prefix length
WORD_LEXICONS = 4
_VOTERS = WORD_LEXICONS + len(PREFIX_CHARS) + 2

#: runs of letters and digits
_words = re.compile(r"[^\W_]+").findall
#: features are told apart by at most this much of a word before they are looked up
_KEY_CHARS = min(PREFIX_CHARS)


def words_of(text: str) -> set[str]:
    """Distinct words of at least three characters, in lower case."""
    return {word for word in set(_words(text.lower())) if len(word) > 2}


def features_of(word: str) -> tuple[str, ...]:
    """Features of one word: itself and its beginnings."""
    return (f"w:{word}", *(f"{n}:{word[:n]}" for n in PREFIX_CHARS if len(word) >= n))


def feature_finder(features):
    """Text -> those of its features that ``features`` holds. Most words fail the first look-up."""
    keys = {feature.split(":", 1)[1][:_KEY_CHARS] for feature in features}

    def find(text: str) -> set[str]:
        near = [word for word in words_of(text) if word[:_KEY_CHARS] in keys]
        return {f for word in near for f in features_of(word) if f in features}

    return find


@dataclass
class ToxicityModel:
    """Lexicon features with their voter, the label model's posteriors and the classifier's weights."""

    voter_of: dict[str, int] = field(default_factory=dict)
    posterior: dict[int, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -math.inf

    def scorer(self):
        weights, bias = self.weights, self.bias
        find = feature_finder(weights)

        def score(text: str) -> float:
            if bias == -math.inf:
                return 0.0
            z = bias + math.fsum(weights[f] for f in find(text))
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def _voter(voter_of: dict[str, int]):
    """Text -> bit set of the voters that call it toxic, and the lexicon features found."""
    find = feature_finder(voter_of)
    repeated, shouting = _VOTERS - 2, _VOTERS - 1

    def votes(text: str) -> tuple[int, set[str]]:
        found = find(text)
        bits = 0
        for f in found:
            bits |= 1 << voter_of[f]
        if sum(f.startswith("w:") for f in found) >= 2:
            bits |= 1 << repeated
        if text.isupper():
            bits |= 1 << shouting
        return bits, found

    return votes


def _labelled(docs: DataFrame, labels: DataFrame, label_col: str, training: Column, bound: int) -> DataFrame:
    """Texts of at most about ``bound`` labelled training rows, chosen by a hash of their ids."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("label_id"), labels[label_col].cast("int").alias("label"))
        .filter("label_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("label_id")
        .agg(F.max("label").alias("label"))
    )
    share = min(1.0, bound / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most about ``bound`` rows of two numbers, whatever the table's size
    sample = docs.filter(training).join(F.broadcast(chosen), docs["doc_id"] == chosen["label_id"]).select("doc_id", "text", "label")
    # Copies would make every word of a copied text look frequent: of texts that differ in case and white
    # space only and have the same label, the one of smallest id stays.
    digest = F.sha2(F.trim(F.regexp_replace(F.lower("text"), "\\s+", " ")), 256)
    first = sample.groupBy(digest.alias("digest"), "label").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    return first.select("first.text", "label")


def _induce_lexicons(sample: DataFrame, least: int = 4, purity: float = 0.97) -> dict[str, int]:
    """Features that hardly occur outside toxic texts, each dealt to a voter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[str, int], int] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                for f in {f for word in words_of(text) for f in features_of(word)}:
                    tally[f, label] = tally.get((f, label), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f for f, _ in tally], pa.string()),
                    pa.array([n if y else 0 for (_, y), n in tally.items()], pa.int64()),
                    pa.array([0 if y else n for (_, y), n in tally.items()], pa.int64()),
                ],
                names=["feature", "toxic", "other"],
            )

    counted = sample.mapInArrow(count, "feature string, toxic long, other long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")
    )
    best = (
        counted.filter((F.col("toxic") >= least) & (F.col("toxic") >= purity * (F.col("toxic") + F.col("other"))))
        .orderBy(F.desc("toxic"), "feature")
        .limit(MAX_FEATURES)
        .collect()
    )
    voter_of: dict[str, int] = {}
    dealt = 0
    for row in best:
        kind = row["feature"].split(":", 1)[0]
        if kind == "w":
            voter_of[row["feature"]] = dealt % WORD_LEXICONS
            dealt += 1
        else:
            voter_of[row["feature"]] = WORD_LEXICONS + PREFIX_CHARS.index(int(kind))
    return voter_of


def fit_label_model(patterns: dict[int, int], voters: int, rounds: int = 60, start: dict[int, float] | None = None):
    """pattern -> posterior of the positive class, from counts of vote patterns.

    Given the class, the votes form a tree: each voter depends on at most one other one. The tree is the
    one of largest conditional mutual information under the posteriors; it is drawn anew in every round.
    """
    codes = sorted(patterns)
    votes = np.array([[code >> j & 1 for j in range(voters)] for code in codes], dtype=int).reshape(len(codes), voters)
    counts = np.array([patterns[code] for code in codes], dtype=float)
    if start:
        q = np.array([start.get(code, 0.5) for code in codes])
    else:
        q = 1 / (1 + np.exp(3 - 2.0 * votes.sum(axis=1)))
    smooth = 0.5
    for _ in range(rounds):
        by_class = [counts * (1 - q), counts * q]
        prior = np.array([w.sum() + smooth for w in by_class])
        prior /= prior.sum()
        joint = np.zeros((2, voters, voters, 2, 2))
        for y, w in enumerate(by_class):
            for i in range(voters):
                for j in range(voters):
                    cells = np.bincount(votes[:, i] * 2 + votes[:, j], weights=w, minlength=4).reshape(2, 2)
                    joint[y, i, j] = (cells + smooth / 2) / (w.sum() + 2 * smooth)
        information = np.zeros((voters, voters))
        for i in range(voters):
            for j in range(voters):
                if i != j:
                    for y in (0, 1):
                        p = joint[y, i, j]
                        apart = p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)
                        information[i, j] += prior[y] * float((p * np.log(p / apart)).sum())
        parent = {0: None}
        while len(parent) < voters:
            _, i, j = max((information[i, j], i, j) for i in parent for j in range(voters) if j not in parent)
            parent[j] = i
        log_p = np.tile(np.log(prior), (len(codes), 1))
        for y in (0, 1):
            for j, i in parent.items():
                if i is None:
                    log_p[:, y] += np.log(joint[y, j, j].diagonal() / joint[y, j, j].diagonal().sum())[votes[:, j]]
                else:
                    given = joint[y, i, j] / joint[y, i, j].sum(axis=1, keepdims=True)
                    log_p[:, y] += np.log(given[votes[:, i], votes[:, j]])
        q = 1 / (1 + np.exp(np.clip(log_p[:, 0] - log_p[:, 1], -500, 500)))
    return dict(zip(codes, q.tolist()))


def _fit_logistic(
    alike: DataFrame, posterior: dict[int, float], n_features: int, ridge: float = 0.1, rounds: int = 12
) -> tuple[np.ndarray, float]:
    """Newton steps on soft labels; returns weights and bias. ``alike``: votes, hits, n for texts that count ``n`` times.

    Slope and curve are summed in Spark. Their terms are multiples of 2 ** -20, so the sums are the same in any order.
    """
    size = n_features + 1
    w = np.zeros(size)
    penalty = np.full(size, ridge)
    penalty[n_features] = 1e-6

    def partial(w: np.ndarray):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size + 1, size))  # the slope below the curve
            for batch in (b.slice(at, MATRIX_ROWS) for b in batches for at in range(0, b.num_rows, MATRIX_ROWS)):
                x = np.zeros((batch.num_rows, size))
                x[:, n_features] = 1
                for i, on in enumerate(batch.column("hits").to_pylist()):
                    x[i, on] = 1
                y = np.array([posterior[v] for v in batch.column("votes").to_pylist()])
                many = np.array(batch.column("n").to_pylist(), float)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                bent, off = (np.round(many * v * 2**20) / 2**20 for v in (np.maximum(p * (1 - p), 1e-6), p - y))
                total[:size] += (x * bent[:, None]).T @ x
                total[size] += x.T @ off
            flat = total.ravel()
            cells = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(flat[cells])], names=["cell", "value"])

        return add

    for _ in range(rounds):
        sums = alike.mapInArrow(partial(w), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        total = np.zeros((size + 1) * size)
        for row in sums.collect():  # at most (MAX_FEATURES + 2) squared
            total[row["cell"]] = row["value"]
        total = total.reshape(size + 1, size)
        step = np.linalg.solve(total[:size] + np.diag(penalty), total[size] + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w[:n_features], float(w[n_features])


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    labelled_rows: int = LABELLED_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> ToxicityModel:
    """A model learnt from rows outside the held-out fold (crc32 of the id as text, modulo 4, is 2).

    Votes are counted over all training texts and the classifier is fitted on all of them; only the lexicons come
    from a sample, bounded by ``labelled_rows``. Without a toxic labelled row every score is 0. Null labels, null ids and
    labels of absent documents are ignored; of several labels of one id the largest counts.
    """
    rows = text_rows(docs, id_col, text_col)
    training = crc_bucket(F.col("doc_id"), 4) != 2
    sample = _labelled(rows, labels, label_col, training, labelled_rows)
    voter_of = _induce_lexicons(sample)
    if not voter_of:
        return ToxicityModel()
    names = sorted(voter_of)
    place = {f: i for i, f in enumerate(names)}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = _voter(voter_of)
        for batch in batches:
            cast = [votes(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bits for bits, _ in cast], pa.int32()),
                    pa.array([sorted(place[f] for f in found) for _, found in cast], pa.list_(pa.int32())),
                ],
                names=["votes", "hits"],
            )

    cast = rows.filter(training).select("text").mapInArrow(vote, "votes int, hits array<int>")
    # Texts with the same features are one row.
    alike = reliable(cast.groupBy("votes", "hits").agg(F.count(F.lit(1)).alias("n")))
    # Vote patterns: at most 2 ** voters of them.
    counted = {row["votes"]: row["n"] for row in alike.groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    posterior = fit_label_model(counted, _VOTERS)
    parts = min(tasks_for(docs), 4 + alike.count() // 20_000)
    weights, bias = _fit_logistic(alike.coalesce(parts), posterior, len(names))
    return ToxicityModel(voter_of, posterior, dict(zip(names, weights.tolist())), bias)


def toxicity_score(model: ToxicityModel):
    """Column function: score of a text column, 0 to 1; null counts as empty."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rate = model.scorer()
        for texts in parts:
            yield pd.Series([rate(text or "") for text in texts], dtype="float64")

    return score


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts have a score too.

    Repeated rows give repeated results; of a null id held_out is null; an empty table gives no rows.
    """
    rows = text_rows(docs, id_col, text_col).select("doc_id", toxicity_score(model)("text").alias("score"))
    return rows.select(
        "doc_id",
        (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` below the threshold, with their columns."""
    score = toxicity_score(model)(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.filter(score < threshold)
