"""Quality by hierarchical empirical Bayes.

Every document has evidence of its own: the log odds of a logistic regression on properties of its text.
The expected share of good documents of a host, and of a path below it, comes from grouped sums of that
evidence; sparse sites shrink to the level above, with a strength estimated from the spread between the
sites. The document's evidence is then combined with the share of the others at its path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import crc_bucket, reliable

#: labelled rows on which the classifier is fitted
LABELLED_ROWS = 20_000
KEEP_FROM = 0.5
_EPS = 1e-4
#: strength of a site's prior where the spread between sites can't be estimated
_DEFAULT_STRENGTH = 20.0

_CLASSES = np.zeros((256, 6))
_CLASSES[[*range(97, 123)], 0] = 1  # a-z
_CLASSES[[*range(65, 91)], 1] = 1  # A-Z
_CLASSES[[*range(48, 58)], 2] = 1  # digits
_CLASSES[[9, 10, 11, 12, 13, 32], 3] = 1  # white space
_CLASSES[[33, 44, 46, 58, 59, 63, 39, 34], 4] = 1  # marks of plain prose
_CLASSES[[*range(128, 256)], 5] = 1  # other letters, mostly
N_FEATURES = 16


def text_features(text: str) -> list[float]:
    """Shares and means that describe a text, each between about 0 and 1."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(raw)
    if not n:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    shares = (np.bincount(raw, minlength=256) @ _CLASSES / n).tolist()
    symbols = max(0.0, 1 - sum(shares))
    words = text.split()
    count = len(words)
    lines = [line for line in text.split("\n") if line]
    distinct = set(words)
    letters = shares[0] + shares[1] + shares[5]
    return [
        *shares,
        symbols,
        min(1.0, 10 * symbols),
        shares[1] / letters if letters else 0.0,
        min(1.0, math.log1p(count) / 10),
        len(distinct) / count if count else 0.0,
        min(1.0, sum(map(len, distinct)) / len(distinct) / 20) if distinct else 0.0,
        len(set(lines)) / len(lines) if lines else 0.0,
        min(1.0, count / len(lines) / 50) if lines else 0.0,
        1.0 if count < 12 else 0.0,
        0.0,
    ]


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray
    base_rate: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.centre) / self.scale
        x = np.hstack([x, x * x])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    labelled_rows: int = LABELLED_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> QualityModel:
    """The document classifier, from a bounded sample of labelled rows outside the held-out fold.

    Held out are ids whose crc32 (as text) modulo 4 is 2. Null labels and ids, and labels of absent
    documents, are ignored. Without labels of both kinds every document gets the base rate.
    """
    known = (
        labels.select(labels["doc_id"].cast("long").alias("label_id"), labels[label_col].cast("int").alias("label"))
        .filter("label_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("label_id")
        .agg(F.max("label").alias("label"))
    )
    share = min(1.0, labelled_rows / max(1, known.count()))
    chosen = known.filter(
        (F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(share * 1_000_000)) & (crc_bucket(F.col("label_id"), 4) != 2)
    )
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # at most about ``labelled_rows`` rows of two numbers, whatever the table's size
    sample = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["label_id"]).select("text", "label")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [text_features(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(features, pa.list_(pa.float64())), batch.column("label")], names=["features", "label"]
            )

    got = sample.mapInArrow(describe, "features array<double>, label int").collect()
    y = np.array([row["label"] for row in got], float)
    if not len(got) or y.min() == y.max():
        rate = float(y.mean()) if len(got) else 0.5
        rate = min(1 - _EPS, max(_EPS, rate))
        zeros = np.zeros(N_FEATURES)
        return QualityModel(np.zeros(2 * N_FEATURES), math.log(rate / (1 - rate)), zeros, zeros + 1, rate)
    raw = np.array([row["features"] for row in got])
    centre, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-6
    x = (raw - centre) / scale
    x = np.hstack([x, x * x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], 1.0)
    penalty[-1] = 1e-6
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ x + np.diag(penalty)
        w -= np.linalg.solve(curve, x.T @ (p - y) + penalty * w)
    return QualityModel(w[:-1], float(w[-1]), centre, scale, float(y.mean()))


def _logit(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(_EPS)), F.lit(1 - _EPS))
    return F.log(held / (1 - held))


def _strength(groups: DataFrame, centre: Column) -> float:
    """Pseudo-count of a level's prior, by moments: how far the groups' means spread beyond their noise.

    ``groups``: n, good (sum of evidence), and what ``centre`` needs. One row of sums reaches the driver.
    """
    mean = F.col("good") / F.col("n")
    noise = centre * (1 - centre)
    sums = groups.filter("n >= 2").select(
        F.sum(F.col("n") * (mean - centre) ** 2).alias("spread"), F.sum(noise).alias("noise"), F.sum("n").alias("n"),
        F.sum(noise * F.col("n")).alias("weighted"),
    ).first()
    if not sums["n"]:
        return _DEFAULT_STRENGTH
    between = (sums["spread"] - sums["noise"]) / sums["n"]
    within = sums["weighted"] / sums["n"]
    if between <= 0 or within <= 0:
        return 1e4  # the sites don't differ: all weight to the level above
    return min(1e4, max(1.0, within / between - 1))


def score_quality(
    docs: DataFrame,
    model: QualityModel,
    host: Column,
    path: Column,
    keep_from: float = KEEP_FROM,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score, keep for every row.

    ``evidence`` is the classifier's probability, the rates are the shrunken shares of good documents
    among the others of the host and the path, ``score`` is the posterior. A null text is empty; a null
    host or path is a site of its own; repeated rows count each; an empty table gives no rows. Site sums
    are made in the tasks before the shuffle, so a site with a third of all rows is one row a task.
    """

    @F.pandas_udf("double")
    def classify(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            features = np.array([text_features(text or "") for text in texts]).reshape(len(texts), N_FEATURES)
            yield pd.Series(model.probability(features))

    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        classify(docs[text_col].cast("string")).alias("evidence"),
    )
    # Rounded, so that sums do not depend on the order of rows.
    rows = rows.withColumn("evidence", F.round("evidence", 9))
    exact = F.sum(F.col("evidence").cast("decimal(20,9)")).cast("double")
    # One narrow row per (host, path): all later sums come from these.
    paths = reliable(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), exact.alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    rate = total["good"] / total["n"] if total["n"] else model.base_rate
    host_strength = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good")), F.lit(rate))
    path_strength = _strength(
        paths.join(hosts, "host").withColumn("centre", F.col("host_good") / F.col("host_n")), F.col("centre")
    )
    sites = paths.join(hosts, "host").withColumnsRenamed({"n": "path_n", "good": "path_good"})
    own = F.col("evidence")
    # the other documents of the site: a text must not be evidence for itself twice
    host_rate = (F.col("host_good") - own + rate * host_strength) / (F.col("host_n") - 1 + host_strength)
    path_rate = (F.col("path_good") - own + F.col("host_rate") * path_strength) / (F.col("path_n") - 1 + path_strength)
    posterior = 1 / (1 + F.exp(-(_logit(own) - _logit(F.lit(model.base_rate)) + _logit(F.col("path_rate")))))
    return (
        rows.join(sites, ["host", "path"])
        .withColumn("host_rate", host_rate)
        .withColumn("path_rate", path_rate)
        .withColumn("score", posterior)
        .select("doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= keep_from).alias("keep"))
    )
