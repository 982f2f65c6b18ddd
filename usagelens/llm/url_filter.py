"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

The model is fitted on the driver from a small labelled table of URLs (its size is a parameter of the
caller, not of the pages); scoring is a map over the pages without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.bpe import Memo

#: hashed n-gram features of a host or a path
DIMENSIONS = 1 << 13
SIZES = (3, 4, 5)
#: a URL from this probability on is blocked
BLOCK_FROM = 0.5

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """From the host to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def match_rules(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _grams(part: str, text: str) -> list[int]:
    """Feature numbers of one part of a URL; the part's name keeps host and path apart."""
    marked = f"^{text}$"
    return [
        zlib.crc32(f"{part}{marked[i : i + n]}".encode("utf-8", "replace")) % DIMENSIONS
        for n in SIZES
        for i in range(len(marked) - n + 1)
    ]


def split_url(url: str | None) -> tuple[str, str]:
    """host_of and path_of for one URL, for the labelled table."""
    import re

    found = re.match(_PARTS, url or "")
    if not found:
        return "", ""
    return "".join(c.lower() if c in _UPPER else c for c in found[1]), found[2]


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def scorer(self):
        """(host, path) -> probability that the URL is to be blocked."""
        weights = self.weights

        def part(kind: str):
            def mean(text: str) -> float:
                on = sorted(set(_grams(kind, text)))
                return float(weights[on].sum()) / math.sqrt(len(on)) if on else 0.0

            return Memo(mean)

        hosts, paths = part("h"), part("p")
        return lambda host, path: 1 / (1 + math.exp(-max(-500.0, min(500.0, self.bias + hosts[host] + paths[path]))))


def train_url_model(labelled: Iterable[tuple[str, bool]], ridge: float = 0.02, rounds: int = 400) -> UrlModel:
    """``labelled``: (url, to be blocked). Without both classes the bias alone decides."""
    rows = list(labelled)
    y = np.array([1.0 if block else 0.0 for _, block in rows])
    x = np.zeros((len(rows), DIMENSIONS))
    for i, (url, _) in enumerate(rows):
        for kind, text in zip("hp", split_url(url)):
            on = sorted(set(_grams(kind, text)))
            if on:
                x[i, on] += 1 / math.sqrt(len(on))
    if not len(rows) or y.min() == y.max():
        return UrlModel(np.zeros(DIMENSIONS), 4.0 if len(rows) and y[0] else -4.0)
    w, bias = np.zeros(DIMENSIONS), 0.0
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-(x @ w + bias))) - y
        w -= 2.0 * (x.T @ off / len(rows) + ridge / len(rows) * w)
        bias -= 0.5 * off.mean()
    return UrlModel(w, float(bias))


def judge_urls(
    pages: DataFrame,
    rules: Iterable[Rule],
    model: UrlModel,
    id_col: str = "page_id",
    url_col: str = "url",
    block_from: float = BLOCK_FROM,
) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every row.

    A null URL, or one without ``://``, has an empty host and path and is judged by the model alone.
    Repeated rows give repeated results; a null id stays null; an empty table gives no rows.
    """

    @F.pandas_udf("double")
    def block_score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        rate = model.scorer()
        for hosts, paths in parts:
            yield pd.Series([rate(host, path) for host, path in zip(hosts, paths)], dtype="float64")

    url = pages[url_col].cast("string")
    parts = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, ruled = match_rules(F.col("host"), F.col("path"), rules)
    scored = parts.select("*", rule.alias("rule"), ruled.alias("ruled"), block_score("host", "path").alias("block_score"))
    return scored.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("block_score") >= block_from, "block").otherwise("allow")).alias("verdict"),
        "block_score",
    )
