"""Documents with the awkward cases every operator must take."""

from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
#: columns whose names operators use inside
CLASHES = ["node", "key", "label", "digest", "content", "words", "part", "score", "kept", "anchors", "places", "n",
           "bucket", "fold", "packed", "winner", "salt", "host", "path", "evidence", "ids", "row_id", "k", "_gone"]


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def awkward_rows() -> list[tuple]:
    base = words(1, 300)
    near = base[:150] + ["changed"] + base[151:]
    passage = words(2, 80)
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "ONE two"), (6, "one two"), (6, "one two"),
        (7, " ".join(base)), (8, " ".join(near)), (9, " ".join(base).upper()), (10, "x" * 50_000),
        (11, " ".join(words(3, 40) + passage + words(4, 40))), (12, " ".join(words(5, 10) + passage)),
        (13, "éÉ  ñÑ 漢字 😀 　 \x1c\x00 it's"), (14, "a b c d e"), (15, "a b c d e"), (15, " ".join(base)),
        (None, "one two"), (None, None), (16, " ".join(words(6, 4000))), (17, "\n".join(words(7, 60)) + " " + " ".join(passage)),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in CLASHES)
    rows = [(i, t, "s" if i and i % 2 else None, "en", *["clash"] * len(CLASHES)) for i, t in awkward_rows()]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
