"""Exact deduplication by skew-safe combining.

Copies are merged three times, each time by digest *and* full content: within a batch of rows in its
task, within a salted digest group, and over the winners of the salts. A content that makes up a third
of all rows thus reaches the last step as at most ``salts`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import FOLD_BYTES, keep_rows, reliable, text_rows, tidy

SALTS = 32
Digest = Callable[[bytes], str]


def sha256_hex(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def _contents(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        yield doc_id, text.translate(FOLD_BYTES)


def local_groups(rows: DataFrame, digest: Digest = sha256_hex) -> DataFrame:
    """Distinct contents of each batch: digest, content, largest id, number of rows."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[bytes, tuple[int | None, int]] = {}
            for doc_id, content in _contents(batch):
                winner, copies = best.get(content, (None, 0))
                if winner is None or (doc_id is not None and doc_id > winner):
                    winner = doc_id
                best[content] = (winner, copies + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([digest(content) for content in best], pa.string()),
                    pa.array(list(best), pa.binary()),
                    pa.array([winner for winner, _ in best.values()], pa.int64()),
                    pa.array([copies for _, copies in best.values()], pa.int64()),
                ],
                names=["digest", "content", "winner", "copies"],
            )

    return rows.mapInArrow(tidy(merge), "digest string, content binary, winner long, copies long")


def row_digests(rows: DataFrame, digest: Digest = sha256_hex, with_content: bool = False) -> DataFrame:
    """Per row: doc_id, digest, text_sha256 and, if asked for, the content."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents = zip(*_contents(batch)) if batch.num_rows else ((), ())
            sha = [sha256_hex(content) for content in contents]
            own = sha if digest is sha256_hex else [digest(content) for content in contents]
            columns = [pa.array(ids, pa.int64()), pa.array(own, pa.string()), pa.array(sha, pa.string())]
            names = ["doc_id", "digest", "text_sha256"]
            if with_content:
                columns, names = [*columns, pa.array(contents, pa.binary())], [*names, "content"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    extra = ", content binary" if with_content else ""
    return rows.mapInArrow(tidy(describe), f"doc_id long, digest string, text_sha256 string{extra}")


def combine_contents(rows: DataFrame, salts: int = SALTS, digest: Digest = sha256_hex) -> DataFrame:
    """One row per distinct (digest, content): keep_id, group_size."""
    salted = local_groups(rows, digest).withColumn("salt", F.spark_partition_id() % salts)
    merged = salted.groupBy("digest", "salt", "content").agg(
        F.max("winner").alias("winner"), F.sum("copies").alias("copies")
    )
    return merged.groupBy("digest", "content").agg(
        F.max("winner").alias("keep_id"), F.sum("copies").alias("group_size")
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Digest = sha256_hex,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Of equal texts (after lower-casing A-Z) the largest id stays. Null texts are empty texts. Rows that
    repeat one id count each in ``group_size`` and share the verdict; a null id stays only where its
    group has no other, and then keep_id is null. An empty table gives no rows.

    A row finds its group by digest alone while no two contents share a digest; where some do, the rows
    are matched by digest and content.
    """
    base = text_rows(docs, id_col, text_col)
    rows = base.withColumn("text", base["text"].cast("binary"))
    groups = reliable(combine_contents(rows, salts, digest).select("digest", "keep_id", "group_size"))
    if groups.groupBy("digest").count().filter("count > 1").isEmpty():
        found = row_digests(rows, digest).join(groups, "digest")
    else:
        exact = combine_contents(rows, salts, digest)
        found = row_digests(rows, digest, with_content=True).join(exact, ["digest", "content"])
    return found.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; rows of one id stay together, those of a null id stay."""
    return keep_rows(docs, exact_duplicates(docs, id_col, text_col), id_col)
