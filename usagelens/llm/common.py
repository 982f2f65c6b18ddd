"""Helpers shared by the training-data operators.

Rules that hold for every operator here: a null text counts as empty; columns beyond those named are
ignored, whatever their names; rows that repeat one id count each; a null id is carried along as null.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: letters whose case is folded: A-Z only, as every contract here asks
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD_BYTES = bytes.maketrans(_UPPER, _UPPER.lower())

#: white space between words, and a word
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: bytes of rows that a task hands to Python at once
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches end at so many bytes too: by rows alone, long texts and sets make them as large as they are."""
    bound = spark.conf.get(_BATCH_CONF, None)
    if bound is None or not bound.isdigit() or int(bound) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


BatchFn = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(fn: BatchFn) -> BatchFn:
    """``fn`` for mapInArrow, after which Arrow gives back what it holds unused: a worker stays for the tasks of later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return run


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as long and the text as string without nulls; nothing else is read. Its batches are bounded in bytes."""
    bound_batches(docs.sparkSession)
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from the session. Only a local session may go without: it gets one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="usagelens-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage on shared storage; what is lost with an executor is read again from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle tasks: the session's setting, which follows the data's size."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: ids that are sent to all tasks; longer lists are shuffled together with the documents
BROADCAST_IDS = 500_000


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", room: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` with an id that some row of ``verdicts(doc_id, kept)`` keeps; null ids stay."""
    gone = verdicts.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept AND doc_id IS NOT NULL")
    ids = reliable(gone.select(F.col("doc_id").alias("_gone")))
    listed = F.broadcast(ids) if ids.limit(room + 1).count() <= room else ids
    return docs.join(listed, docs[id_col].cast("long") == listed["_gone"], "left_anti")


QueryFn = Callable[[SparkSession, str], DataFrame]
