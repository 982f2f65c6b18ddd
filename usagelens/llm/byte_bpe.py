"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into windows that overlap; the windows are pre-tokenised apart from each other, each
from its own first character. Pre-tokenising looks only forward, so from the first boundary that two
neighbours share on, the later one is right; there the pieces are stitched and then encoded. A text of
one window needs no stitching. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import sys
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.bpe import Memo, merge_pairs, merge_short, pair_table
from usagelens.llm.common import tasks_for, text_rows, tidy

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
#: characters that a pre-token's end may depend on
_LOOK_AHEAD = 4
#: pieces up to so many bytes are merged by scanning
_SHORT = 40

#: white space of the Unicode property, which the pattern's \s means
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _exact(pattern: str) -> str:
    """The pattern with its \\s spelt out, so that every library reads it alike."""
    return pattern.replace(r"[^\s", rf"[^{_WS}").replace(r"\s", f"[{_WS}]").replace(r"\S", f"[^{_WS}]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PieceEncoder:
    """Encodes stretches of text that begin and end at pre-token boundaries."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self._ranks = ranks
        self._pairs = pair_table(ranks)
        self._byte_ids = [ranks.get(bytes([b])) for b in range(256)]
        self.pre_tokens = regex.compile(_exact(pattern))
        self._ids = Memo(self._encode_piece, units=140_000)

    def _encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        whole = self._ranks.get(raw)
        if whole is not None:
            ids = [whole]
        elif len(raw) <= _SHORT:
            ids = merge_short(list(map(self._byte_ids.__getitem__, raw)), self._pairs)
        else:
            ids = map(self._ranks.__getitem__, merge_pairs([raw[i : i + 1] for i in range(len(raw))], self._ranks))
        return _little_endian(ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._ids.__getitem__, self.pre_tokens.findall(text)))

    def boundaries(self, text: str) -> list[int]:
        return [m.end() for m in self.pre_tokens.finditer(text)]


def _little_endian(ids: Iterable[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def windows_of(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
    """(start, head_to, reach, text) of each window.

    ``reach`` is a place where any tokenising has a boundary (white space begins), at least ``overlap``
    behind the chunk, or the text's end; the next window starts at least ``overlap`` before it, so that
    the two share a boundary. ``head_to`` is the previous window's reach.
    """
    begins = regex.compile(f"(?<=[^{_WS}])[{_WS}]").search
    start, head_to, n = 0, 0, len(text)
    while True:
        found = begins(text, start + chunk + overlap) if start + chunk + overlap < n else None
        reach = found.start() if found else n
        yield start, head_to, reach, text[start : min(n, reach + _LOOK_AHEAD)]
        if reach == n:
            return
        start, head_to = max(start + chunk, reach - overlap), reach


_WINDOW = "row_id long, doc_id long, k int, start long, next_start long, head_to long, reach long, text string"


def _cut_windows(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                windows = list(windows_of(row["text"], chunk, overlap))
                starts = [w[0] for w in windows[1:]] + [len(row["text"])]
                yield pa.RecordBatch.from_pylist(
                    [
                        {"row_id": row["row_id"], "doc_id": row["doc_id"], "k": k, "start": start,
                         "next_start": following, "head_to": head_to, "reach": reach, "text": text}
                        for k, ((start, head_to, reach, text), following) in enumerate(zip(windows, starts))
                    ],
                    schema=pa.schema(
                        [("row_id", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("start", pa.int64()),
                         ("next_start", pa.int64()), ("head_to", pa.int64()), ("reach", pa.int64()), ("text", pa.string())]
                    ),
                )

    return rows.mapInArrow(cut, _WINDOW)


def _pre_tokenise(windows: DataFrame, pattern: str) -> DataFrame:
    """Adds each window's own boundaries in its two overlaps: ``head`` and ``tail``."""
    longs = pa.list_(pa.int64())

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder({}, pattern)
        for batch in batches:
            heads, tails = [], []
            for row in batch.select(["start", "next_start", "head_to", "reach", "text"]).to_pylist():
                start = row["start"]
                ends = [start + b for b in encoder.boundaries(row["text"])]
                heads.append(ends[: bisect_right(ends, row["head_to"])])
                tails.append(ends[bisect_left(ends, row["next_start"] + 1) : bisect_right(ends, row["reach"])])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, longs), pa.array(tails, longs)], names=[*batch.schema.names, "head", "tail"]
            )

    return windows.mapInArrow(tokenise, f"{_WINDOW}, head array<long>, tail array<long>")


def _stitch(windows: DataFrame) -> DataFrame:
    """row_id, doc_id, k, piece: the stretches between the boundaries that neighbours share."""
    by_row = Window.partitionBy("row_id").orderBy("k")
    shared = F.array_min(F.array_intersect(F.lag("tail").over(by_row), "head"))
    cut = F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(shared)
    placed = windows.withColumn("cut", cut).withColumn(
        "until", F.coalesce(F.lead("cut").over(by_row), F.col("reach"))
    )
    begin = (F.col("cut") - F.col("start") + 1).cast("int")
    length = (F.col("until") - F.col("cut")).cast("int")
    return placed.select("row_id", "doc_id", "k", F.col("text").substr(begin, length).alias("text"))


def encode_texts(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers as binary) for every row.

    A null text is empty and has no ids; repeated rows give repeated results; a null id stays null; an
    empty table gives no rows. ``ranks`` goes to every worker: its size is that of the rank file.

    With ``decoded``, what ``decode_ids`` adds as well. The ids of a text of one window are decoded in the task that
    made them: two Python functions in one stage would be two workers a core, which stay for all later stages.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.RecordBatch], decoded: bool = False) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(shared.value, pattern)
        decode = id_decoder(tokens_by_id(shared.value)) if decoded else None
        for batch in batches:
            place = batch.schema.get_field_index("text")
            ids = [encoder.encode(text) for text in batch.column(place).to_pylist()]
            columns, names = [*batch.columns[:place], pa.array(ids, pa.binary())], [*batch.schema.names[:place], "ids"]
            if decode:
                columns, names = [*columns, pa.array([decode(i) for i in ids], pa.binary())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def counted(encoded: DataFrame, *more: str) -> DataFrame:
        return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", *more)

    rows = text_rows(docs, id_col, text_col)
    long = F.char_length("text") > chunk + overlap
    windows = _cut_windows(
        rows.filter(long).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"), chunk, overlap
    ).repartition(tasks_for(docs), "row_id", "k")
    pieces = _stitch(_pre_tokenise(windows, pattern)).mapInArrow(tidy(encode), "row_id long, doc_id long, k int, ids binary")
    parts = F.array_sort(F.collect_list(F.struct("k", F.hex("ids").alias("ids"))))
    joined = pieces.groupBy("row_id", "doc_id").agg(parts.alias("parts")).select(
        "doc_id", F.unhex(F.array_join(F.transform("parts", lambda p: p["ids"]), "")).alias("ids")
    )
    if decoded:
        whole = rows.filter(~long).mapInArrow(tidy(partial(encode, decoded=True)), "doc_id long, ids binary, decoded binary")
        return counted(whole, "decoded").unionByName(decode_ids(counted(joined), ranks))
    whole = rows.filter(~long).mapInArrow(tidy(encode), "doc_id long, ids binary")
    return counted(whole.unionByName(joined))


def tokens_by_id(ranks: dict[bytes, int]) -> list[bytes]:
    by_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return by_id


def id_decoder(by_id: list[bytes]) -> Callable[[bytes], bytes]:
    """Ids as little-endian integers -> the raw bytes they stand for."""
    raw = by_id.__getitem__

    def decode(ids: bytes) -> bytes:
        return b"".join(map(raw, np.frombuffer(ids, "<u4").tolist()))

    return decode


def decode_ids(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``decoded``: the raw bytes of the ids, one after the other."""
    tokens = encoded.sparkSession.sparkContext.broadcast(tokens_by_id(ranks))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = id_decoder(tokens.value)
        for batch in batches:
            decoded = [raw(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"]
            )

    return encoded.mapInArrow(decode, "doc_id long, n_tokens long, ids binary, decoded binary")
