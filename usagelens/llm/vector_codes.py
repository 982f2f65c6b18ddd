"""Product codes of vectors, trained by exact k-means in each part with norm-of-sum bounds.

A vector is cut into equal parts; each part position has a codebook. Every part keeps the index of its entry,
an upper bound of the distance to it and a lower bound of the distance to all others, each with the round it
was measured in. The codebooks of all rounds are retained, so a bound of round T is widened by the true net
displacement of the entries from T to now, |c_now - c_T|, not by the sum of the steps in between: entries that
move back and forth cost nothing, and a bound that still holds is left as it is, stamp included. Where bounds
don't tell, the distance to the own entry is measured, and if that doesn't tell either, the part is compared
with the whole codebook in integers; ties go to the smaller index.

Codebooks (parts x entries) and their sums are all that the driver sees. State is a table in shared storage,
written anew each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.scratch import Scratch
from usagelens.llm.vectors import (
    all_distances,
    decimal_sha256,
    floor_means,
    floor_scaled,
    is_finite,
    join_totals,
    lists,
    matrix,
    total,
)

#: relative margin of all bounds, far above the rounding errors of a double
MARGIN = 1e-12
#: rows of a batch that are compared with a whole codebook at once
ROWS_AT_ONCE = 16_384

_STATE = "vec_id long, label string, v array<int>, code array<int>, upper array<double>, lower array<double>, upper_at array<int>, lower_at array<int>"
_FIELDS = (("code", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("upper_at", pa.int32()), ("lower_at", pa.int32()))


class History:
    """The codebooks of one part position in all rounds, and how far entries are now from where they were."""

    def __init__(self, books: list[np.ndarray]) -> None:
        self.now = books[-1]
        self.round = len(books) - 1
        entries = len(self.now)
        net = np.sqrt(np.stack([((self.now - book) ** 2).sum(1) for book in books]).astype(float)) * (1 + MARGIN)
        self.net = net  # round, entry
        # the largest displacement of any other entry: the largest of all, or the second for that entry itself
        top = np.sort(net, axis=1)[:, ::-1]
        most, next_ = top[:, 0], top[:, 1] if entries > 1 else np.zeros(len(net))
        self.others = np.where(np.arange(entries)[None, :] == net.argmax(1)[:, None], next_[:, None], most[:, None])


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry, bounds of the distances to it and to the others, from all exact distances."""
    code, first, second = [], [], []
    for start in range(0, len(x), ROWS_AT_ONCE):
        d = all_distances(x[start : start + ROWS_AT_ONCE], book)
        at = d.argmin(1)
        code.append(at)
        first.append(np.take_along_axis(d, at[:, None], 1)[:, 0])
        second.append(np.partition(d, 1, axis=1)[:, 1].astype(float) if d.shape[1] > 1 else np.full(len(d), np.inf))
    if not code:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    upper, lower = np.concatenate(first).astype(float), np.concatenate(second)
    return np.concatenate(code), np.sqrt(upper) * (1 + MARGIN), np.sqrt(lower) * (1 - MARGIN)


def reassign(x: np.ndarray, state: tuple, history: History) -> tuple[tuple, int]:
    """(code, upper, lower, upper_at, lower_at) of one part after the codebook moved; how many parts were rescanned."""
    code, upper, lower, upper_at, lower_at = (column.copy() for column in state)
    low = lower - history.others[lower_at, code]
    low *= np.where(low > 0, 1 - MARGIN, 1 + MARGIN)
    todo = np.flatnonzero((upper + history.net[upper_at, code]) * (1 + MARGIN) >= low)
    own = ((x[todo] - history.now[code[todo]]) ** 2).sum(1)
    upper[todo], upper_at[todo] = np.sqrt(own.astype(float)) * (1 + MARGIN), history.round
    todo = todo[upper[todo] >= low[todo]]
    code[todo], upper[todo], lower[todo] = scan(x[todo], history.now)
    upper_at[todo] = lower_at[todo] = history.round
    return (code, upper, lower, upper_at, lower_at), len(todo)


def _assign(rows: DataFrame, books: list[np.ndarray], dims: int) -> DataFrame:
    """State rows after the last of ``books`` (each parts x entries x width), first assignment or a later one."""
    parts, _, width = books[0].shape
    begin = len(books) == 1
    histories = [History([book[part] for book in books]) for part in range(parts)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), dims)
            x = v.reshape(len(v), parts, width)
            held = None if begin else [matrix(batch.column(name), parts, kind.to_pandas_dtype()) for name, kind in _FIELDS]
            new = []
            for part, history in enumerate(histories):
                if begin:
                    at = np.zeros(len(v), np.int64)
                    new.append((*scan(x[:, part], history.now), at, at))
                else:
                    new.append(reassign(x[:, part], tuple(column[:, part] for column in held), history)[0])
            columns = [lists(np.stack(column, axis=1), kind) for column, (_, kind) in zip(zip(*new), _FIELDS)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), lists(v, pa.int32()), *columns],
                names=["vec_id", "label", "v", *(name for name, _ in _FIELDS)],
            )

    return rows.mapInArrow(assign, _STATE)


def _next_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floor of their parts' mean; every task sends one row an entry at most."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            v = matrix(batch.column("v"), parts * width)
            slots = matrix(batch.column("code"), parts) + np.arange(parts) * entries
            order = np.argsort(slots.reshape(-1), kind="stable")
            slot, first, members = np.unique(slots.reshape(-1)[order], return_index=True, return_counts=True)
            if len(slot):
                sums[slot] += np.add.reduceat(v.reshape(-1, width)[order], first, axis=0)
                counts[slot] += members
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), lists(sums[used], pa.int64()), pa.array(counts[used])], names=["slot", "sums", "members"]
        )

    sent = state.select("code", "v").mapInArrow(add, "slot int, sums array<long>, members long")
    by_place = sent.select("slot", "members", F.posexplode("sums").alias("place", "value"))
    found = by_place.groupBy("slot", "place").agg(F.sum("value").alias("value"), F.sum("members").alias("members"))
    sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    table = found.toArrow()  # parts * entries * width rows
    slot, place = table.column("slot").to_numpy(), table.column("place").to_numpy()
    sums[slot, place] = table.column("value").to_numpy()
    counts[slot] = table.column("members").to_numpy()
    return floor_means(sums, counts, books.reshape(-1, width)).reshape(books.shape)


def encode_vectors(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every kept vector.

    Kept are vectors without null and non-finite components, of the length that most of them have (the shorter
    of equally frequent ones; lengths that ``parts`` doesn't divide are out). Component x becomes the integer
    floor(``scale`` * x), held within +-(2^26 - 1). Codebooks start as the parts of the ``entries`` smallest ids
    (rows that repeat an id by the vector, null ids last; with fewer vectors there are fewer entries), are replaced
    ``rounds`` times by the floor of their parts' mean, and parts are assigned once more at the end. Unused entries
    stay; ties go to the smaller index. ``code`` has two hexadecimal digits a part, so at most 256 entries.
    ``label_error`` sums the error over equal labels, null labels together. Without kept vectors there are no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hexadecimal digits takes 1 to 256 entries")
    spark = vectors.sparkSession
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    vector = vectors[vector_col]
    label = F.coalesce(F.concat(F.lit("="), vectors[label_col].cast("string")), F.lit("none"))
    finite = vectors.filter(is_finite(vector) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    lengths = finite.groupBy(F.size(vector).alias("length")).count()
    usual = lengths.orderBy(F.desc("count"), "length").limit(1).collect()
    if not usual:
        return spark.createDataFrame([], schema)
    dims = usual[0]["length"]
    width = dims // parts
    kept = finite.filter(F.size(vector) == dims).select(
        vectors[id_col].cast("long").alias("vec_id"), label.alias("label"), floor_scaled(vector, scale).alias("v")
    )
    first = kept.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    start = np.array([row["v"] for row in first], np.int64).reshape(len(first), parts, width)
    books = [start.transpose(1, 0, 2)]
    scratch = Scratch(spark)
    state = scratch.save(_assign(kept, books, dims), "round-0")
    for number in range(1, rounds + 1):
        books.append(_next_books(state, books[-1]))
        state = scratch.save(_assign(state, books, dims), f"round-{number}")
        scratch.drop(f"round-{number - 1}")
    final = books[-1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = matrix(batch.column("code"), parts)
            x = matrix(batch.column("v"), dims).reshape(len(code), parts, width)
            error = ((x - final[np.arange(parts)[None, :], code]) ** 2).sum((1, 2))
            digits = [row.tobytes().hex() for row in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(digits, pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    measured = state.select("vec_id", "label", "v", "code").mapInArrow(
        measure, "vec_id long, label string, code string, error long"
    )
    totals = scratch.save(measured.groupBy("label").agg(total(F.col("error")).alias("label_error")), "labels")
    return join_totals(measured, totals, "label").select(
        "vec_id", "code", "error", "label_error", F.lit(decimal_sha256(final.reshape(-1))).alias("codebooks_sha256")
    )
