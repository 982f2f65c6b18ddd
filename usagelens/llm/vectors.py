"""Integer vectors: which rows are kept, how components become integers, columns as matrices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.operators.skew import BROADCAST_ROWS, salted_join

#: integers are kept within this, so that squared distances of a few hundred components fit into a long
LARGEST = (1 << 26) - 1
#: sums of distances stop here
MOST = (1 << 63) - 1
#: products of such integers and their sums over 64 components are exact in a double
_EXACT = 1 << 23


def is_finite(vector: Column) -> Column:
    """True for a vector without null and non-finite components, else false or null."""
    return F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))


def floor_scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component x, as array of int; beyond ``LARGEST`` it stays there."""
    limit = F.lit(float(LARGEST))
    return F.transform(
        vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), -limit), limit).cast("int")
    )


def matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """Rows of a list column, each of ``width`` values."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1), kind))


def all_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` and all ``centres``, integers."""
    if max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)) < _EXACT and x.shape[1] <= 64:
        p, q = x.astype(np.float64), centres.astype(np.float64)
        both = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (p @ q.T)
        return both.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def floor_means(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """floor(sum / count) by component; rows without members stay."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], old)


def decimal_sha256(values: Iterable[int]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in values).encode()).hexdigest()


def total(distance: Column) -> Column:
    """Sum of distances as long, at most ``MOST``."""
    return F.least(F.sum(distance.cast("decimal(19,0)")), F.lit(MOST).cast("decimal(29,0)")).cast("long")


def join_totals(rows: DataFrame, totals: DataFrame, key: str, room: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the columns of ``totals`` (one row a key, no null keys): sent to all tasks if few, by count."""
    if totals.limit(room + 1).count() <= room:
        return rows.join(F.broadcast(totals), key)
    return salted_join(rows, totals, [key])
