"""Exact k-means over integer vectors by Shallot search.

Every vector keeps its nearest and its second-nearest centroid, an upper bound of the distance to the first and
a lower bound of the distance to all others. After the centroids moved, bounds are widened by the moves; where
they no longer tell, both remembered centroids are measured and the search starts at the closer one, c: the
other centroids come in the order of their distance from c, and the search ends at the first one outside the
ball of radius d(x, c) + (distance of the second-nearest so far), which shrinks as better ones are found. Bounds
are doubles rounded outwards; what they leave over is compared in integers, ties to the smaller number.

Centroids (k x dims integers) and their sums are all that the driver sees. State is a table in shared storage,
written anew each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.scratch import Scratch
from usagelens.llm.vectors import decimal_sha256, floor_means, floor_scaled, is_finite, lists, matrix, total

#: relative margin of all bounds, far above the rounding errors of a double
MARGIN = 1e-12

_STATE = "vec_id long, v array<int>, nearest int, second int, upper double, lower double"


@dataclass
class Centroids:
    """The centroids of a round: by centroid the others in order of distance, and how far each one moved."""

    points: np.ndarray
    order: np.ndarray
    apart: np.ndarray
    moved: np.ndarray
    others_moved: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, last: np.ndarray | None = None) -> Centroids:
        k = len(points)
        squares = np.stack([((points - p) ** 2).sum(1) for p in points])
        order = np.argsort(squares, axis=1, kind="stable")
        order = np.stack([row[row != i] for i, row in enumerate(order)]) if k > 1 else np.zeros((1, 0), np.int64)
        apart = np.sqrt(np.take_along_axis(squares, order, axis=1).astype(float))
        moved = np.sqrt(((points - (points if last is None else last)) ** 2).sum(1).astype(float)) * (1 + MARGIN)
        others = np.array([max((moved[j] for j in range(k) if j != i), default=0.0) for i in range(k)])
        return cls(points, order, apart, moved, others)


def _squares(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return ((x - points) ** 2).sum(1)


def _search(x: np.ndarray, start: np.ndarray, other: np.ndarray, c: Centroids, at_start: np.ndarray | None = None):
    """Nearest and second-nearest centroid with exact squared distances, and the number of distances computed.

    Needs two centroids at least. ``at_start``: squared distances to ``start``, where known.
    """
    one = _squares(x, c.points[start]) if at_start is None else at_start
    two = _squares(x, c.points[other])
    cost = len(x) * (1 if at_start is not None else 2)
    swap = (two < one) | ((two == one) & (other < start))
    first, second = np.where(swap, other, start), np.where(swap, start, other)
    d1, d2 = np.where(swap, two, one), np.where(swap, one, two)
    centre, known, radius = first.copy(), second.copy(), np.sqrt(d1.astype(float))
    open_ = np.arange(len(x))
    for place in range(c.order.shape[1]):
        at = centre[open_]
        inside = c.apart[at, place] <= (radius[open_] + np.sqrt(d2[open_].astype(float))) * (1 + MARGIN)
        open_ = open_[inside]
        if not len(open_):
            break
        candidate = c.order[centre[open_], place]
        rows = open_[candidate != known[open_]]
        candidate = c.order[centre[rows], place]
        d = _squares(x[rows], c.points[candidate])
        cost += len(rows)
        best = (d < d1[rows]) | ((d == d1[rows]) & (candidate < first[rows]))
        next_ = ~best & (d < d2[rows])
        b = rows[best]
        second[b], d2[b], first[b], d1[b] = first[b], d1[b], candidate[best], d[best]
        n = rows[next_]
        second[n], d2[n] = candidate[next_], d[next_]
    return first, second, d1, d2, cost


def first_assignment(x: np.ndarray, c: Centroids):
    """(nearest, second, upper, lower), number of distances: a search from the first two centroids."""
    if len(c.points) == 1:
        zero = np.zeros(len(x), np.int64)
        upper = np.sqrt(_squares(x, c.points[zero]).astype(float)) * (1 + MARGIN)
        return (zero, zero, upper, np.full(len(x), np.inf)), len(x)
    first, second, d1, d2, cost = _search(x, np.zeros(len(x), np.int64), np.ones(len(x), np.int64), c)
    return (first, second, np.sqrt(d1.astype(float)) * (1 + MARGIN), np.sqrt(d2.astype(float)) * (1 - MARGIN)), cost


def next_assignment(x: np.ndarray, state: tuple, c: Centroids):
    """The state after the centroids moved, and the number of distances computed."""
    nearest, second, upper, lower = (column.copy() for column in state)
    if len(c.points) == 1:
        return first_assignment(x, c)
    upper = (upper + c.moved[nearest]) * (1 + MARGIN)
    lower = (lower - c.others_moved[nearest]) * np.where(lower > c.others_moved[nearest], 1 - MARGIN, 1 + MARGIN)
    half = c.apart[:, 0] / 2 * (1 - MARGIN)
    todo = np.flatnonzero(upper >= np.maximum(lower, half[nearest]))
    exact = _squares(x[todo], c.points[nearest[todo]])
    cost = len(todo)
    upper[todo] = np.sqrt(exact.astype(float)) * (1 + MARGIN)
    still = upper[todo] >= np.maximum(lower[todo], half[nearest[todo]])
    todo, exact = todo[still], exact[still]
    first, two, d1, d2, more = _search(x[todo], nearest[todo], second[todo], c, exact)
    nearest[todo], second[todo] = first, two
    upper[todo], lower[todo] = np.sqrt(d1.astype(float)) * (1 + MARGIN), np.sqrt(d2.astype(float)) * (1 - MARGIN)
    return (nearest, second, upper, lower), cost + more


def _assign(rows: DataFrame, c: Centroids, dims: int, begin: bool) -> DataFrame:
    """State rows with the assignment to the centroids ``c``."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dims)
            if begin:
                state, _ = first_assignment(x, c)
            else:
                held = [batch.column(name).to_numpy() for name in ("nearest", "second", "upper", "lower")]
                state, _ = next_assignment(x, (held[0].astype(np.int64), held[1].astype(np.int64), *held[2:]), c)
            columns = [pa.array(column, kind) for column, kind in zip(state, [pa.int32(), pa.int32(), pa.float64(), pa.float64()])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), lists(x, pa.int32()), *columns],
                names=["vec_id", "v", "nearest", "second", "upper", "lower"],
            )

    return rows.mapInArrow(assign, _STATE)


def _cluster_sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Componentwise sums and sizes of the clusters; every task sends one row a cluster at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, nearest = matrix(batch.column("v"), dims), batch.column("nearest").to_numpy()
            for j in np.unique(nearest):
                members = x[nearest == j]
                sums[j] += members.sum(0)
                counts[j] += len(members)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), lists(sums[used], pa.int64()), pa.array(counts[used])],
            names=["cluster", "sums", "members"],
        )

    parts = state.select("nearest", "v").mapInArrow(add, "cluster int, sums array<long>, members long")
    by_place = parts.select("cluster", "members", F.posexplode("sums").alias("place", "value"))
    found = by_place.groupBy("cluster", "place").agg(F.sum("value").alias("value"), F.sum("members").alias("members"))
    sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for row in found.collect():  # k * dims rows
        sums[row["cluster"], row["place"]] = row["value"]
        counts[row["cluster"]] = row["members"]
    return sums, counts


def cluster_vectors(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = 64,
    seed: str = "1:",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; component x becomes the integer
    floor(``scale`` * x), held within +-(2^26 - 1). Centroids start as the kept vectors of smallest SHA-256 of
    ``seed`` and the id (equal hashes, of rows that repeat an id, by the vector; null ids come last), are
    replaced ``rounds`` times by the floor of their vectors' mean, and vectors are assigned once more at the end.
    Empty centroids stay; ties go to the smaller number. Rows that repeat an id are vectors of their own. With
    fewer than ``k`` vectors each is a centroid; without any there are no rows. Sums of distances stop at 2^63 - 1.
    """
    spark = vectors.sparkSession
    vector = vectors[vector_col]
    kept = vectors.filter((F.size(vector) == dims) & is_finite(vector)).select(
        vectors[id_col].cast("long").alias("vec_id"), floor_scaled(vector, scale).alias("v")
    )
    rank = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(F.asc_nulls_last(rank), F.asc_nulls_last("vec_id"), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame(
            [],
            "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string",
        )
    scratch = Scratch(spark)
    points = np.array([row["v"] for row in first], np.int64)
    k = len(points)
    state = scratch.save(_assign(kept, Centroids.of(points), dims, begin=True), "round-0")
    for number in range(1, rounds + 1):
        last, points = points, floor_means(*_cluster_sums(state, k, dims), points)
        state = scratch.save(_assign(state, Centroids.of(points, last), dims, begin=False), f"round-{number}")
        scratch.drop(f"round-{number - 1}")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = batch.column("nearest").to_numpy()
            distance = _squares(matrix(batch.column("v"), dims), points[nearest])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("nearest"), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    measured = state.select("vec_id", "nearest", "v").mapInArrow(measure, "vec_id long, cluster int, distance long")
    by_cluster = {row["cluster"]: row["inertia"] for row in measured.groupBy("cluster").agg(total(F.col("distance")).alias("inertia")).collect()}
    whole = min(sum(by_cluster.values()), (1 << 63) - 1)
    facts = [(j, inertia, whole, decimal_sha256(points[j])) for j, inertia in by_cluster.items()]  # k rows at most
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
