"""Clustering and codes of vectors against plain k-means, their steps against full searches."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from usagelens.llm import centroid_clustering, vector_codes
from usagelens.llm.centroid_clustering import Centroids, cluster_vectors
from usagelens.llm.vector_codes import History, encode_vectors
from usagelens.llm.vectors import LARGEST, all_distances, decimal_sha256, floor_means

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string, cluster string, distance string, nearest string"


def nearest(x, points):
    d = ((x[:, None, :] - points[None, :, :]) ** 2).sum(2)
    at = d.argmin(1)
    return at, np.take_along_axis(d, at[:, None], 1)[:, 0]


def move(x, at, points):
    return np.array([x[at == j].sum(0) // (at == j).sum() if (at == j).any() else points[j] for j in range(len(points))])


def integers(rows, scale):
    return np.array([[np.floor(float(np.float32(c)) * scale) for c in v] for _, v, _ in rows]).clip(-LARGEST, LARGEST).astype(np.int64)


def brute_clusters(rows, k, rounds, scale):
    x = integers(rows, scale)
    rank = [(hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~", tuple(v)) for (i, _, _), v in zip(rows, x)]
    points = x[sorted(range(len(rows)), key=lambda r: rank[r])[:k]]
    for _ in range(rounds):
        points = move(x, nearest(x, points)[0], points)
    at, d = nearest(x, points)
    return sorted((str(i), int(a), int(e), int(d[at == a].sum()), int(d.sum()), decimal_sha256(points[a])) for (i, _, _), a, e in zip(rows, at, d))


def brute_codes(rows, parts, entries, rounds, scale):
    x = integers(rows, scale)
    width = x.shape[1] // parts
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, tuple(x[r])))[:entries]
    codes, errors, flat = [], np.zeros(len(rows), np.int64), []
    for p in range(parts):
        y = x[:, p * width : (p + 1) * width]
        book = y[order]
        for _ in range(rounds):
            book = move(y, nearest(y, book)[0], book)
        at, d = nearest(y, book)
        codes.append(at)
        errors += d
        flat += book.reshape(-1).tolist()
    labels = {label: int(errors[[r for r, row in enumerate(rows) if row[2] == label]].sum()) for _, _, label in rows}
    return sorted(
        (str(i), "".join(f"{c[r]:02x}" for c in codes), int(errors[r]), labels[label], decimal_sha256(flat))
        for r, (i, _, label) in enumerate(rows)
    )


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, *["clash"] * 5) for i, v, label in rows], SCHEMA).repartition(3)


def vectors(seed, n, dims=64, spread=0.2):
    rng = np.random.default_rng(seed)
    hubs = rng.normal(size=(7, dims))
    return [(int(i), (hubs[i % 7] + spread * rng.normal(size=dims)).astype(np.float32).tolist(), int(i % 3)) for i in range(n)]


def awkward_vectors():
    rows = vectors(5, 120)
    zero, same = [0.0] * 64, rows[3][1]
    rows += [(200, zero, None), (201, zero, None), (201, same, 1), (201, same, 1), (None, same, 2), (None, zero, None)]
    rows += [(202, [1e30] * 64, 1), (203, [-1e30] * 32 + [0.001] * 32, 1)]
    bad = [(300, None, 1), (301, [], 1), (302, [1.0] * 63, 1), (303, [None] + [1.0] * 63, 1), (304, [float("nan")] * 64, 1),
           (305, [float("inf")] + [0.0] * 63, None), (None, None, None), (306, [1.0] * 80, 1)]
    return rows, bad


def clusters_of(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def codes_of(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_clusters_awkward(spark):
    rows, bad = awkward_vectors()
    assert clusters_of(cluster_vectors(frame(spark, rows + bad))) == brute_clusters(rows, 16, 3, 64)


def test_codes_awkward(spark):
    rows, bad = awkward_vectors()
    assert codes_of(encode_vectors(frame(spark, rows + bad))) == brute_codes(rows, 16, 64, 2, 256)


@pytest.mark.parametrize("n", [1, 2, 9])
def test_few_vectors(spark, n):
    rows = vectors(1, n)
    df = frame(spark, rows)
    assert clusters_of(cluster_vectors(df)) == brute_clusters(rows, 16, 3, 64)
    assert codes_of(encode_vectors(df)) == brute_codes(rows, 16, 64, 2, 256)


def test_other_shapes_and_many_labels(spark, monkeypatch):
    rows = [(i, v, i) for i, v, _ in vectors(2, 40, dims=12)]
    df = frame(spark, rows + [(99, [1.0] * 64, 1)])
    assert clusters_of(cluster_vectors(df, k=3, rounds=5, dims=12, scale=10)) == brute_clusters(rows, 3, 5, 10)
    join = vector_codes.join_totals
    monkeypatch.setattr(vector_codes, "join_totals", lambda a, b, key: join(a, b, key, room=5))
    assert codes_of(encode_vectors(df, parts=4, entries=5, rounds=4)) == brute_codes(rows, 4, 5, 4, 256)


def test_no_vectors(spark):
    none = frame(spark, [(1, None, 1), (2, [float("nan")] * 64, 1)])
    for df in (none, none.limit(0)):
        assert cluster_vectors(df).collect() == [] and encode_vectors(df).collect() == []


def test_entries_limit(spark):
    with pytest.raises(ValueError):
        encode_vectors(frame(spark, vectors(1, 2)), entries=300)


@pytest.mark.parametrize("seed", range(4))
def test_shallot_steps_equal_full_searches_with_fewer_distances(seed):
    rng = np.random.default_rng(seed)
    hubs = rng.integers(-40, 40, size=(12, 6))
    x = hubs[rng.integers(0, 12, 900)] + rng.integers(-3 - seed, 4 + seed, size=(900, 6))
    points = x[rng.choice(900, 12, replace=False)].copy()
    points[5] = points[2]  # equal centroids: ties go to the smaller number
    state, cost = centroid_clustering.first_assignment(x, Centroids.of(points))
    saved = 0
    for _ in range(6):
        at, d = nearest(x, points)
        assert (state[0] == at).all()
        assert (state[2] >= np.sqrt(d)).all()
        others = ((x[:, None, :] - points[None, :, :]) ** 2).sum(2)
        others[np.arange(900), at] = np.iinfo(np.int64).max
        assert (state[3] <= np.sqrt(others.min(1).astype(float))).all()
        last, points = points, move(x, at, points)
        state, cost = centroid_clustering.next_assignment(x, state, Centroids.of(points, last))
        saved += 900 * 12 - cost
    assert saved > 6 * 900 * 12 // 2


def test_bounds_of_codes_use_net_displacement():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, size=(2000, 4))
    books = [x[:30].copy()]
    zeros = np.zeros(2000, np.int64)
    state = (*vector_codes.scan(x, books[0]), zeros, zeros)
    # entries go away and come back: net displacement nothing, accumulated drift large
    books.append(books[0] + 9)
    state, _ = vector_codes.reassign(x, state, History(books))
    assert (state[0] == nearest(x, books[-1])[0]).all()
    never = (*vector_codes.scan(x, books[0]), zeros, zeros)
    books.append(books[0].copy())
    again, rescanned = vector_codes.reassign(x, never, History(books))
    two = np.sort(((x[:, None] - books[0][None]) ** 2).sum(2), axis=1)
    ties = np.count_nonzero(two[:, 0] == two[:, 1])
    assert rescanned == ties
    assert (again[0] == nearest(x, books[-1])[0]).all() and (again[4] == never[4]).sum() == 2000 - ties
    for _ in range(5):
        books.append(move(x, state[0], books[-1]))
        state, _ = vector_codes.reassign(x, state, History(books))
        assert (state[0] == nearest(x, books[-1])[0]).all()


def test_exact_distances_of_large_integers():
    x = np.array([[LARGEST, -LARGEST, 3, 1], [0, 1, 2, 3]])
    assert all_distances(x, x[:, ::-1].copy()).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in x[:, ::-1]] for p in x]
    assert floor_means(np.array([[-7, 7]]), np.array([2]), np.array([[0, 0]])).tolist() == [[-4, 3]]
