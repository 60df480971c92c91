import hashlib
import math

import numpy as np
import pytest

from vecspark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance double"


def table(spark, rows, partitions=3):
    """With extra columns whose names clash with results."""
    plain = [(i, None if v is None else [None if x is None else float(x) for x in v], "x", 0.5) for i, v in rows]
    return spark.createDataFrame(plain, SCHEMA).repartition(partitions)


def brute(rows, clusters=16, rounds=3, seed=1, dim=64):
    kept = []
    for i, v in rows:
        if v is None or len(v) != dim or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    hashed = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centers = [v for _, _, v in hashed[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centers)):
            members = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if members:
                centers[n] = [sum(x) // len(members) for x in zip(*members)]
    found = assign()
    sums = {}
    for d, n in found:
        sums[n] = sums.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, n, d, sums[n], sum(sums.values()), digest[n]) for (i, _), (d, n) in zip(kept, found)), key=repr)


def listed(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


def clustered(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, dim))
    return [(i, (centers[rng.integers(9)] + 0.4 * rng.normal(size=dim)).tolist()) for i in range(n)]


def edge(dim):
    nan = [float("nan")] + [0.0] * (dim - 1)
    return [
        (1000, None), (1001, []), (1002, [0.5] * (dim - 1)), (1003, [0.5] * (dim + 1)), (1004, nan), (1005, [math.inf] * dim),
        (1006, [None] + [0.0] * (dim - 1)), (None, [0.25] * dim), (None, [0.25] * dim), (1007, [0.0] * dim), (1007, [0.0] * dim),
        (1007, [1.0] * dim), (1008, [-0.001] * dim),
    ]


def test_clusters_equal_brute_force(spark):
    rows = clustered(1, 300) + edge(64)
    found = centroids.cluster(table(spark, rows))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert listed(found) == brute(rows)


@pytest.mark.parametrize("rows", [0, 1, 7])
def test_fewer_vectors_than_clusters(spark, rows):
    data = clustered(2, rows)
    assert listed(centroids.cluster(table(spark, data, 1))) == brute(data)


def test_ties_and_copies(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3), 0.0, 0.0]) for i in range(90)]
    for seed in range(4):
        assert listed(centroids.cluster(table(spark, grid), clusters=8, rounds=2, seed=seed, dim=4)) == brute(grid, 8, 2, seed, 4)


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="is not below"):
        centroids.cluster(table(spark, [(1, [2.0**21] * 64), (2, [0.0] * 64)])).collect()


def test_bounds_spare_distances_and_lose_nothing():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 32)) * 4
    v = np.floor(64 * (centers[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 32)))).astype(np.int64)
    centers = np.floor(64 * centers).astype(np.int64)
    pivots = v[:12]
    roots = lambda a: np.sqrt(np.stack([centroids.squared(a, p) for p in pivots], axis=1).astype(float))
    best, nearest, measured = centroids.assign(v, roots(v), centers, roots(centers))
    whole = np.stack([centroids.squared(v, c) for c in centers], axis=1)
    assert (best == whole.argmin(axis=1)).all() and (nearest == whole.min(axis=1)).all()
    assert measured < 0.25 * whole.size
