"""Centroid clustering of integer vectors with a table of distances to fixed pivots.

The distances of every vector to the pivots are measured once and stored beside it. In each round
the pivots' distances to the centroids are known too, and by the triangle inequality the largest
difference of the two is a lower bound of a vector's distance to a centroid. Only centroids whose
bound does not exceed the distance to the most promising one are measured, in exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecspark.functions.kernels import as_list_array, as_matrix
from vecspark.llm.support import write_step

DIM = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
#: Integer components stay below this, so that sums of squares over DIM components fit 64 bits.
LARGEST = 1 << 26
#: Rows measured at once.
BLOCK = 4096
#: Relative rounding allowed for in a bound; double precision needs about 1e-15.
SLACK = 1e-9


def whole_vectors(table: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v array<long>)``: components times ``scale``, rounded down, of vectors with ``dim`` finite components."""
    x = F.col("embedding")
    fits = x.isNotNull() & (F.size(x) == dim)
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    wide = F.exists(x, lambda c: F.abs(c.cast("double") * scale) >= LARGEST)
    refused = F.raise_error(F.lit(f"a component times {scale} is not below {LARGEST}")).cast("array<bigint>")
    return table.where(fits).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.when(wide, refused).otherwise(scaled).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hash of their id; equal ids by components, null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = vectors.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters)
    return np.array([r["v"] for r in chosen.collect()], np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of matching rows."""
    return np.square(a - b).sum(axis=-1)


def to_pivots(pivots: np.ndarray):
    """``mapInArrow`` body: append to ``(vec_id, v)`` the exact squared distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = as_matrix(batch.column(1))
            if len(v):
                table = np.stack([squared(v, p) for p in pivots], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, as_list_array(table)], names=["vec_id", "v", "pivots"])

    return run


def assign(v: np.ndarray, pivoted: np.ndarray, centroids: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: the smaller number), its squared distance, and how many distances were measured.

    ``pivoted`` holds distances of the vectors to the pivots, ``between`` those of the centroids.
    """
    bound = np.zeros((len(v), len(centroids)))
    for p in range(pivoted.shape[1]):
        np.maximum(bound, np.abs(pivoted[:, p, None] - between[None, :, p]), out=bound)
    reach = SLACK * (pivoted.max(axis=1)[:, None] + between.max(axis=1)[None, :])
    bound -= reach  # more than the rounding of the roots and their difference
    guess = bound.argmin(axis=1)
    nearest = squared(v, centroids[guess])
    limit = np.sqrt(nearest.astype(np.float64)) * (1 + SLACK)
    alive = bound <= limit[:, None]
    alive[np.arange(len(v)), guess] = False
    best = guess.astype(np.int64)
    for c in np.flatnonzero(alive.any(axis=0)):
        rows = np.flatnonzero(alive[:, c])
        d = squared(v[rows], centroids[c])
        better = (d < nearest[rows]) | ((d == nearest[rows]) & (c < best[rows]))
        nearest[rows[better]], best[rows[better]] = d[better], c
    return best, nearest, len(v) + int(alive.sum())


def _blocks(batches: Iterator[pa.RecordBatch], shared) -> Iterator[tuple]:
    centroids, between = shared.value
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            v = as_matrix(part.column(1))
            yield part, v, *assign(v, np.sqrt(as_matrix(part.column(2)).astype(np.float64)), centroids, between)


def _sums(shared):
    """``mapInArrow`` body: per task the count, the component sums and the measured distances of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = shared.value[0].shape
        counts, sums, measured = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0
        for _, v, cluster, _, work in _blocks(batches, shared):
            counts += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, v)
            measured += work
        held = np.flatnonzero(counts)
        if len(held):
            work = np.where(np.arange(len(held)) == 0, measured, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.astype(np.int32)), pa.array(counts[held]), as_list_array(sums[held]), pa.array(work)],
                names=["cluster", "n", "sums", "measured"],
            )

    return run


def _assigned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, distance, _ in _blocks(batches, shared):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    return run


def _shared(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray):
    between = np.sqrt(np.stack([squared(centroids, p) for p in pivots], axis=1).astype(np.float64))
    return table.sparkSession.sparkContext.broadcast((centroids, between))


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, int]:
    """Centroids after one round, and how many distances it measured. Tasks add up; k rows of sums reach the driver."""
    parts = table.mapInArrow(_sums(_shared(table, centroids, pivots)), "cluster int, n long, sums array<long>, measured long")
    adding = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(centroids.shape[1])]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("measured").alias("measured"), *adding).collect()
    found = centroids.copy()
    for row in rows:
        found[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
    return found, sum(row["measured"] for row in rows)


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` per kept vector.

    Kept are vectors with exactly ``dim`` components of which none is null, NaN or infinite. The
    first centroids, the kept vectors with the smallest hashes, serve as the fixed pivots as well.
    Rows that repeat an id or a vector are vectors of their own; a null id hashes last. With fewer
    kept vectors than clusters there are as many centroids as vectors; without any the result is
    empty. A component of 2**20 or more (times 64: 2**26) is an error, as distances would not fit a
    long. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings, dim, scale)
    pivots = first_centroids(vectors, clusters, seed)
    if not len(pivots):
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    table = write_step(vectors.mapInArrow(to_pivots(pivots), "vec_id long, v array<long>, pivots array<long>"), "pivot-table")
    centroids = pivots
    for _ in range(rounds):
        centroids, _ = moved(table, centroids, pivots)
    found = write_step(table.mapInArrow(_assigned(_shared(table, centroids, pivots)), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    total = sum(sums.values())
    about = spark.createDataFrame(
        [(c, sums.get(c, 0), total, centroid_digest(x)) for c, x in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
