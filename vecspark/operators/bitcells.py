"""Cells of bit vectors: centroids are packed words too, rows are dealt by counting bits, and a
centroid takes the bits that most of its rows have.

Tasks return one row of counts per cell they met; the counts are summed on the JVM with partial
aggregation, so a cell that holds a third of all rows is no larger a group than any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from vecspark.functions import kernels


def _counted(shared, metric: str):
    """``mapInArrow`` body: ``(v, weight)`` to ``(list, weight, ones)``, the set bits of a task's rows by cell."""

    def run(batches):
        centroids = shared.value
        lists, words = centroids.shape
        ones, weights = np.zeros((lists, words * 64)), np.zeros(lists)
        step = max(1, kernels.SCORE_ELEMENTS // max(lists, words * 64))
        for batch in batches:
            if not batch.num_rows:
                continue
            points, counts = kernels.as_matrix(batch.column(0)), batch.column(1).to_numpy()
            for lo in range(0, len(points), step):
                block, weight = points[lo:lo + step], counts[lo:lo + step]
                own = kernels.word_distances(metric, block, centroids).argmin(axis=1)
                order = np.argsort(own, kind="stable")
                met, starts = np.unique(own[order], return_index=True)
                set_bits = kernels.unpack_bits(block[order], 64).astype(np.float64) * weight[order, None]
                ones[met] += np.add.reduceat(set_bits, starts, axis=0)
                weights[met] += np.add.reduceat(weight[order], starts)
        met = np.flatnonzero(weights)
        for n in met:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), pa.array([weights[n]]), kernels.as_list_array(ones[n:n + 1])],
                names=["list", "weight", "ones"],
            )

    return run


def _majorities(batches):
    """``(list, weight, ones)`` to ``(list, c)``: bits that more than half of the rows have, as words."""
    for batch in batches:
        if batch.num_rows:
            bits = 2 * kernels.as_matrix(batch.column(2)) > batch.column(1).to_numpy()[:, None]
            words = np.packbits(bits, axis=1, bitorder="little").view("<i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), kernels.as_list_array(words)], names=["list", "c"])


def train(rows: DataFrame, lists: int, metric: str, seed: int, max_iter: int) -> np.ndarray:
    """``[cells, words]`` from rows ``(v)``: at most ``lists`` cells, and no more than distinct vectors.

    Starts from the distinct vectors with the smallest seeded hashes. A round deals every row to its
    nearest centroid (ties: the smaller number); it ends when no centroid changes. A cell without rows
    keeps its centroid, and so does one under Jaccard whose rows agree on no bit.
    A task holds 64 counts per word and cell; the caller bounds their number.
    """
    spark = rows.sparkSession
    points = rows.groupBy("v").agg(F.count("*").cast("double").alias("weight")).persist()
    try:
        first = points.select("v", F.xxhash64(F.lit(seed), "v").alias("h")).orderBy("h", "v").limit(lists)
        centroids = kernels.as_matrix(first.select("v").toArrow().column("v")).astype(np.int64)
        for _ in range(max_iter if len(centroids) > 1 else 0):
            shared = spark.sparkContext.broadcast(centroids)
            counted = points.mapInArrow(_counted(shared, metric), "list int, weight double, ones array<double>")
            summed = counted.groupBy("list").agg(
                F.sum("weight").alias("weight"), Summarizer.sum(array_to_vector("ones")).alias("ones")
            )
            found = (
                summed.select("list", "weight", vector_to_array("ones").alias("ones"))
                .mapInArrow(_majorities, "list int, c array<bigint>").toArrow()
            )
            moved = centroids.copy()
            moved[found.column("list").to_numpy()] = kernels.as_matrix(found.column("c"))
            if metric == "jaccard":
                empty = ~moved.any(axis=1)
                moved[empty] = centroids[empty]
            if np.array_equal(moved, centroids):
                break
            centroids = moved
        return centroids
    finally:
        points.unpersist()
