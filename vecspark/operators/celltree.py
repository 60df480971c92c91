"""Centroids in two levels, for more lists than fit a broadcast.

Coarse cells are few and broadcast. The centroids of the lists lie in a table, each under a coarse
cell. A vector finds its coarse cells in its scan and meets, in a join by cell, only the centroids
below them. Fitting works the same way: rows and centroids meet by cell, tasks return sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vecspark.functions import kernels
from vecspark.operators import knn
from vecspark.session import write_step

#: rows per list that the centroids are fitted on at most, drawn by a seeded sample
TRAIN_PER_LIST = 256
#: coarse cells whose centroids a vector meets, nearest first
HOPS = 3


def coarse_cells(lists: int) -> int:
    return math.ceil(math.sqrt(lists))


def _points(shared, n: int, metric: str, max_norm: float, query: bool):
    """``mapInArrow`` body: ``(id, v)`` to ``(id, point, cells)`` with the ``n`` nearest coarse cells."""

    def run(batches):
        numbers, centroids = shared.value
        half = np.square(centroids).sum(axis=1) / 2
        for batch in batches:
            if not batch.num_rows:
                continue
            points = kernels.cell_space(metric, kernels.as_matrix(batch.column(1)), max_norm, query)
            found = np.empty((len(points), n), np.int32)
            step = max(1, kernels.SCORE_ELEMENTS // len(numbers))
            for lo in range(0, len(points), step):
                scores = half - points[lo:lo + step] @ centroids.T
                found[lo:lo + step] = numbers[np.argsort(scores, axis=1, kind="stable")[:, :n]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), kernels.as_list_array(points), kernels.as_list_array(found)], names=["id", "point", "cells"]
            )

    return run


def located(rows: DataFrame, coarse, n: int, metric: str, max_norm: float, query: bool = False) -> DataFrame:
    """``(id, point, cells)`` of rows ``(id, v)``; ``coarse`` is ``(numbers, matrix)``."""
    shared = rows.sparkSession.sparkContext.broadcast(coarse)
    body = _points(shared, min(n, len(coarse[0])), metric, max_norm, query)
    return rows.select("id", "v").mapInArrow(body, "id long, point array<double>, cells array<int>")


def _sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows ``(point)`` of one chunk of a cell against its centroids ``(list, c)``: counts and sums by list."""
    if not left.num_rows or not right.num_rows:
        return pa.table({"list": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "sums": pa.array([], pa.list_(pa.float64()))})
    points, centres = kernels.as_matrix(left.column("point")), kernels.as_matrix(right.column("c"))
    half, nearest = np.square(centres).sum(axis=1) / 2, np.empty(len(points), np.int64)
    step = max(1, kernels.SCORE_ELEMENTS // len(centres))
    for lo in range(0, len(points), step):
        nearest[lo:lo + step] = (half - points[lo:lo + step] @ centres.T).argmin(axis=1)
    sums = np.zeros_like(centres)
    np.add.at(sums, nearest, points)
    counts = np.bincount(nearest, minlength=len(centres))
    held = np.flatnonzero(counts)
    return pa.table({"list": right.column("list").to_numpy()[held], "n": counts[held], "sums": kernels.as_list_array(sums[held])})


def _mean(table: pa.Table) -> pa.Table:
    """Partial sums of some lists to their means."""
    lists, at = np.unique(table.column("list").to_numpy(), return_inverse=True)
    parts = kernels.as_matrix(table.column("sums"))
    sums, counts = np.zeros((len(lists), parts.shape[1])), np.zeros(len(lists))
    np.add.at(sums, at, parts)
    np.add.at(counts, at, table.column("n").to_numpy())
    return pa.table({"list": lists.astype(np.int32), "mean": kernels.as_list_array(sums / counts[:, None])})


def _chunked(points: DataFrame, sizes: DataFrame, room: int) -> DataFrame:
    chunk = F.pmod(F.xxhash64("point"), F.ceil(F.col("n") / room))
    return points.join(F.broadcast(sizes.select("cell", "n")), "cell").select("cell", chunk.alias("chunk"), "point")


def train(base: DataFrame, lists: int, coarse, metric: str, max_norm: float, seed: int, rounds: int) -> DataFrame:
    """``(cell, list, c)``: at most ``lists`` centroids below the coarse cells, by ``rounds`` of Lloyd's steps.

    ``base`` is ``(id, v)`` to fit on. Each cell gets lists by its share of the distinct points, one at
    least and no more than one task can hold; its first centroids are those of its points with the smallest hashes.
    """
    spark, dim = base.sparkSession, coarse[1].shape[1]
    room = max(1, knn.CHUNK_BYTES // (dim * 8))
    points = located(base, coarse, 1, metric, max_norm).dropDuplicates(["point"])
    points = write_step(points.select(F.col("cells")[0].alias("cell"), "point"), "points")
    counted = points.groupBy("cell").count().orderBy("cell").collect()  # one row per coarse cell
    total, first, quotas = sum(r["count"] for r in counted), 0, []
    for r in counted:
        quota = max(1, min(r["count"], room, lists * r["count"] // total))
        quotas.append((r["cell"], r["count"], quota, first))
        first += quota
    sizes = write_step(spark.createDataFrame(quotas, "cell int, n long, quota int, first int"), "quotas")
    drawn = Window.partitionBy("cell").orderBy(F.xxhash64("point", F.lit(seed)), "point")
    seeds = points.withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= max(q for _, _, q, _ in quotas))
    fine = seeds.join(F.broadcast(sizes), "cell").where("r <= quota")
    fine = write_step(fine.select("cell", (F.col("first") + F.col("r") - 1).cast("int").alias("list"), F.col("point").alias("c")), "fine")
    chunks = write_step(_chunked(points, sizes, room), "chunks")
    copies = sizes.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / room) - 1)).alias("chunk"))
    for _ in range(rounds):
        right = fine.join(F.broadcast(copies), "cell")
        sums = chunks.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInArrow(_sums, "list int, n long, sums array<double>")
        sums = write_step(sums, "sums")
        buckets = max(1, math.ceil(2 * sums.count() / room))
        means = sums.withColumn("bucket", F.pmod(F.xxhash64("list"), F.lit(buckets))).groupBy("bucket").applyInArrow(_mean, "list int, mean array<double>")
        fine = write_step(fine.join(means, "list", "left").select("cell", "list", F.coalesce("mean", "c").alias("c")), "fine")
    return fine


def nearest_lists(points: DataFrame, fine: DataFrame, n: int, dim: int) -> DataFrame:
    """``(qid, rank, id, distance)``: the ``n`` nearest lists (as id) of each ``(id, point, cells)`` among those of its cells."""
    from vecspark.operators.ivf import join_lists

    postings = fine.select(F.col("cell").alias("list"), F.col("list").cast("long").alias("id"), F.col("c").alias("v"))
    probes = points.select(F.explode("cells").alias("list"), F.col("id").alias("qid"), F.col("point").alias("qv"))
    return knn.merge_topk(join_lists(postings, probes, max(1, knn.CHUNK_BYTES // (dim * 8)), n, "l2"), n)


def hops_for(probes: int, lists: int, coarse: int) -> int:
    """Coarse cells to look into so that they hold several times the lists asked for; all of them for all lists."""
    return coarse if probes >= lists else min(coarse, max(HOPS, math.ceil(HOPS * probes * coarse / lists)))


def sample_fraction(rows: int, lists: int) -> float:
    return min(1.0, TRAIN_PER_LIST * lists / rows)
