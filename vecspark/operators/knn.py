"""Exact k-nearest-neighbour search over DataFrames.

``base`` holds ``(id, v, ...)`` rows and ``queries`` holds ``(qid, qv)`` rows.
Base vectors never leave their scan: the query set is broadcast, a large one
block by block, and each block is one pass over the base. Within a block, queries
near each other form cells; a base vector that the triangle inequality keeps
out of reach of a cell is not measured against its queries.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from vecspark.functions import kernels
from vecspark.session import scratch_path

#: largest query set (or centroid set) sent to every executor
BROADCAST_BYTES = 64 << 20
#: size of one chunk of base or query vectors when both sides are shuffled
CHUNK_BYTES = 32 << 20
#: answers that one task may hold: queries of a block times k
TASK_ANSWERS = 4_000_000
#: answers per task from which a bound taken from a sample pays for its scan
BOUND_ANSWERS = 1_000_000
BOUND_FRACTION = 0.01
#: passes over the base from which blocks of queries share one, as far as a task can hold them
FEW_PASSES = 8


class VectorStats(NamedTuple):
    rows: int
    dim: int

    @property
    def bytes(self) -> int:
        return self.rows * self.dim * 8


def vector_stats(df: DataFrame, vec_col: str) -> VectorStats:
    """Row count and dimension in one aggregate; mixed dimensions are an error."""
    row = df.where(F.col(vec_col).isNotNull()).agg(
        F.count("*").alias("n"), F.min(F.size(vec_col)).alias("lo"), F.max(F.size(vec_col)).alias("hi")
    ).first()
    if row["lo"] != row["hi"]:
        raise ValueError(f"vectors differ in dimension: {row['lo']} and {row['hi']}")
    return VectorStats(row["n"], row["hi"] or 0)


def base_stats(base: DataFrame, vec_col: str) -> VectorStats:
    """Row count and dimension without reading the vectors.

    The count comes from file footers unless a filter stands before it, and
    includes rows without a vector; the dimension is that of the first vector.
    The scan itself refuses vectors of another dimension.
    """
    first = base.where(F.col(vec_col).isNotNull()).select(F.size(vec_col)).first()
    return VectorStats(base.count(), first[0]) if first else VectorStats(0, 0)


def base_columns(base: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return base.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")
    )


def query_columns(queries: DataFrame, qid_col: str = "qid", qvec_col: str = "qv") -> DataFrame:
    return queries.where(F.col(qvec_col).isNotNull()).select(
        F.col(qid_col).cast("long").alias("qid"), F.col(qvec_col).alias("qv")
    )


def collect_queries(queries: DataFrame, metric: str):
    """Query ids and matrix; call only after checking the size."""
    table = queries.select("qid", "qv").toArrow()
    return table.column("qid").to_numpy(), kernels.as_matrix(table.column("qv")).astype(kernels.exact_type(metric))


def merge_topk(partial: DataFrame, k: int) -> DataFrame:
    """k best of the partial answers, ranked by (distance, id)."""
    order = Window.partitionBy("qid").orderBy("distance", "id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("qid", "rank", "id", "distance")
    )


def _check(k: int, metric: str) -> None:
    kernels.check_metric(metric)
    if k < 1:
        raise ValueError(f"k must be at least 1, not {k}")


def _empty_answers(spark) -> DataFrame:
    return spark.createDataFrame([], "qid long, rank int, id long, distance double")


def knn_join(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    predicate: Column | str | None = None,
    *,
    id_col: str = "id",
    vec_col: str = "v",
    bound_fraction: float | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(qid, rank, id, distance)``: the k nearest base rows of every query.

    ``predicate`` restricts the base before ranking, so fewer than k rows may
    come back. ``bound_fraction`` is the share of the base scanned first for an
    upper bound of each k-th distance, which keeps all but about
    ``k / bound_fraction`` rows per query out of the shuffle; by default it is
    used only when each task could emit a million answers. A query set beyond
    ``broadcast_bytes``, or with more than TASK_ANSWERS answers, is sent in
    blocks and searched when this is called; else the result is lazy.
    """
    _check(k, metric)
    if predicate is not None:
        base = base.where(predicate)
    queries = query_columns(queries)
    size = vector_stats(queries, "qv")
    if not size.rows:
        return _empty_answers(base.sparkSession)
    rows = base_columns(base, id_col, vec_col)
    blocks = query_blocks(size, k, broadcast_bytes)
    if blocks == 1:
        return merge_topk(_scan(rows, collect_queries(queries, metric), k, metric, bound_fraction), k)
    passes = min(blocks, max(FEW_PASSES, query_blocks(size, k, BROADCAST_BYTES)))
    return _passes(rows, queries, passes, k, metric, bound_fraction, broadcast_bytes if passes < blocks else None)


def query_blocks(size: VectorStats, k: int, broadcast_bytes: int) -> int:
    """Blocks of queries small enough to broadcast and, times k, for one task to hold their answers."""
    return min(size.rows, max(math.ceil(size.bytes / max(1, broadcast_bytes)), math.ceil(size.rows * k / TASK_ANSWERS)))


def _passes(
    rows: DataFrame, queries: DataFrame, passes: int, k: int, metric: str, bound_fraction: float | None, broadcast_bytes: int | None
) -> DataFrame:
    """Passes over the base, each for a share of the queries; the answers of a pass are written before the next begins.

    The driver holds one share at a time, at most BROADCAST_BYTES, and sends it in blocks of ``broadcast_bytes`` if that is given. The
    base is read again by each pass but never shuffled, and a pass measures so many queries against each vector read that
    reading is not what it costs.
    """
    spark = rows.sparkSession
    asked, answers = scratch_path(spark, "asked"), scratch_path(spark, "answers")
    queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(passes)).cast("int")).write.partitionBy("block").parquet(asked)
    written = spark.read.parquet(asked)
    for block in sorted(r["block"] for r in written.select("block").distinct().collect()):
        held = collect_queries(written.where(F.col("block") == block), metric)
        blocks = math.ceil(held[1].nbytes / max(1, broadcast_bytes)) if broadcast_bytes is not None else 1
        found = _scan(rows, held, k, metric, bound_fraction, blocks)
        merge_topk(found, k).write.parquet(f"{answers}/block={block}")
    return spark.read.schema("qid long, rank int, id long, distance double").parquet(f"{answers}/*")


def _scan(base: DataFrame, queries, k: int, metric: str, bound_fraction: float | None, blocks: int = 1) -> DataFrame:
    sc = base.sparkSession.sparkContext
    qids, matrix = queries
    if bound_fraction is None:
        bound_fraction = BOUND_FRACTION if len(qids) * k >= BOUND_ANSWERS else 0.0
    bound = _sample_bound(base, queries, k, metric, bound_fraction, blocks) if bound_fraction else None
    if blocks == 1:
        cells = kernels.query_cells(metric, matrix)
        return base.mapInArrow(kernels.topk_scan(sc.broadcast((qids, matrix, bound, cells)), k, metric), kernels.RESULT_FIELDS)
    cuts = np.array_split(np.arange(len(qids)), min(blocks, len(qids)))
    shared = [sc.broadcast((qids[c], matrix[c], None if bound is None else bound[c])) for c in cuts]
    return base.mapInArrow(kernels.topk_scan_blocks(shared, k, metric), kernels.RESULT_FIELDS)


def _sample_bound(base, queries, k, metric, fraction, blocks=1) -> np.ndarray:
    """Distance of the k-th best in a sample: no true k-th best lies beyond it."""
    qids, _ = queries
    sample = base.sample(fraction, seed=17)
    found = (
        merge_topk(_scan(sample, queries, k, metric, 0.0, blocks), k)
        .where((F.col("rank") == k) & ~F.isnan("distance"))
        .select("qid", "distance")
        .toArrow()
    )
    bound = np.full(len(qids), np.inf)
    order = np.argsort(qids)
    at = order[np.searchsorted(qids[order], found.column("qid").to_numpy())]
    distance = found.column("distance").to_numpy()
    bound[at] = np.where(np.isnan(distance), np.inf, distance)
    return bound


def replicas(count: Column) -> Column:
    """One row for each of 0 .. count - 1, as LONG."""
    return F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1))


def cogrouped_topk(left: DataFrame, right: DataFrame, keys: list[str], k: int, metric: str) -> DataFrame:
    """Partial top-k of base chunks against query chunks that share ``keys``.

    The caller makes the keys fine enough that one chunk of either side is
    small; answers, never pairs, come out.
    """
    return (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(kernels.topk_pair(k, metric), kernels.RESULT_FIELDS)
    )


def knn(
    base: DataFrame,
    qv: list[float],
    k: int,
    metric: str = "l2",
    predicate: Column | str | None = None,
    *,
    id_col: str = "id",
    vec_col: str = "v",
) -> DataFrame:
    """``(id, distance)``: the k nearest base rows of one vector, nearest first."""
    _check(k, metric)
    if predicate is not None:
        base = base.where(predicate)
    matrix = np.asarray([qv], dtype=kernels.exact_type(metric))
    partial = _scan(base_columns(base, id_col, vec_col), (np.zeros(1, np.int64), matrix), k, metric, 0.0)
    return partial.select("id", "distance").orderBy("distance", "id").limit(k)


def ground_truth(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    predicate: Column | str | None = None,
    **options,
) -> DataFrame:
    """``(qid, neighbours)``: exact answers as one list per query, nearest first."""
    return as_neighbours(knn_join(base, queries, k, metric, predicate, **options))


def as_neighbours(answers: DataFrame) -> DataFrame:
    """Ranked answers as one list of at most k ids per query."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return answers.groupBy("qid").agg(F.transform(ranked, lambda r: r["id"]).alias("neighbours"))


def expand_workload(queries: DataFrame, loop: int = 1) -> DataFrame:
    """``(seq, round, qid)``: the query set repeated ``loop`` times, in qid order.

    The position of a query is its rank by qid, counted in two steps so that no
    single task sorts the whole set.
    """
    if loop < 1:
        raise ValueError(f"loop must be at least 1, not {loop}")
    placed, count = with_position(queries.select(F.col("qid").cast("long").alias("qid")), "qid")
    return placed.select(
        replicas(F.lit(loop)).alias("round"), "qid", "pos"
    ).select((F.col("round") * F.lit(count) + F.col("pos")).alias("seq"), "round", "qid")


def with_position(df: DataFrame, key: str, buckets: int = 256) -> tuple[DataFrame, int]:
    """Add ``pos``, the 0-based rank by the numeric ``key``, and return the row count.

    Rows are cut into value ranges at approximate quantiles; a running count of
    the ranges plus the rank inside a range gives the global rank.
    """
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(
        F.count("*").alias("n"), F.percentile_approx(key, shares, 10_000).alias("cuts")
    ).first()
    cuts = sorted({float(c) for c in row["cuts"] or []})
    bucketed = with_range(df, key, cuts, "bucket")
    offsets = (
        bucketed.groupBy("bucket").count()
        .withColumn("offset", F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("bucket", F.coalesce("offset", F.lit(0)).alias("offset"))
    )
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(key)) - 1
    placed = (
        bucketed.withColumn("within", within)
        .join(F.broadcast(offsets), "bucket")
        .withColumn("pos", (F.col("within") + F.col("offset")).cast("long"))
        .drop("bucket", "within", "offset")
    )
    return placed, row["n"]


def with_range(df: DataFrame, key: str, cuts: list, name: str = "range") -> DataFrame:
    """Add the number of cuts not above ``key``: rows of one number form one value range.

    Cuts that are NaN or infinite are left out; a NaN key comes into a range after all others.
    """
    cuts = sorted({float(c) for c in cuts if math.isfinite(c)})
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    splits = [-math.inf, *cuts, math.inf]
    bucketizer = Bucketizer(splits=splits, inputCol=key, outputCol=name, handleInvalid="keep")
    return bucketizer.transform(df)
