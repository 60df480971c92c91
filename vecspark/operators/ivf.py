"""Inverted-list index: centroids and postings as tables.

``<name>_centroids(list, c)``, ``<name>_postings(part, list, id, v, ...)`` and
the one-row ``<name>_meta``. The index is data: it is written once and every
search reads the written tables. Centroids too many to broadcast lie below
coarse cells: ``<name>_cells(list, c)`` and ``<name>_centroids(cell, list, c)``.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecspark.functions import kernels
from vecspark.operators import bitcells, celltree, knn
from vecspark.sources import tables

#: partition folders of the postings table
MAX_PARTS = 1024


@dataclass(frozen=True)
class IvfIndex:
    name: str
    metric: str
    dim: int
    lists: int
    max_norm: float
    coarse: int = 0

    @property
    def parts(self) -> int:
        return min(self.lists, MAX_PARTS)

    def table(self, kind: str) -> str:
        return f"{self.name}_{kind}"

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table("postings"))

    def centroids(self, spark: SparkSession):
        """``(numbers, matrix)`` of what is broadcast: the centroids, or the coarse cells above them."""
        return read_centroids(spark, self.table("cells" if self.coarse else "centroids"))


def read_centroids(spark: SparkSession, table: str):
    rows = spark.table(table).select("list", "c").toArrow().sort_by("list")
    return rows.column("list").to_numpy(), kernels.as_matrix(rows.column("c"))


def cell_dim(metric: str, dim: int) -> int:
    return {"ip": dim + 1, "hamming": dim * 64, "jaccard": dim * 64}.get(metric, dim)


def coarse_for(lists: int, metric: str, dim: int, centroid_bytes: int) -> int:
    """Coarse cells needed for so many lists; 0 if the centroids themselves can be broadcast."""
    if lists < 1:
        raise ValueError(f"lists must be at least 1, not {lists}")
    width = cell_dim(metric, dim) * 8
    if lists * width <= centroid_bytes:
        return 0
    coarse = celltree.coarse_cells(lists)
    if coarse * width > knn.BROADCAST_BYTES:
        raise ValueError(f"{coarse} coarse cells for {lists} lists exceed {knn.BROADCAST_BYTES} bytes; ask for fewer lists")
    return coarse


def largest_norm(base: DataFrame) -> float:
    squared = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return math.sqrt(base.agg(F.max(squared)).first()[0])


def train_centroids(
    base: DataFrame, lists: int, metric: str, max_norm: float, seed: int, max_iter: int, fraction: float = 1.0
) -> np.ndarray:
    """Centroids from all rows, or from a seeded sample if ``fraction`` is below 1.

    Those of bit vectors are packed words. Copies are counted into one weighted point, and there are no more centroids
    than distinct points: the trainer needs its starting points to differ.
    """
    if not 0 < fraction <= 1:
        raise ValueError(f"train_fraction must be above 0 and at most 1, not {fraction}")
    chosen = base.select("v")
    if fraction < 1:
        drawn = chosen.sample(fraction, seed=seed)
        chosen = chosen if drawn.isEmpty() else drawn
    if metric in kernels.BIT_METRICS:
        return bitcells.train(chosen, lists, metric, seed, max_iter)
    points = (
        chosen.mapInArrow(kernels.to_cell_space(metric, max_norm), "point array<double>")
        .groupBy("point").agg(F.count("*").cast("double").alias("weight"))
        .select(array_to_vector("point").alias("features"), "weight")
        .persist()
    )
    try:
        k = min(lists, points.count())
        if k == 1:
            return np.zeros((1, points.first()["features"].size))
        trainer = KMeans(k=k, seed=seed, maxIter=max_iter, initMode="random", weightCol="weight")
        return np.array(trainer.fit(points).clusterCenters())
    finally:
        points.unpersist()


def centroid_rows(spark: SparkSession, centroids) -> DataFrame:
    """``(list, c)`` of ``(numbers, matrix)``."""
    element = "bigint" if centroids[1].dtype.kind == "i" else "double"
    return spark.createDataFrame([(int(i), c.tolist()) for i, c in zip(*centroids)], f"list int, c array<{element}>")


def with_cells(
    df: DataFrame, vec_col: str, centroids, n: int, metric: str, max_norm: float = 0.0, query: bool = False
) -> DataFrame:
    """Append ``cells``, the numbers of the ``n`` nearest centroids of each row."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    body = kernels.nearest_cells(
        shared, min(n, len(centroids[0])), metric, df.columns.index(vec_col), max_norm, query
    )
    return df.mapInArrow(body, f"{names}, cells array<int>")


def _payload(base: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rest = [c for c in base.columns if c not in (id_col, vec_col)]
    return base.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), *rest
    )


def _listed(base: DataFrame, index: IvfIndex) -> DataFrame:
    """Rows ``(id, v, ...)`` with the number of their list."""
    spark, centroids = base.sparkSession, index.centroids(base.sparkSession)
    if not index.coarse:
        return with_cells(base, "v", centroids, 1, index.metric, index.max_norm).withColumn("list", F.col("cells")[0])
    points = celltree.located(base, centroids, celltree.HOPS, index.metric, index.max_norm)
    fine = spark.table(index.table("centroids"))
    nearest = celltree.nearest_lists(points, fine, 1, cell_dim(index.metric, index.dim))
    return base.join(nearest.select(F.col("qid").alias("id"), F.col("id").cast("int").alias("list")), "id")


def _post(base: DataFrame, index: IvfIndex) -> DataFrame:
    """Rows with their list. Rebalancing splits a list that holds too many rows for one task."""
    rest = [c for c in base.columns if c not in ("id", "v")]
    return (
        _listed(base, index)
        .select("list", "id", "v", *rest, (F.col("list") % index.parts).cast("int").alias("part"))
        .hint("rebalance", F.col("list"))
        .sortWithinPartitions("part", "list")
    )


def ivf_build(
    base: DataFrame,
    name: str,
    lists: int = 100,
    metric: str = "l2",
    *,
    seed: int = 42,
    id_col: str = "id",
    vec_col: str = "v",
    max_iter: int = 10,
    train_fraction: float = 1.0,
    centroid_bytes: int = knn.BROADCAST_BYTES,
    location: str | None = None,
) -> IvfIndex:
    """Cluster the base into at most ``lists`` cells and write the index tables.

    Centroids are fitted on all rows, by distributed passes; ``train_fraction``
    below 1 fits them on a sample. Beyond ``centroid_bytes`` they are fitted in two levels, on at most
    256 rows a list, and a row goes to the nearest of the lists below its three nearest coarse cells.
    """
    kernels.check_metric(metric)
    spark = base.sparkSession
    size = knn.base_stats(base, vec_col)
    base = _payload(base, id_col, vec_col)
    if not size.rows:
        raise ValueError("cannot build an index on an empty base")
    lists = min(lists, size.rows)
    coarse = coarse_for(lists, metric, size.dim, centroid_bytes)
    max_norm = 0.0
    if metric == "ip":
        max_norm = largest_norm(base)

    def save_centroids(found: np.ndarray, kind: str) -> None:
        cells = centroid_rows(spark, (np.arange(len(found)), found))
        tables.save(cells, f"{name}_{kind}", "errorifexists", location=location)

    if coarse:
        fraction = min(train_fraction, celltree.sample_fraction(size.rows, lists))
        top = train_centroids(base, coarse, metric, max_norm, seed, max_iter, fraction)
        if metric in kernels.BIT_METRICS:
            top = kernels.cell_space(metric, top)
        save_centroids(top, "cells")
        chosen = base.select("id", "v")
        if fraction < 1:
            chosen = chosen.sample(fraction, seed=seed)
        fine = celltree.train(chosen, lists, (np.arange(len(top), dtype=np.int32), top), metric, max_norm, seed, max_iter)
        tables.save(fine, f"{name}_centroids", "errorifexists", location=location)
        index = IvfIndex(name, metric, size.dim, fine.count(), max_norm, len(top))
    else:
        found = train_centroids(base, lists, metric, max_norm, seed, max_iter, train_fraction)
        save_centroids(found, "centroids")
        index = IvfIndex(name, metric, size.dim, len(found), max_norm)

    tables.save(_post(base, index), index.table("postings"), "errorifexists", ["part"], location)
    meta = spark.createDataFrame(
        [("ivf", *asdict(index).values())],
        "kind string, name string, metric string, dim int, lists int, max_norm double, coarse int",
    )
    tables.save(meta, index.table("meta"), "errorifexists", location=location)
    return index


def ivf_open(spark: SparkSession, name: str) -> IvfIndex:
    row = spark.table(f"{name}_meta").first()
    if row["kind"] != "ivf":
        raise ValueError(f"{name} is not an inverted-list index")
    return IvfIndex(name, row["metric"], row["dim"], row["lists"], row["max_norm"], row.asDict().get("coarse") or 0)


def ivf_append(index: IvfIndex, new_rows: DataFrame, *, id_col: str = "id", vec_col: str = "v") -> IvfIndex:
    """Add rows to the lists of their nearest existing centroids."""
    spark = new_rows.sparkSession
    rows = _payload(new_rows, id_col, vec_col)
    posted = _post(rows, index)
    columns = index.postings(spark).columns
    missing = [c for c in columns if c not in posted.columns]
    if missing:
        raise ValueError(f"new rows lack column(s) {', '.join(missing)}")
    tables.save(posted.select(*columns), index.table("postings"), "append", ["part"])
    return index


def ivf_search(
    index: IvfIndex,
    queries: DataFrame,
    k: int,
    probes: int = 1,
    predicate: Column | str | None = None,
    metric: str | None = None,
    *,
    broadcast_bytes: int | None = None,
    chunk_bytes: int | None = None,
) -> DataFrame:
    """``(qid, rank, id, distance)`` from the ``probes`` nearest lists of each query.

    ``probes`` at or above the number of lists scans everything, so the answer
    is then exact. ``predicate`` filters postings before ranking.
    """
    if metric is not None and metric != index.metric:
        raise ValueError(f"index {index.name} serves {index.metric}, not {metric}")
    if probes < 1 or k < 1:
        raise ValueError("k and probes must be at least 1")
    spark = queries.sparkSession
    queries = knn.query_columns(queries)
    size = knn.vector_stats(queries, "qv")
    if not size.rows:
        return knn._empty_answers(spark)
    if size.dim != index.dim:
        raise ValueError(f"vectors differ in dimension: {size.dim} and {index.dim}")
    probes = min(probes, index.lists)
    probed = _probed(queries, index, probes)
    postings = index.postings(spark)
    if predicate is not None:
        postings = postings.where(predicate)
    limit = knn.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    if size.bytes + size.rows * probes * 8 <= limit:
        partial = _scan_lists(index, postings, probed, k)
    else:
        partial = _join_lists(index, postings, probed, k, chunk_bytes or knn.CHUNK_BYTES)
    return knn.merge_topk(partial, k)


def _probed(queries: DataFrame, index: IvfIndex, probes: int) -> DataFrame:
    """``(qid, qv, cells)`` with the lists to look into."""
    spark, centroids = queries.sparkSession, index.centroids(queries.sparkSession)
    if not index.coarse:
        return with_cells(queries, "qv", centroids, probes, index.metric, index.max_norm, query=True)
    rows = queries.select(F.col("qid").alias("id"), F.col("qv").alias("v"))
    hops = celltree.hops_for(probes, index.lists, index.coarse)
    points = celltree.located(rows, centroids, hops, index.metric, index.max_norm, query=True)
    found = celltree.nearest_lists(points, spark.table(index.table("centroids")), probes, cell_dim(index.metric, index.dim))
    cells = found.groupBy("qid").agg(F.collect_list(F.col("id").cast("int")).alias("cells"))
    return queries.join(cells, "qid")


def _scan_lists(index: IvfIndex, postings: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """Broadcast the queries grouped by probed list; read only those lists, without a shuffle."""
    table = probed.toArrow()
    qids = table.column("qid").to_numpy()
    matrix = kernels.as_matrix(table.column("qv")).astype(kernels.exact_type(index.metric))
    probed_lists = table.column("cells").combine_chunks()
    cells, counts = probed_lists.flatten().to_numpy(), np.diff(probed_lists.offsets.to_numpy())
    order = np.argsort(cells, kind="stable")
    lists, starts = np.unique(cells[order], return_index=True)
    members = np.repeat(np.arange(len(qids)), counts)[order]
    shared = postings.sparkSession.sparkContext.broadcast(
        (qids, matrix, lists, np.append(starts, len(members)), members)
    )
    if len(lists) < index.lists:
        parts = sorted({int(n) % index.parts for n in lists})
        postings = postings.where(F.col("part").isin(parts) & F.col("list").isin([int(n) for n in lists]))
    return postings.select("list", "id", "v").mapInArrow(
        kernels.topk_cells(shared, k, index.metric), kernels.RESULT_FIELDS
    )


def _join_lists(index: IvfIndex, postings: DataFrame, probed: DataFrame, k: int, chunk_bytes: int) -> DataFrame:
    room = max(1, chunk_bytes // (index.dim * 8))
    most = max(room, knn.CHUNK_BYTES // (index.dim * 8))
    probes = probed.select("qid", "qv", F.explode("cells").alias("list"))
    return join_lists(postings, probes, room, k, index.metric, few_lists=True, most=most)


def join_lists(
    postings: DataFrame, probes: DataFrame, room: int, k: int, metric: str, few_lists: bool = False, most: int | None = None
) -> DataFrame:
    """Partial top-k of ``(list, id, v)`` against ``(list, qid, qv)``, both shuffled by list.

    A list with more than ``room`` rows on either side is cut into chunks of
    about that size, and each chunk of one side meets each chunk of the other. As each side is copied for every chunk of the other,
    chunks are larger, up to the ``most`` rows that a task can hold, where the copies of one side would outgrow the other.
    """
    most = room if most is None else most
    sizes = (
        postings.groupBy("list").agg(F.count("*").alias("b"))
        .join(probes.groupBy("list").agg(F.count("*").alias("q")), "list")
    )

    def chunks(rows: str, others: str):
        needed, held = F.ceil(F.col(rows) / room), F.ceil(F.col(rows) / most)
        return F.least(needed, F.greatest(held, F.ceil(F.col(rows) / F.col(others))))

    cuts = sizes.select("list", chunks("b", "q").alias("nb"), chunks("q", "b").alias("nq"))
    if few_lists:  # one row per centroid, whose number was checked when built
        cuts = F.broadcast(cuts)
    left = postings.select("list", "id", "v").join(cuts, "list").select(
        "list", "id", "v", F.pmod(F.xxhash64("id", "v"), "nb").alias("b"), knn.replicas(F.col("nq")).alias("q")
    )
    right = probes.select("list", "qid", "qv").join(cuts, "list").select(
        "list", "qid", "qv", F.pmod(F.xxhash64("qid"), "nq").alias("q"), knn.replicas(F.col("nb")).alias("b")
    )
    return knn.cogrouped_topk(left, right, ["list", "b", "q"], k, metric)
