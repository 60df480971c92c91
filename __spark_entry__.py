"""

Vectors are scaled by ``1 + vec_id % 7`` in Spark and in SQL alike: the stored
ones have unit length, so that three of the metrics would rank them the same.
The query set is the whole table.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from vecspark.functions import distance as dist  # noqa: E402
from vecspark.functions.literals import from_vector_literal, to_vector_literal  # noqa: E402
from vecspark.operators import declared, evaluate, graph, ivf, knn  # noqa: E402
from vecspark.plans import sweep as sweeps  # noqa: E402
from vecspark.session import scratch_dir, scratch_path, ship_package, write_step  # noqa: E402
from vecspark.sources import parquet, registry, tables, vecs  # noqa: E402

try:
    from vecspark.llm import queries as training_data
except ModuleNotFoundError as missing:
    if missing.name not in ("vecspark.llm", "vecspark.llm.queries"):
        raise
    training_data = None

SMOKE_DIR = "/root/testdata/sf0.001"
K = 10
DIM = 64
LISTS = 16
PERCENTAGES = "50,90,99,99.9"


# ---------------------------------------------------------------- inputs


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = (1 + F.col("vec_id") % 7).cast("double")
    return _embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda x: x.cast("double") * scale).alias("v"),
        "label",
    )


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("id"), dist.binarize("embedding").alias("v")
    )


def _queries(base: DataFrame) -> DataFrame:
    return base.select(F.col("id").alias("qid"), F.col("v").alias("qv"))


def _rounded(answers: DataFrame) -> DataFrame:
    return answers.select("qid", "rank", "id", F.round("distance", 6).alias("distance"))


def _share_of_ids(spark: SparkSession, sf_dir: str, hundredths: int) -> int:
    return _embeddings(spark, sf_dir).count() * hundredths // 100


# ---------------------------------------------------------------- sources


def _lists_checked(rows: DataFrame, key: str, values: str) -> DataFrame:
    """Key, length, sum and position-weighted sum of a list column."""
    total = F.aggregate(F.col(values), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    placed = F.aggregate(
        F.transform(F.col(values), lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda acc, x: acc + x
    )
    return rows.select(
        key,
        F.size(values).alias("n"),
        F.round(total, 4).alias("total"),
        F.round(placed, 4).alias("placed"),
    )


def _write_records(rows: DataFrame, key: str, values: str, stored: str, files: int = 3) -> list[str]:
    """Write the list column as fixed-record files, one per task, in key order."""
    folder = scratch_path(rows.sparkSession, "records")
    ordered = rows.select(key, values).repartitionByRange(files, key).sortWithinPartitions(key)

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        from vecspark.functions.kernels import as_matrix

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{path}/{part:05d}"
        with system.open_output_stream(name) as out:
            for batch in batches:
                if batch.num_rows:
                    matrix = as_matrix(batch.column(1))
                    record = np.dtype([("dim", "<u4"), ("v", stored, (matrix.shape[1],))])
                    block = np.empty(len(matrix), dtype=record)
                    block["dim"], block["v"] = matrix.shape[1], matrix
                    out.write(block.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{part:05d}"]})

    found = ordered.mapInArrow(write, "part long, path string").orderBy("part").collect()
    return [r["path"] for r in found]


def a1_scan_fvecs(spark, sf_dir):
    files = _write_records(_embeddings(spark, sf_dir), "vec_id", "embedding", "<f4")
    return _lists_checked(vecs.scan_fvecs(spark, files, DIM, split_bytes=20_000), "id", "v")


def _as_bytes(spark, sf_dir):
    return _embeddings(spark, sf_dir).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x) * 255).cast("int")).alias("v")
    )


def a2_scan_bvecs(spark, sf_dir):
    files = _write_records(_as_bytes(spark, sf_dir), "vec_id", "v", "u1")
    return _lists_checked(vecs.scan_bvecs(spark, files, DIM), "id", "v")


def _truth(spark, sf_dir, metric="l2"):
    base = _base(spark, sf_dir)
    return knn.ground_truth(base, _queries(base), K, metric)


def _exploded(truth: DataFrame) -> DataFrame:
    return truth.select("qid", F.posexplode("neighbours").alias("pos", "id")).select(
        "qid", (F.col("pos") + 1).alias("rank"), "id"
    )


def a3_scan_ivecs(spark, sf_dir):
    files = _write_records(_truth(spark, sf_dir), "qid", "neighbours", "<i4", files=1)
    return _exploded(vecs.scan_ivecs(spark, files[0], K))


def a4_scan_query_vecs(spark, sf_dir):
    files = _write_records(_embeddings(spark, sf_dir), "vec_id", "embedding", "<f4", files=1)
    return _lists_checked(vecs.scan_query_vecs(spark, files[0], DIM), "qid", "qv")


def a5_scan_parquet_vectors(spark, sf_dir):
    ship_package(spark)
    return _lists_checked(parquet.scan_parquet_vectors(spark, f"{sf_dir}/embeddings.parquet"), "id", "v")


def a6_scan_parquet_queries(spark, sf_dir):
    ship_package(spark)
    return _lists_checked(
        parquet.scan_parquet_queries(spark, f"{sf_dir}/embeddings.parquet", "double"), "qid", "qv"
    )


def a7_scan_parquet_neighbours(spark, sf_dir):
    path = scratch_path(spark, "neighbours")
    _truth(spark, sf_dir).write.parquet(path)
    return _exploded(parquet.scan_parquet_neighbours(spark, path, 5))


def _declared(spark, sf_dir) -> registry.Dataset:
    rows = _embeddings(spark, sf_dir).count()
    return registry.Dataset(
        location="testdata/", name="embeddings", format="PARQUET", base_type="FLOAT", metric="L2",
        base_files=(("embeddings.parquet", rows),), fields=(("vec_id", "int8"), ("embedding", f"vector({DIM})")),
        vector_field="embedding", dim=DIM, total_count=rows, query_file=("embeddings.parquet", rows),
        truth_file=("neighbors.parquet", rows), gt_topk=K,
    )


def a8_position_id(spark, sf_dir):
    """Position ids over many files, in the order the files are given."""
    files = _write_records(_embeddings(spark, sf_dir), "vec_id", "embedding", "<f4", files=5)
    rows = vecs.scan_fvecs(spark, files, DIM, split_bytes=10_000)
    return rows.select("id", F.round(F.col("v")[0].cast("double"), 6).alias("first_value"))


def a10_describe_dataset(spark, sf_dir):
    return registry.describe_dataset(_embeddings(spark, sf_dir), _declared(spark, sf_dir), "embedding")


def a11_validate_dataset(spark, sf_dir):
    return registry.validate_dataset(_embeddings(spark, sf_dir), _declared(spark, sf_dir), "embedding")


# ---------------------------------------------------------------- tables


def _name(label: str) -> str:
    return f"vs_{label}_{uuid.uuid4().hex[:12]}"


def b1_load_table(spark, sf_dir):
    rows = parquet.scan_parquet_vectors(spark, f"{sf_dir}/embeddings.parquet")
    ship_package(spark)
    table = _name("load")
    tables.save(rows, table, location=scratch_dir(spark))
    return _lists_checked(tables.load_table(rows, table), "id", "v")


def b3_from_vector_literal(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).select("vec_id", to_vector_literal("embedding").alias("text"))
    back = rows.select(F.col("vec_id").alias("id"), from_vector_literal("text", DIM).alias("v"))
    return _lists_checked(back, "id", "v")


def b2_to_vector_literal(spark, sf_dir):
    """Rows whose text does not read back to the very same floats."""
    rows = _embeddings(spark, sf_dir)
    changed = from_vector_literal(to_vector_literal("embedding"), DIM) != F.col("embedding")
    return rows.agg(F.count("*").alias("rows"), F.count_if(changed).alias("changed"))


def b4_export_delimited(spark, sf_dir):
    path = scratch_path(spark, "delimited")
    tables.export_delimited(_embeddings(spark, sf_dir), path, "vec_id", "embedding")
    return _lists_checked(tables.read_delimited(spark, path, DIM), "id", "v")


def _table_life(spark, sf_dir, label):
    rows = parquet.scan_parquet_vectors(spark, f"{sf_dir}/embeddings.parquet")
    table = _name(label)
    tables.create_table(spark, table, rows.schema)
    created = spark.table(table).count()
    loaded = tables.load_table(rows, table).agg(F.count("*").alias("loaded"))
    return table, created, write_step(loaded, label)


def b5_create_table(spark, sf_dir):
    table, created, loaded = _table_life(spark, sf_dir, "create")
    tables.drop_table(spark, table)
    return loaded.select(F.lit(created).cast("long").alias("created"), "loaded")


def b6_truncate_table(spark, sf_dir):
    table, _, loaded = _table_life(spark, sf_dir, "truncate")
    tables.truncate_table(spark, table)
    left = spark.table(table).count()
    tables.drop_table(spark, table)
    return loaded.select("loaded", F.lit(left).cast("long").alias("left_over"))


def b7_drop_table(spark, sf_dir):
    table, _, loaded = _table_life(spark, sf_dir, "drop")
    tables.drop_table(spark, table)
    return loaded.select("loaded", F.lit(spark.catalog.tableExists(table)).alias("still_there"))


# ---------------------------------------------------------------- distances


def _neighbour_pairs(rows: DataFrame) -> DataFrame:
    """Every row with the row of the next id."""
    after = rows.select((F.col("id") - 1).alias("id"), F.col("v").alias("q"))
    return rows.select("id", "v").join(after, "id")


def _pair_query(metric: str):
    def run(spark, sf_dir):
        rows = _bits(spark, sf_dir) if metric in ("hamming", "jaccard") else _base(spark, sf_dir)
        return _neighbour_pairs(rows).select("id", F.round(dist.distance(metric, "v", "q"), 6).alias("distance"))

    return run


def c7_distance_dispatch(spark, sf_dir):
    pairs = _neighbour_pairs(_base(spark, sf_dir))
    found = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.round(dist.pair_distance(m)("v", "q"), 6).alias("distance"))
            for m in ("l1", "l2", "ip", "cosine")
        ]
    )
    return pairs.select("id", F.explode(found).alias("f")).select("id", "f.metric", "f.distance")


def c8_binarize(spark, sf_dir):
    return _bits(spark, sf_dir).select("id", F.col("v")[0].alias("word0"), F.col("v")[1].alias("word1"))


# ---------------------------------------------------------------- exact search


def d1_knn(spark, sf_dir):
    found = knn.knn(_base(spark, sf_dir), [0.1] * DIM, K, "l2")
    return found.select("id", F.round("distance", 6).alias("distance"))


def _knn_query(metric: str):
    def run(spark, sf_dir):
        base = _bits(spark, sf_dir) if metric in ("hamming", "jaccard") else _base(spark, sf_dir)
        return _rounded(knn.knn_join(base, _queries(base), K, metric))

    return run


def d2_knn_join_l2_chunked(spark, sf_dir):
    """The way taken beyond the broadcast limit, forced by a small one."""
    base = _base(spark, sf_dir)
    found = knn.knn_join(base, _queries(base), K, "l2", broadcast_bytes=100_000)
    return _rounded(found)


def d2_knn_join_l2_bounded(spark, sf_dir):
    base = _base(spark, sf_dir)
    return _rounded(knn.knn_join(base, _queries(base), K, "l2", bound_fraction=0.2))


def _filter_query(hundredths: int, metric: str = "cosine"):
    def run(spark, sf_dir):
        base = _base(spark, sf_dir)
        fields = [("", "id", ">=", str(_share_of_ids(spark, sf_dir, hundredths)), "")]
        predicate = registry.filter_predicate(fields)
        return _rounded(knn.knn_join(base, _queries(base), K, metric, predicate))

    return run


def d4_filter_predicate(spark, sf_dir):
    base = _base(spark, sf_dir)
    fields = [("(", "label", "<", "3", " OR "), ("", "label", "=", "7", ")"), (" AND ", "id", ">=", "5", "")]
    return _rounded(knn.knn_join(base, _queries(base), K, "l2", registry.filter_predicate(fields)))


def d5_project_ids(spark, sf_dir):
    base = _base(spark, sf_dir)
    return knn.knn_join(base, _queries(base), K, "l2").select("qid", "id")


def d6_expand_workload(spark, sf_dir):
    return knn.expand_workload(_queries(_base(spark, sf_dir)), loop=3)


# ---------------------------------------------------------------- indexes

_INDEXES: dict = {}


def _once(spark, sf_dir, kind: str, build, metric: str = "l2"):
    """Build an index once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _INDEXES:
        _INDEXES[key] = build(_rows_for(spark, sf_dir, metric), _name(kind), scratch_dir(spark))
    return _INDEXES[key]


def _rows_for(spark, sf_dir, metric: str) -> DataFrame:
    return _bits(spark, sf_dir) if metric in ("hamming", "jaccard") else _base(spark, sf_dir)


def _ivf(spark, sf_dir, metric="l2"):
    return _once(
        spark, sf_dir, f"ivf_{metric}",
        lambda base, name, at: ivf.ivf_build(base, name, LISTS, metric, location=at),
        metric,
    )


def _graph(spark, sf_dir, metric="l2"):
    return _once(
        spark, sf_dir, f"graph_{metric}",
        lambda base, name, at: graph.graph_build(base, name, 16, 64, metric, location=at),
        metric,
    )


def _halves(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    return base.where("label < 5"), base.where("label >= 5")


def e1_ivf_build(spark, sf_dir):
    index = _ivf(spark, sf_dir)
    rows = index.postings(spark)
    return rows.groupBy("id").agg(
        F.count("*").alias("copies"), F.max(F.size("v")).alias("dim"),
        F.min((F.col("list") >= 0) & (F.col("list") < index.lists)).alias("listed"),
    )


def e1_ivf_two_level(spark, sf_dir):
    """Centroids below coarse cells: every row is posted once, nine in ten in the nearest of all lists."""
    base = _base(spark, sf_dir)
    index = ivf.ivf_build(base, _name("two_level"), 64, "l2", centroid_bytes=DIM * 8 * 8, location=scratch_dir(spark))
    centres = spark.table(index.table("centroids")).select(F.col("list").alias("id"), F.col("c").alias("v"))
    nearest = knn.knn_join(centres, _queries(base), 1, "l2").select(F.col("qid").alias("id"), F.col("id").alias("nearest"))
    posted = index.postings(spark).join(nearest, "id")
    return posted.agg(
        F.count("*").alias("posted"), F.count_distinct("id").alias("ids"),
        (F.avg((F.col("list") == F.col("nearest")).cast("int")) >= 0.9).alias("nine_in_ten_nearest"),
    )


def e2_ivf_search_two_level(spark, sf_dir):
    base = _base(spark, sf_dir)
    index = ivf.ivf_build(base, _name("two_level"), 64, "l2", centroid_bytes=DIM * 8 * 8, location=scratch_dir(spark))
    return _rounded(ivf.ivf_search(index, _queries(base), K, index.lists))


def _ivf_query(metric: str, predicate: str | None = None, **limits):
    def run(spark, sf_dir):
        index = _ivf(spark, sf_dir, metric)
        queries = _queries(_rows_for(spark, sf_dir, metric))
        return _rounded(ivf.ivf_search(index, queries, K, index.lists, predicate, metric, **limits))

    return run


def e3_graph_build(spark, sf_dir):
    """Node count, and counts of what must not be."""
    index = _graph(spark, sf_dir)
    nodes, edges = spark.table(index.table("nodes")), spark.table(index.table("edges"))
    degrees = edges.where("not link").groupBy("src").agg(F.count("*").alias("degree"))
    facts = {
        "nodes": nodes.agg(F.count("*").alias("value")),
        "repeated nodes": nodes.agg((F.count("*") - F.count_distinct("id")).alias("value")),
        "self edges": edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("value")),
        "nodes over the degree bound": degrees.agg(F.count_if(F.col("degree") > 2 * index.m).alias("value")),
        "unreached nodes": graph.unreached(index, spark).agg(F.count("*").alias("value")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("fact"), "value") for n, df in facts.items()])


def _graph_query(metric: str, predicate: str | None = None):
    def run(spark, sf_dir):
        base = _base(spark, sf_dir)
        index = _graph(spark, sf_dir, metric)
        found = graph.graph_search(index, _queries(base), K, base.count(), predicate, metric)
        return _rounded(found)

    return run


def e4_graph_search_floor(spark, sf_dir):
    """A narrow beam still finds nine in ten of the true neighbours."""
    base = _base(spark, sf_dir)
    found = graph.graph_search(_graph(spark, sf_dir), _queries(base), K, 50)
    scored = evaluate.recall(found, _truth(spark, sf_dir), K)
    return scored.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reaches_floor"))


def _within_reach(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Answers no farther than the true k-th: of bit vectors many are equally far, and any of these will do."""
    reach = truth.groupBy("qid").agg(F.max("distance").alias("reach"), F.count("*").alias("wanted"))
    near = found.join(reach, "qid").agg(
        F.count_distinct("qid").alias("queries"), F.count_if(F.col("distance") <= F.col("reach")).alias("near")
    )
    return near.crossJoin(reach.agg(F.sum("wanted").alias("wanted"))).select(
        "queries", (F.col("near") >= 0.95 * F.col("wanted")).alias("reaches_floor")
    )


def _graph_bits(metric: str):
    """Cells of packed words, small enough to be many; a narrow beam meets 95 in 100."""

    def run(spark, sf_dir):
        base = _bits(spark, sf_dir)
        index = graph.graph_build(base, _name(f"graph_{metric}"), 16, 64, metric, cell_rows=100, location=scratch_dir(spark))
        found = graph.graph_search(index, _queries(base), K, 100)
        return _within_reach(found, knn.knn_join(base, _queries(base), K, metric))

    return run


def e2_ivf_search_probes(spark, sf_dir):
    """Half of the lists probed find nine in ten of the true neighbours, by broadcast and by shuffle alike."""
    base, truth = _base(spark, sf_dir), _truth(spark, sf_dir)
    index, queries = _ivf(spark, sf_dir), _queries(base)
    ways = [({}, "scanned"), ({"broadcast_bytes": 0, "chunk_bytes": 50_000}, "joined")]
    scored = []
    for limits, way in ways:
        found = ivf.ivf_search(index, queries, K, LISTS // 2, **limits)
        scored.append(evaluate.recall(found, truth, K).select(F.lit(way).alias("way"), "recall"))
    return reduce(DataFrame.unionByName, scored).groupBy("way").agg(
        F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reaches_floor")
    )


def e3_graph_descent(spark, sf_dir):
    """Over small cells the neighbour-of-neighbour rounds make up for the borders."""
    base = _base(spark, sf_dir)
    index = graph.graph_build(base, _name("descent"), 16, 64, "l2", cell_rows=50, location=scratch_dir(spark))
    scored = evaluate.recall(graph.graph_search(index, _queries(base), K, 50), _truth(spark, sf_dir), K)
    return scored.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.95).alias("reaches_floor"))


def e5_ivf_append(spark, sf_dir):
    base = _base(spark, sf_dir)
    first, later = _halves(base)
    index = ivf.ivf_build(first, _name("ivf_append"), LISTS, "l2", location=scratch_dir(spark))
    ivf.ivf_append(index, later)
    return _rounded(ivf.ivf_search(index, _queries(base), K, index.lists))


def e5_index_before_load(spark, sf_dir):
    """Declared on nothing, trained by the first load, grown by the second."""
    base, name = _base(spark, sf_dir), _name("declared")
    declared.declare_index(spark, name, "ivf", "l2", location=scratch_dir(spark), lists=LISTS)
    for rows in _halves(base):
        index = declared.load_index(rows, name)
    return _rounded(ivf.ivf_search(index, _queries(base), K, index.lists))


def e7_graph_search_rare(spark, sf_dir):
    """One row in fifty passes: a narrow beam goes on until it has met k of them, or all."""
    base = _base(spark, sf_dir)
    found = graph.graph_search(_graph(spark, sf_dir), _queries(base), K, 20, "id % 50 = 7")
    per_query = found.groupBy("qid").agg(F.count("*").alias("answers"), F.count_if(F.expr("id % 50 <> 7")).alias("not_passing"))
    return per_query.select("qid", "answers", "not_passing")


def e6_graph_append(spark, sf_dir):
    base = _base(spark, sf_dir)
    first, later = _halves(base)
    index = graph.graph_build(first, _name("graph_append"), 16, 64, "l2", location=scratch_dir(spark))
    graph.graph_append(index, later)
    return _rounded(graph.graph_search(index, _queries(base), K, base.count()))


def e8_drop_index(spark, sf_dir):
    base = _base(spark, sf_dir)
    index = ivf.ivf_build(base, _name("ivf_drop"), 4, "l2", location=scratch_dir(spark))
    before = write_step(index.postings(spark).agg(F.count("*").alias("postings")), "before")
    folder = tables.table_folder(spark, index.table("postings"))
    held = tables.count_files(spark, folder) > 0
    tables.drop_index(spark, index.name)
    tables.drop_index(spark, index.name)
    return before.select(
        "postings",
        F.lit(spark.catalog.tableExists(index.table("postings"))).alias("still_there"),
        F.lit(held).alias("had_files"),
        F.lit(tables.count_files(spark, folder)).cast("long").alias("files_left"),
    )


# ---------------------------------------------------------------- evaluation


def _l1_answers(spark, sf_dir):
    base = _base(spark, sf_dir)
    return knn.knn_join(base, _queries(base), K, "l1")


def _recalls(spark, sf_dir):
    return evaluate.recall(_l1_answers(spark, sf_dir), _truth(spark, sf_dir), K)


def f1_recall(spark, sf_dir):
    return _recalls(spark, sf_dir)


def f1_recall_5_at_8(spark, sf_dir):
    return evaluate.recall(_l1_answers(spark, sf_dir), _truth(spark, sf_dir), K, k1=5, k2=8)


def f2_nearest_rank(spark, sf_dir):
    return evaluate.nearest_rank(_events(spark, sf_dir), "value", PERCENTAGES, ["event_type"])


def f2_nearest_rank_ranges(spark, sf_dir):
    """The way taken for large inputs, forced by a small limit."""
    return evaluate.nearest_rank(_events(spark, sf_dir), "value", PERCENTAGES, ["event_type"], one_range_rows=0)


def f3_percentile_labels(spark, sf_dir):
    return evaluate.nearest_rank(_events(spark, sf_dir), "value", ["0", "1.50", "99.9", "100"])


def f4_best_worst(spark, sf_dir):
    return evaluate.extremes(_events(spark, sf_dir), "value", ["event_type"], descending=True).drop("average")


def f5_average(spark, sf_dir):
    found = evaluate.extremes(_events(spark, sf_dir), "value", ["event_type"])
    return found.select("event_type", F.round("average", 6).alias("average"))


def _rounded_summary(found: DataFrame) -> DataFrame:
    return found.withColumn("value", F.round("value", 6))


def f6_latency_summary(spark, sf_dir):
    log = _events(spark, sf_dir).select("event_type", F.col("value").alias("latency"))
    return _rounded_summary(evaluate.latency_summary(log, PERCENTAGES, ["event_type"]))


def f7_recall_summary(spark, sf_dir):
    return _rounded_summary(evaluate.recall_summary(_recalls(spark, sf_dir), PERCENTAGES))


def f8_qps(spark, sf_dir):
    log = _events(spark, sf_dir).select("event_type", F.col("ts").alias("start"), F.col("ts").alias("end"))
    return evaluate.qps(log, ["event_type"]).withColumn("qps", F.round("qps", 9))


def f9_ground_truth(spark, sf_dir):
    return _exploded(_truth(spark, sf_dir, "cosine"))


def f10_sweep(spark, sf_dir):
    """Every query is scored at every setting; with all lists probed recall is 1, and it never falls."""
    index = _ivf(spark, sf_dir)
    queries = _queries(_base(spark, sf_dir))
    settings = [2, 8, index.lists]
    recalls = write_step(sweeps.sweep(index, queries, _truth(spark, sf_dir), settings, K), "sweep")
    per_query = recalls.groupBy("qid").agg(
        F.count("*").alias("settings"),
        F.max_by("recall", "setting").alias("recall_all_lists"),
        F.array_sort(F.collect_list(F.struct("setting", "correct"))).alias("c"),
    )
    rising = (F.col("c")[0]["correct"] <= F.col("c")[1]["correct"]) & (
        F.col("c")[1]["correct"] <= F.col("c")[2]["correct"]
    )
    return per_query.select("qid", "settings", "recall_all_lists", rising.alias("rising"))


def f10_sweep_builds(spark, sf_dir):
    """Two builds of lists and one graph, each at two settings; the widest setting of a build finds everything."""
    base = _base(spark, sf_dir)
    builds = [
        sweeps.Build("lists 4", "ivf", {"lists": 4}, (1, 4)),
        sweeps.Build("lists 16", "ivf", {"lists": LISTS}, (4, LISTS)),
        sweeps.Build("graph 8", "graph", {"m": 8, "ef_construction": 32}, (20, base.count())),
    ]
    swept = sweeps.sweep_builds(base, _queries(base), _truth(spark, sf_dir), builds, K, name=_name("swept"), location=scratch_dir(spark))
    wide = F.max_by("average", "setting")
    scored = swept.recalls.groupBy("build", "setting").agg(F.count("*").alias("queries"), F.avg("recall").alias("average"))
    return scored.groupBy("build").agg(
        F.sum("queries").alias("scores"), wide.alias("recall_widest"), (F.min_by("average", "setting") <= wide).alias("rising")
    )


# ---------------------------------------------------------------- contract


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the ten nearest neighbours of every vector."""
    return _knn_query("l2")(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "a1_scan_fvecs": a1_scan_fvecs,
        "a2_scan_bvecs": a2_scan_bvecs,
        "a3_scan_ivecs": a3_scan_ivecs,
        "a4_scan_query_vecs": a4_scan_query_vecs,
        "a5_scan_parquet_vectors": a5_scan_parquet_vectors,
        "a6_scan_parquet_queries": a6_scan_parquet_queries,
        "a7_scan_parquet_neighbours": a7_scan_parquet_neighbours,
        "a8_position_id": a8_position_id,
        "a10_describe_dataset": a10_describe_dataset,
        "a11_validate_dataset": a11_validate_dataset,
        "b1_load_table": b1_load_table,
        "b2_to_vector_literal": b2_to_vector_literal,
        "b3_from_vector_literal": b3_from_vector_literal,
        "b4_export_delimited": b4_export_delimited,
        "b5_create_table": b5_create_table,
        "b6_truncate_table": b6_truncate_table,
        "b7_drop_table": b7_drop_table,
        "c1_l1": _pair_query("l1"),
        "c2_l2": _pair_query("l2"),
        "c3_neg_ip": _pair_query("ip"),
        "c4_cosine_distance": _pair_query("cosine"),
        "c5_hamming": _pair_query("hamming"),
        "c6_jaccard": _pair_query("jaccard"),
        "c7_distance_dispatch": c7_distance_dispatch,
        "c8_binarize": c8_binarize,
        "d1_knn": d1_knn,
        "d2_knn_join_l2": _knn_query("l2"),
        "d2_knn_join_l1": _knn_query("l1"),
        "d2_knn_join_ip": _knn_query("ip"),
        "d2_knn_join_cosine": _knn_query("cosine"),
        "d2_knn_join_hamming": _knn_query("hamming"),
        "d2_knn_join_jaccard": _knn_query("jaccard"),
        "d2_knn_join_l2_chunked": d2_knn_join_l2_chunked,
        "d2_knn_join_l2_bounded": d2_knn_join_l2_bounded,
        "d3_knn_join_filter1": _filter_query(1),
        "d3_knn_join_filter99": _filter_query(99),
        "d4_filter_predicate": d4_filter_predicate,
        "d5_project_ids": d5_project_ids,
        "d6_expand_workload": d6_expand_workload,
        "e1_ivf_build": e1_ivf_build,
        "e1_ivf_two_level": e1_ivf_two_level,
        "e2_ivf_search_two_level": e2_ivf_search_two_level,
        "e2_ivf_search_all_probes": _ivf_query("l2"),
        "e2_ivf_search_probes": e2_ivf_search_probes,
        "e2_ivf_search_shuffled": _ivf_query("l2", broadcast_bytes=0, chunk_bytes=50_000),
        "e3_graph_build": e3_graph_build,
        "e3_graph_descent": e3_graph_descent,
        "e4_graph_search_full_beam": _graph_query("l2"),
        "e4_graph_search_floor": e4_graph_search_floor,
        "e5_ivf_append": e5_ivf_append,
        "e5_index_before_load": e5_index_before_load,
        "e6_graph_append": e6_graph_append,
        "e7_ivf_search_filtered": _ivf_query("l2", "label < 3"),
        "e7_graph_search_filtered": _graph_query("l2", "label < 3"),
        "e7_graph_search_rare": e7_graph_search_rare,
        "e8_drop_index": e8_drop_index,
        "e9_ivf_search_cosine": _ivf_query("cosine"),
        "e9_ivf_search_ip": _ivf_query("ip"),
        "e9_ivf_search_l1": _ivf_query("l1"),
        "e9_ivf_search_hamming": _ivf_query("hamming"),
        "e9_ivf_search_jaccard": _ivf_query("jaccard"),
        "e9_graph_search_hamming": _graph_bits("hamming"),
        "e9_graph_search_jaccard": _graph_bits("jaccard"),
        "e9_graph_search_cosine": _graph_query("cosine"),
        "f1_recall": f1_recall,
        "f1_recall_5_at_8": f1_recall_5_at_8,
        "f2_nearest_rank": f2_nearest_rank,
        "f2_nearest_rank_ranges": f2_nearest_rank_ranges,
        "f3_percentile_labels": f3_percentile_labels,
        "f4_best_worst": f4_best_worst,
        "f5_average": f5_average,
        "f6_latency_summary": f6_latency_summary,
        "f7_recall_summary": f7_recall_summary,
        "f8_qps": f8_qps,
        "f9_ground_truth": f9_ground_truth,
        "f10_sweep": f10_sweep,
        "f10_sweep_builds": f10_sweep_builds,
    } | (training_data.queries() if training_data else {})


# ---------------------------------------------------------------- SQL

_BASE = """base AS (
  SELECT vec_id AS id, [x::DOUBLE * (1 + vec_id % 7) FOR x IN embedding] AS v, label FROM embeddings
)"""
_BITS = "bits AS (SELECT vec_id AS id, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding] AS v FROM embeddings)"
_SQL_DISTANCE = {
    "l1": "list_sum([abs({a}[i] - {b}[i]) FOR i IN range(1, 65)])",
    "l2": "list_distance({a}, {b})",
    "ip": "list_negative_inner_product({a}, {b})",
    "cosine": "list_cosine_distance({a}, {b})",
    "hamming": "list_sum([CASE WHEN {a}[i] <> {b}[i] THEN 1 ELSE 0 END FOR i IN range(1, 65)])::DOUBLE",
    "jaccard": "1.0::DOUBLE - list_sum([{a}[i] * {b}[i] FOR i IN range(1, 65)])::DOUBLE"
    " / list_sum([greatest({a}[i], {b}[i]) FOR i IN range(1, 65)])::DOUBLE",
}


def _sql_with(metric: str) -> tuple[str, str, str]:
    kind = ("bits", _BITS) if metric in ("hamming", "jaccard") else ("base", _BASE)
    return kind[0], kind[1], _SQL_DISTANCE[metric]


def _sql_ranked(metric: str, where: str = "true", name: str = "ranked") -> str:
    table, _, formula = _sql_with(metric)
    d = formula.format(a="b.v", b="q.v")
    return f"""{name} AS (
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank, id, distance
  FROM (SELECT q.id AS qid, b.id AS id, {d} AS distance FROM {table} q, {table} b WHERE {where})
  QUALIFY rank <= {K}
)"""


def _sql_knn(metric: str, where: str = "true", columns: str = "qid, rank, id, round(distance, 6) AS distance") -> str:
    return f"WITH {_sql_with(metric)[1]}, {_sql_ranked(metric, where)} SELECT {columns} FROM ranked"


def _sql_pairs(metric: str) -> str:
    table, cte, formula = _sql_with(metric)
    d = formula.format(a="a.v", b="b.v")
    return f"WITH {cte} SELECT a.id AS id, round({d}, 6) AS distance FROM {table} a JOIN {table} b ON b.id = a.id + 1"


def _sql_lists(key: str, values: str, source: str) -> str:
    return (
        f"SELECT {key}, len({values})::INTEGER AS n, round(list_sum([x::DOUBLE FOR x IN {values}]), 4) AS total, "
        f"round(list_sum([{values}[i]::DOUBLE * i FOR i IN range(1, len({values}) + 1)]), 4) AS placed FROM ({source})"
    )


def _sql_percentiles(pairs: list[tuple[str, float]], source: str, by: str, descending: bool = False) -> str:
    group = f"PARTITION BY {by}" if by else ""
    wanted = ", ".join(f"('{label}', {number}::DOUBLE)" for label, number in pairs)
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}label, percentage, x AS value
FROM (SELECT {keys}x, row_number() OVER ({group} ORDER BY x {'DESC' if descending else 'ASC'}) AS r,
             count(*) OVER ({group}) AS n FROM ({source})),
     (VALUES {wanted}) AS w(label, percentage)
WHERE r = least(n, greatest(1, CAST(ceil(n * percentage / 100.0::DOUBLE) AS BIGINT)))"""


def _sql_summary(source: str, by: str, descending: bool = False) -> str:
    pairs = evaluate.parse_percentages(PERCENTAGES)
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    best, worst = ("max", "min") if descending else ("min", "max")
    rows = " UNION ALL ".join(
        f"SELECT {keys}'{name}' AS statistic, {f}(x)::DOUBLE AS value FROM ({source}) {group}"
        for name, f in (("best", best), ("worst", worst), ("average", "avg"))
    )
    ranked = _sql_percentiles(pairs, source, by, descending)
    return (
        f"SELECT {keys}statistic, round(value, 6) AS value FROM ({rows} UNION ALL "
        f"SELECT {keys}'P(' || label || '%)' AS statistic, value::DOUBLE FROM ({ranked}))"
    )


def _sql_recall(k1: int = K, k2: int = K) -> str:
    return f"""WITH {_BASE}, {_sql_ranked('l1', name='answers')}, {_sql_ranked('l2', name='truth')}
SELECT t.qid AS qid, count(a.id) AS correct, count(a.id) / {k1}.0::DOUBLE AS recall
FROM truth t LEFT JOIN answers a ON a.qid = t.qid AND a.id = t.id AND a.rank <= {k2}
WHERE t.rank <= {k1} GROUP BY t.qid"""


def oracle_sql() -> dict[str, str]:
    floats = _sql_lists("id", "v", "SELECT vec_id AS id, embedding AS v FROM embeddings")
    query_floats = _sql_lists("qid", "qv", "SELECT vec_id AS qid, embedding AS qv FROM embeddings")
    exact_l2 = _sql_knn("l2")
    event_values = "SELECT event_type, value AS x FROM events"
    labelled = "b.label < 3"
    percentages = evaluate.parse_percentages(PERCENTAGES)
    word = "CAST(list_sum([CASE WHEN embedding[i + {at}] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END FOR i IN range(1, 33)]) AS BIGINT)"
    rows = "(SELECT count(*) FROM embeddings)"
    reaching = "SELECT count(*) AS queries, true AS reaches_floor FROM embeddings"
    return {
        "a1_scan_fvecs": floats,
        "a2_scan_bvecs": _sql_lists(
            "id", "v",
            "SELECT vec_id AS id, [CAST(floor(abs(x) * 255::FLOAT) AS INTEGER) FOR x IN embedding] AS v FROM embeddings",
        ),
        "a3_scan_ivecs": _sql_knn("l2", columns="qid, rank, id"),
        "a4_scan_query_vecs": query_floats,
        "a5_scan_parquet_vectors": floats,
        "a6_scan_parquet_queries": query_floats,
        "a7_scan_parquet_neighbours": _sql_knn("l2", columns="qid, rank, id") + " WHERE rank <= 5",
        "a8_position_id": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, "
        "round(embedding[1]::DOUBLE, 6) AS first_value FROM embeddings",
        "a10_describe_dataset": f"""SELECT * FROM (VALUES
  ('name', 'embeddings', NULL), ('location', 'testdata/', NULL), ('format', 'PARQUET', NULL), ('metric', 'L2', NULL),
  ('dim', '64', (SELECT CAST(max(len(embedding)) AS VARCHAR) FROM embeddings)),
  ('base_files', 'embeddings.parquet:' || {rows}, NULL),
  ('total_count', CAST({rows} AS VARCHAR), CAST({rows} AS VARCHAR)),
  ('fields', 'vec_id:int8,embedding:vector(64)', NULL), ('vector_field', 'embedding', NULL),
  ('query_file', 'embeddings.parquet:' || {rows}, NULL), ('truth_file', 'neighbors.parquet:' || {rows}, NULL),
  ('gt_topk', '10', NULL)) AS t(property, declared, actual)""",
        "a11_validate_dataset": f"""SELECT "check", expected::BIGINT AS expected, actual::BIGINT AS actual, expected = actual AS ok
FROM (VALUES ('declared rows of files', {rows}, {rows}), ('rows', {rows}, {rows}),
  ('null vectors', 0, (SELECT count(*) FROM embeddings WHERE embedding IS NULL)),
  ('smallest dimension', 64, (SELECT min(len(embedding)) FROM embeddings)),
  ('largest dimension', 64, (SELECT max(len(embedding)) FROM embeddings))) AS t("check", expected, actual)""",
        "b1_load_table": f"SELECT * FROM ({floats}) UNION ALL SELECT * FROM ({floats})",
        "b2_to_vector_literal": "SELECT count(*) AS rows, 0::BIGINT AS changed FROM embeddings",
        "b3_from_vector_literal": floats,
        "b4_export_delimited": floats,
        "b5_create_table": "SELECT 0::BIGINT AS created, count(*) AS loaded FROM embeddings",
        "b6_truncate_table": "SELECT count(*) AS loaded, 0::BIGINT AS left_over FROM embeddings",
        "b7_drop_table": "SELECT count(*) AS loaded, false AS still_there FROM embeddings",
        "c1_l1": _sql_pairs("l1"),
        "c2_l2": _sql_pairs("l2"),
        "c3_neg_ip": _sql_pairs("ip"),
        "c4_cosine_distance": _sql_pairs("cosine"),
        "c5_hamming": _sql_pairs("hamming"),
        "c6_jaccard": _sql_pairs("jaccard"),
        "c7_distance_dispatch": f"WITH {_BASE} " + " UNION ALL ".join(
            f"SELECT a.id AS id, '{m}' AS metric, round({_SQL_DISTANCE[m].format(a='a.v', b='b.v')}, 6) AS distance "
            "FROM base a JOIN base b ON b.id = a.id + 1"
            for m in ("l1", "l2", "ip", "cosine")
        ),
        "c8_binarize": f"SELECT vec_id AS id, {word.format(at=0)} AS word0, {word.format(at=32)} AS word1 FROM embeddings",
        "d1_knn": f"WITH {_BASE} SELECT id, round(d, 6) AS distance FROM (SELECT id, "
        f"list_distance(v, [0.1::DOUBLE FOR i IN range({DIM})]) AS d FROM base) ORDER BY d, id LIMIT {K}",
        "d2_knn_join_l2": exact_l2,
        "d2_knn_join_l1": _sql_knn("l1"),
        "d2_knn_join_ip": _sql_knn("ip"),
        "d2_knn_join_cosine": _sql_knn("cosine"),
        "d2_knn_join_hamming": _sql_knn("hamming"),
        "d2_knn_join_jaccard": _sql_knn("jaccard"),
        "d2_knn_join_l2_chunked": exact_l2,
        "d2_knn_join_l2_bounded": exact_l2,
        "d3_knn_join_filter1": _sql_knn("cosine", f"b.id >= {rows} * 1 // 100"),
        "d3_knn_join_filter99": _sql_knn("cosine", f"b.id >= {rows} * 99 // 100"),
        "d4_filter_predicate": _sql_knn("l2", "(b.label < 3 OR b.label = 7) AND b.id >= 5"),
        "d5_project_ids": _sql_knn("l2", columns="qid, id"),
        "d6_expand_workload": "SELECT r.round * c.n + p.pos AS seq, r.round AS round, p.qid AS qid "
        "FROM (SELECT vec_id AS qid, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) p, "
        "(SELECT count(*) AS n FROM embeddings) c, (SELECT unnest(range(3)) AS round) r",
        "e1_ivf_build": "SELECT vec_id AS id, 1::BIGINT AS copies, len(embedding)::INTEGER AS dim, true AS listed FROM embeddings",
        "e1_ivf_two_level": "SELECT count(*) AS posted, count(DISTINCT vec_id) AS ids, true AS nine_in_ten_nearest FROM embeddings",
        "e2_ivf_search_two_level": exact_l2,
        "e2_ivf_search_all_probes": exact_l2,
        "e2_ivf_search_probes": "SELECT way, count(*) AS queries, true AS reaches_floor FROM embeddings, "
        "(VALUES ('scanned'), ('joined')) AS w(way) GROUP BY way",
        "e2_ivf_search_shuffled": exact_l2,
        "e3_graph_build": "SELECT 'nodes' AS fact, count(*) AS value FROM embeddings UNION ALL "
        "SELECT 'repeated nodes', count(*) - count(DISTINCT vec_id) FROM embeddings UNION ALL "
        "SELECT f, 0::BIGINT FROM (VALUES ('self edges'), ('nodes over the degree bound'), ('unreached nodes')) AS t(f)",
        "e3_graph_descent": "SELECT count(*) AS queries, true AS reaches_floor FROM embeddings",
        "e4_graph_search_full_beam": exact_l2,
        "e4_graph_search_floor": "SELECT count(*) AS queries, true AS reaches_floor FROM embeddings",
        "e5_ivf_append": exact_l2,
        "e5_index_before_load": exact_l2,
        "e6_graph_append": exact_l2,
        "e7_ivf_search_filtered": _sql_knn("l2", labelled),
        "e7_graph_search_filtered": _sql_knn("l2", labelled),
        "e7_graph_search_rare": "SELECT vec_id AS qid, least(10, (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 7))::BIGINT AS answers, "
        "0::BIGINT AS not_passing FROM embeddings",
        "e8_drop_index": "SELECT count(*) AS postings, false AS still_there, true AS had_files, 0::BIGINT AS files_left FROM embeddings",
        "e9_ivf_search_cosine": _sql_knn("cosine"),
        "e9_ivf_search_ip": _sql_knn("ip"),
        "e9_ivf_search_l1": _sql_knn("l1"),
        "e9_ivf_search_hamming": _sql_knn("hamming"),
        "e9_ivf_search_jaccard": _sql_knn("jaccard"),
        "e9_graph_search_hamming": reaching,
        "e9_graph_search_jaccard": reaching,
        "e9_graph_search_cosine": _sql_knn("cosine"),
        "f1_recall": _sql_recall(),
        "f1_recall_5_at_8": _sql_recall(5, 8),
        "f2_nearest_rank": _sql_percentiles(percentages, event_values, "event_type"),
        "f2_nearest_rank_ranges": _sql_percentiles(percentages, event_values, "event_type"),
        "f3_percentile_labels": _sql_percentiles(
            [("0", 0.0), ("1.50", 1.5), ("99.9", 99.9), ("100", 100.0)], event_values, ""
        ),
        "f4_best_worst": "SELECT event_type, max(value) AS best, min(value) AS worst FROM events GROUP BY event_type",
        "f5_average": "SELECT event_type, round(avg(value), 6) AS average FROM events GROUP BY event_type",
        "f6_latency_summary": _sql_summary(event_values, "event_type"),
        "f7_recall_summary": _sql_summary(f"SELECT recall AS x FROM ({_sql_recall()})", "", descending=True),
        "f8_qps": "SELECT event_type, executed, wall_us, round(1e6::DOUBLE * executed / wall_us, 9) AS qps FROM "
        "(SELECT event_type, count(*) AS executed, epoch_us(max(ts)) - epoch_us(min(ts)) AS wall_us "
        "FROM events GROUP BY event_type)",
        "f9_ground_truth": _sql_knn("cosine", columns="qid, rank, id"),
        "f10_sweep": "SELECT vec_id AS qid, 3::BIGINT AS settings, 1.0::DOUBLE AS recall_all_lists, true AS rising FROM embeddings",
        "f10_sweep_builds": "SELECT build, 2 * count(*) AS scores, 1.0::DOUBLE AS recall_widest, true AS rising FROM embeddings, "
        "(VALUES ('lists 4'), ('lists 16'), ('graph 8')) AS b(build) GROUP BY build",
    } | (training_data.oracle_sql() if training_data else {})
