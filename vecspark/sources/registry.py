"""Declared datasets, their description and their checks."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecspark.sources import parquet, vecs

ELEMENT_OF_TYPE = {"BYTE": "byte", "INT": "int", "FLOAT": "float", "DOUBLE": "double"}
METRIC_OF_NAME = {
    "L1": "l1", "L2": "l2", "IP": "ip", "COSINE": "cosine", "HAMMING": "hamming", "JACCARD": "jaccard",
}


@dataclass(frozen=True)
class Dataset:
    location: str
    name: str
    format: str
    base_type: str
    metric: str
    base_files: tuple[tuple[str, int], ...]
    fields: tuple[tuple[str, str], ...]
    vector_field: str
    dim: int
    total_count: int
    query_file: tuple[str, int]
    truth_file: tuple[str, int]
    gt_topk: int
    filter_fields: tuple[tuple[str, str, str, str, str], ...] = field(default=())

    def __post_init__(self):
        declared = sum(count for _, count in self.base_files)
        if declared != self.total_count:
            raise ValueError(f"{self.name}: files hold {declared} rows, not {self.total_count}")

    def at(self, location: str) -> "Dataset":
        """The same dataset kept in another folder."""
        return replace(self, location=location)

    def path(self, file: str) -> str:
        return os.path.join(self.location, file)


# Dataset declarations.
VECS_LOCATION = "/opt/datasets/vecs/"
PARQUET_LOCATION = "/opt/datasets/parquet/"

# name, file prefix, folder, query file, dimension, base rows, query rows, ground-truth depth
VECS_SETS = [
    ("siftsmall", "siftsmall", "siftsmall", "siftsmall_query.fvecs", 128, 10_000, 100, 100),
    ("sift", "sift", "sift", "sift_query.fvecs", 128, 1_000_000, 10_000, 100),
    ("gist", "gist", "gist", "gist_query.fvecs", 960, 1_000_000, 1_000, 100),
    ("glove", "glove-100", "glove-100", "glove-100_query.fvecs", 100, 1_183_514, 10_000, 100),
    ("crawl", "crawl", "crawl", "crawl_query.fvecs", 300, 1_989_995, 10_000, 100),
    ("deep1B", "deep1B", "deep1B", "deep1B_queries.fvecs", 96, 1_000_000_000, 10_000, 1),
]

# name, metric, element type, dimension, base rows, base files, filtered variants,
# ground-truth depth of: all rows, filter1, filter99
PARQUET_SETS = [
    ("cohere_small_100k", "COSINE", "FLOAT", 768, 100_000, 1, True, (1000, 950, 1000)),
    ("cohere_medium_1m", "COSINE", "FLOAT", 768, 1_000_000, 1, True, (1000, 1000, 1000)),
    ("cohere_large_10m", "COSINE", "FLOAT", 768, 10_000_000, 10, True, (1000, 1000, 1000)),
    ("openai_small_50k", "COSINE", "DOUBLE", 1536, 50_000, 1, True, (1000, 950, 500)),
    ("openai_medium_500k", "COSINE", "DOUBLE", 1536, 500_000, 1, True, (1000, 1000, 1000)),
    ("openai_large_5m", "COSINE", "DOUBLE", 1536, 5_000_000, 10, True, (1000, 1000, 1000)),
    ("laion_large_100m", "L2", "FLOAT", 768, 100_000_000, 100, False, (1000,)),
]
PARQUET_QUERIES = ("test.parquet", 1000)

# variant suffix, base file prefix, ground-truth file, hundredths of the rows below the filter
VARIANTS = [
    ("", "train", "neighbors.parquet", 0),
    ("_filter1", "shuffle_train", "neighbors_head_1p.parquet", 1),
    ("_filter99", "shuffle_train", "neighbors_tail_1p.parquet", 99),
]


def _declare() -> dict[str, Dataset]:
    found = []
    for name, prefix, folder, query, dim, rows, query_rows, depth in VECS_SETS:
        found.append(
            Dataset(
                location=VECS_LOCATION + folder + "/",
                name=name, format="FVECS", base_type="FLOAT", metric="L2",
                base_files=((f"{prefix}_base.fvecs", rows),),
                fields=(("id", "int"), ("embedding", f"vector({dim})")),
                vector_field="embedding", dim=dim, total_count=rows,
                query_file=(query, query_rows),
                truth_file=(f"{prefix}_groundtruth.ivecs", query_rows), gt_topk=depth,
            )
        )
    for name, metric, kind, dim, rows, files, filtered, depths in PARQUET_SETS:
        for (suffix, prefix, truth, below), depth in zip(VARIANTS if filtered else VARIANTS[:1], depths):
            found.append(
                Dataset(
                    location=PARQUET_LOCATION + name + "/",
                    name=name + suffix, format="PARQUET", base_type=kind, metric=metric,
                    base_files=tuple((_part_name(prefix, i, files), rows // files) for i in range(files)),
                    fields=(("id", "int8"), ("emb", f"vector({dim})")),
                    vector_field="emb", dim=dim, total_count=rows,
                    query_file=PARQUET_QUERIES, truth_file=(truth, PARQUET_QUERIES[1]), gt_topk=depth,
                    filter_fields=(("", "id", ">=", str(rows * below // 100), ""),) if below else (),
                )
            )
    return {d.name: d for d in found}


def _part_name(prefix: str, part: int, parts: int) -> str:
    return f"{prefix}.parquet" if parts == 1 else f"{prefix}-{part:02d}-of-{parts}.parquet"


DATASETS = _declare()

_FILE = "struct<file:string,rows:bigint>"
REGISTRY_SCHEMA = f"""
    location string, name string, format string, base_type string, metric string,
    base_files array<{_FILE}>, fields array<struct<name:string,type:string>>,
    vector_field string, dim int, total_count bigint, query_file {_FILE}, truth_file {_FILE}, gt_topk int,
    filter_fields array<struct<prologue:string,field:string,op:string,value:string,epilogue:string>>
"""


def get_dataset(name: str) -> Dataset | None:
    """The declaration of that name, or None."""
    return DATASETS.get(name)


def dataset_registry(spark: SparkSession, datasets=None) -> DataFrame:
    """One row per declared dataset."""
    rows = [
        (
            d.location, d.name, d.format, d.base_type, d.metric, list(d.base_files), list(d.fields), d.vector_field,
            d.dim, d.total_count, d.query_file, d.truth_file, d.gt_topk, list(d.filter_fields),
        )
        for d in (DATASETS.values() if datasets is None else datasets)
    ]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def filter_predicate(filter_fields):
    """One predicate from (prologue, field, op, value, epilogue) tuples, or None.

    The texts are joined as they are: a second filter brings its own ``AND`` in
    its prologue or the epilogue before it.
    """
    text = "".join("".join(parts) for parts in filter_fields)
    return F.expr(text) if text else None


def read_base(spark: SparkSession, dataset: Dataset) -> DataFrame:
    paths = [dataset.path(f) for f, _ in dataset.base_files]
    if dataset.format == "PARQUET":
        return parquet.scan_parquet_vectors(spark, paths, ELEMENT_OF_TYPE[dataset.base_type])
    scan = vecs.scan_bvecs if dataset.format == "BVECS" else vecs.scan_fvecs
    return scan(spark, paths, dataset.dim)


def read_queries(spark: SparkSession, dataset: Dataset) -> DataFrame:
    path = dataset.path(dataset.query_file[0])
    if dataset.format == "PARQUET":
        return parquet.scan_parquet_queries(spark, path, ELEMENT_OF_TYPE[dataset.base_type])
    return vecs.scan_query_vecs(spark, path, dataset.dim, "byte" if dataset.format == "BVECS" else "float")


def read_truth(spark: SparkSession, dataset: Dataset, k1: int | None = None) -> DataFrame:
    path = dataset.path(dataset.truth_file[0])
    if dataset.format == "PARQUET":
        return parquet.scan_parquet_neighbours(spark, path, k1)
    return vecs.scan_ivecs(spark, path, dataset.gt_topk, k1)


def describe_dataset(df: DataFrame, dataset: Dataset, vec_col: str = "v") -> DataFrame:
    """``(property, declared, actual)``: the declaration next to what ``df`` holds."""
    spark = df.sparkSession
    declared = dataset_registry(spark, [dataset])
    show = lambda files: F.array_join(
        F.transform(files, lambda f: F.concat_ws(":", f["file"], f["rows"].cast("string"))), ","
    )
    texts = {
        "name": F.col("name"),
        "location": F.col("location"),
        "format": F.col("format"),
        "metric": F.col("metric"),
        "dim": F.col("dim").cast("string"),
        "base_files": show(F.col("base_files")),
        "total_count": F.col("total_count").cast("string"),
        "fields": F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["type"])), ","),
        "vector_field": F.col("vector_field"),
        "query_file": show(F.array("query_file")),
        "truth_file": show(F.array("truth_file")),
        "gt_topk": F.col("gt_topk").cast("string"),
    }
    rows = declared.select(
        F.explode(F.array(*[F.struct(F.lit(p).alias("property"), t.alias("declared")) for p, t in texts.items()]))
        .alias("p")
    ).select("p.property", "p.declared")
    counted = df.agg(F.count("*").alias("rows"), F.max(F.size(vec_col)).alias("dim")).select(
        F.explode(
            F.array(
                F.struct(F.lit("total_count").alias("property"), F.col("rows").cast("string").alias("actual")),
                F.struct(F.lit("dim").alias("property"), F.col("dim").cast("string").alias("actual")),
            )
        ).alias("p")
    ).select("p.property", "p.actual")
    return rows.join(F.broadcast(counted), "property", "left").select("property", "declared", "actual")


def validate_dataset(df: DataFrame, dataset: Dataset, vec_col: str = "v", files: bool = False) -> DataFrame:
    """``(check, expected, actual, ok)``: declared against actual rows, dimensions and file sizes."""
    spark = df.sparkSession
    size = F.size(vec_col)
    bare = F.col(vec_col).isNull()
    facts = df.agg(
        F.count("*").alias("rows"),
        F.count_if(bare).alias("nulls"),
        F.coalesce(F.min(F.when(~bare, size)), F.lit(dataset.dim)).cast("long").alias("low"),
        F.coalesce(F.max(F.when(~bare, size)), F.lit(dataset.dim)).cast("long").alias("high"),
    )
    checks = [
        ("declared rows of files", sum(n for _, n in dataset.base_files), F.lit(dataset.total_count).cast("long")),
        ("rows", dataset.total_count, F.col("rows")),
        ("null vectors", 0, F.col("nulls")),
        ("smallest dimension", dataset.dim, F.col("low")),
        ("largest dimension", dataset.dim, F.col("high")),
    ]
    rows = facts.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("check"),
                        F.lit(expected).cast("long").alias("expected"),
                        actual.alias("actual"),
                    )
                    for name, expected, actual in checks
                ]
            )
        ).alias("c")
    ).select("c.*")
    if files and dataset.format != "PARQUET":
        width = vecs.record_bytes(dataset.dim, ELEMENT_OF_TYPE[dataset.base_type])
        lengths = vecs.file_lengths(spark, [dataset.path(f) for f, _ in dataset.base_files])
        sized = [
            (f"bytes of {name}", count * width, length)
            for (name, count), (_, length) in zip(dataset.base_files, lengths)
        ]
        rows = rows.unionByName(spark.createDataFrame(sized, "check string, expected long, actual long"))
    return rows.withColumn("ok", F.col("expected") == F.col("actual"))
