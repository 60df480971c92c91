"""The five phases over a declared dataset, each usable alone or in a chain.

``setup`` makes the table, ``load`` fills it, ``index`` builds an index on it,
``query`` searches and scores, ``teardown`` cleans up.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecspark.operators import evaluate, graph, ivf, knn
from vecspark.plans.sweep import search
from vecspark.sources import registry, tables
from vecspark.sources.registry import METRIC_OF_NAME, Dataset

ARRAY_OF_TYPE = {"BYTE": "smallint", "INT": "int", "FLOAT": "float", "DOUBLE": "double"}


class QueryResult(NamedTuple):
    answers: DataFrame
    recalls: DataFrame
    summary: DataFrame


def index_name(dataset: Dataset, name: str | None = None) -> str:
    return name or f"{dataset.name}_{dataset.vector_field}_idx"


def setup(spark: SparkSession, dataset: Dataset, table: str | None = None) -> str:
    """Create the empty table; fails if it exists."""
    table = table or dataset.name
    key = dataset.fields[0][0]
    tables.create_table(
        spark, table, f"{key} bigint, {dataset.vector_field} array<{ARRAY_OF_TYPE[dataset.base_type]}>"
    )
    return table


def load(
    spark: SparkSession, dataset: Dataset, table: str | None = None, index=None, partitions: int | None = None
) -> DataFrame:
    """Load the base files, after checking them; rows also go into an ``index`` that exists already."""
    rows = registry.read_base(spark, dataset)
    wrong = [r for r in registry.validate_dataset(rows, dataset, files=True).collect() if not r["ok"]]
    if wrong:
        raise ValueError(
            f"{dataset.name}: " + "; ".join(f"{r['check']}: {r['actual']}, not {r['expected']}" for r in wrong)
        )
    rows = rows.select(F.col("id").alias(dataset.fields[0][0]), F.col("v").alias(dataset.vector_field))
    loaded = tables.load_table(rows, table or dataset.name, partitions=partitions)
    if index is not None:
        append = ivf.ivf_append if isinstance(index, ivf.IvfIndex) else graph.graph_append
        append(index, rows, id_col=dataset.fields[0][0], vec_col=dataset.vector_field)
    return loaded


def index(
    spark: SparkSession, dataset: Dataset, index_type: str, table: str | None = None, name: str | None = None, **options
):
    """Build an ``ivfflat`` (``lists=``) or ``hnsw`` (``m=``, ``ef_construction=``) style index."""
    build = {"ivfflat": ivf.ivf_build, "hnsw": graph.graph_build}.get(index_type.lower())
    if build is None:
        raise ValueError(f"index type must be hnsw or ivfflat, not {index_type}")
    return build(
        spark.table(table or dataset.name),
        index_name(dataset, name),
        metric=METRIC_OF_NAME[dataset.metric],
        id_col=dataset.fields[0][0],
        vec_col=dataset.vector_field,
        **options,
    )


def query(
    spark: SparkSession,
    dataset: Dataset,
    index=None,
    setting: int | None = None,
    k1: int | None = None,
    k2: int | None = None,
    percentages=(),
    table: str | None = None,
) -> QueryResult:
    """Search the whole query set, exactly when there is no ``index``, and score it."""
    k1, k2 = evaluate.check_topk(dataset.gt_topk, k2, k1)
    queries = registry.read_queries(spark, dataset)
    predicate = registry.filter_predicate(dataset.filter_fields)
    if index is None:
        answers = knn.knn_join(
            spark.table(table or dataset.name), queries, k2, METRIC_OF_NAME[dataset.metric], predicate,
            id_col=dataset.fields[0][0], vec_col=dataset.vector_field,
        )
    else:
        answers = search(index, queries, k2, setting, predicate)
    recalls = evaluate.recall(answers, registry.read_truth(spark, dataset, k1), dataset.gt_topk, k1, k2)
    return QueryResult(answers, recalls, evaluate.recall_summary(recalls, percentages))


def teardown(
    spark: SparkSession,
    dataset: Dataset,
    table: str | None = None,
    name: str | None = None,
    truncate: bool = False,
    drop_index: bool = False,
) -> None:
    """Truncate and/or drop the index and keep the table; with neither, drop the table."""
    table = table or dataset.name
    if drop_index:
        tables.drop_index(spark, index_name(dataset, name))
    if truncate:
        tables.truncate_table(spark, table)
    if not (truncate or drop_index):
        tables.drop_table(spark, table)
