"""Parquet vector sets: column 0 is the id, column 1 the list, taken by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _two_columns(spark: SparkSession, paths, names: tuple[str, str], list_type: str) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.parquet(*paths)
    if len(rows.columns) < 2:
        raise ValueError(f"expected an id and a list column, found {rows.columns}")
    key, values = rows.columns[:2]
    return rows.select(
        F.col(f"`{key}`").cast("long").alias(names[0]),
        F.col(f"`{values}`").cast(f"array<{list_type}>").alias(names[1]),
    )


def scan_parquet_vectors(spark: SparkSession, paths, dtype: str = "float") -> DataFrame:
    """``(id, v)`` from one or more base files."""
    return _two_columns(spark, paths, ("id", "v"), dtype)


def scan_parquet_queries(spark: SparkSession, path, dtype: str = "float") -> DataFrame:
    """``(qid, qv)``; a query is numbered by its id column."""
    return _two_columns(spark, path, ("qid", "qv"), dtype)


def scan_parquet_neighbours(spark: SparkSession, path, k1: int | None = None) -> DataFrame:
    """``(qid, neighbours)``, cut to the first ``k1``."""
    rows = _two_columns(spark, path, ("qid", "neighbours"), "bigint")
    return rows.withColumn("neighbours", F.slice("neighbours", 1, k1)) if k1 else rows
