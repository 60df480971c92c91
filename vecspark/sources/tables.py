"""Tables: create, load, read back, truncate, drop; delimited text in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from vecspark.functions.literals import from_vector_literal, to_vector_literal


def save(
    df: DataFrame,
    table: str,
    mode: str = "append",
    partition_by: list[str] | None = None,
    location: str | None = None,
) -> None:
    """Write a Parquet table; ``location`` puts its files in a folder of that name."""
    writer = df.write.format("parquet").mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if location:
        writer = writer.option("path", f"{location.rstrip('/')}/{table}")
    writer.saveAsTable(table)


def create_table(spark: SparkSession, table: str, schema: StructType | str) -> None:
    """Typed empty table; an existing one is an error."""
    spark.createDataFrame([], schema).limit(0).write.format("parquet").mode("errorifexists").saveAsTable(table)


def load_table(df: DataFrame, table: str, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Bulk load. ``partitions`` spreads a source of few large row groups over more files."""
    if partitions:
        df = df.repartition(partitions)
    if df.sparkSession.catalog.tableExists(table) and mode == "append":
        df.select(*df.sparkSession.table(table).columns).write.mode("append").insertInto(table)
    else:
        save(df, table, mode)
    return df.sparkSession.table(table)


def truncate_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"TRUNCATE TABLE {table}")


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def table_folder(spark: SparkSession, table: str) -> str | None:
    """The folder that holds the files of ``table``; None if there is no such table."""
    if not spark.catalog.tableExists(table):
        return None
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").select("data_type").collect()
    return rows[0][0] if rows else None


def drop_partitions(spark: SparkSession, table: str, unwanted) -> None:
    """Drop the partitions of ``table`` for whose name (``a=1/b=x``) ``unwanted`` is true, with their files.

    Names are read as they are listed, so the values must need no escape.
    """
    folder = table_folder(spark, table)
    for row in spark.sql(f"SHOW PARTITIONS {table}").collect():
        if unwanted(row["partition"]):
            keys = ", ".join(f"{k}='{v}'" for k, v in (pair.split("=") for pair in row["partition"].split("/")))
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({keys})")
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{row['partition']}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def count_files(spark: SparkSession, folder: str) -> int:
    """Files below ``folder``, read through Hadoop; 0 if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getContentSummary(path).getFileCount() if store.exists(path) else 0


#: tables an index may have, as ``<name>_<kind>``
INDEX_KINDS = ("meta", "centroids", "postings", "nodes", "edges", "entries", "copies", "cells", "live", "definition")


def index_bytes(spark: SparkSession, name: str) -> int:
    """Bytes that the tables of an index take in storage; 0 if there is none."""
    total = 0
    for folder in filter(None, (table_folder(spark, f"{name}_{kind}") for kind in INDEX_KINDS)):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def drop_index(spark: SparkSession, name: str, keep: tuple[str, ...] = ()) -> None:
    """Drop every table of an index with its files, but for the kinds to ``keep``; an absent index is no error.

    Dropping a table written with ``location`` leaves its folder, which ``save`` names after the
    table; only a folder of that name is deleted.
    """
    for kind in (k for k in INDEX_KINDS if k not in keep):
        table = f"{name}_{kind}"
        folder = table_folder(spark, table)
        drop_table(spark, table)
        if folder and folder.rstrip("/").rsplit("/", 1)[-1] == table:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def export_delimited(df: DataFrame, path: str, id_col: str = "id", vec_col: str = "v", sep: str = "|") -> None:
    """Text rows ``id|[x1,x2,...]``."""
    df.select(F.col(id_col), to_vector_literal(vec_col)).write.option("sep", sep).csv(path)


def read_delimited(
    spark: SparkSession, path: str, dim: int | None = None, element: str = "float", sep: str = "|"
) -> DataFrame:
    """``(id, v)`` from delimited text; spaces round the delimiter are dropped."""
    rows = (
        spark.read.schema("id string, literal string")
        .option("sep", sep).option("mode", "FAILFAST")
        .csv(path)
    )
    return rows.select(
        F.trim("id").cast("long").alias("id"), from_vector_literal("literal", dim, element).alias("v")
    )
