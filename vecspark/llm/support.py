"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vecspark.session import ship_package, write_step as write_table

#: At most so many ids are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


#: Rows go to Python in batches of about so many bytes (one row at least). A batch and the arrays made from it are held by every
#: task at once, beside a heap that takes most of an executor's memory.
BATCH_BYTES = 1 << 20

#: Lets Spark delete the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_step(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back; its shuffle files go at once."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return write_table(df, label)
    finally:
        conf.set(CLEANUP, before)


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends rows to Python in batches of ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(ids: DataFrame) -> DataFrame:
    """Mark a written table of ids for broadcast if its counted size is bounded."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose ``doc_id`` is in the written table ``ids``.

    A bounded number of ids passes the driver as one sorted array, 8 bytes each, where a broadcast join builds a hash table of
    rows. More are joined by a shuffle.
    """
    if ids.count() > BROADCAST_IDS:
        return rows.join(ids, "doc_id", "left_semi")
    held = ids.where("doc_id is not null").toArrow()["doc_id"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(np.sort(held))

    def wanted(asked: pa.Array) -> pa.Array:
        values, known = shared.value, asked.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(values, known), len(values) - 1)
        found = values[at] == known if len(values) else np.zeros(len(known), bool)
        return pa.array(found & asked.is_valid().to_numpy(zero_copy_only=False))

    return rows.where(F.arrow_udf(wanted, "boolean")("doc_id"))


__all__ = ["BROADCAST_IDS", "only", "ship_package", "small", "small_batches", "table", "write_step"]
