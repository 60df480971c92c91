"""Fixed-record vector files: fvecs (float32), bvecs (uint8), ivecs (int32).

A record is a little-endian uint32 dimension followed by that many elements.
Files are opened by Spark's fixed-length record input, so any Hadoop file system
will do (``hdfs://``, ``s3a://``, ...) with the session's settings and credentials.
Tasks get byte ranges of whole records and decode them in Arrow batches. A row's
id is its position over all files, in the order they are given.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

HEADER_BYTES = 4
SPLIT_BYTES = 128 << 20
#: the low bits of a monotonically increasing id: the row's number within its task
ROW_BITS = 33

#: element kind -> numpy type in the file, numpy type in the row, Spark type
ELEMENTS = {
    "float": ("<f4", "float32", "float"),
    "byte": ("u1", "int16", "smallint"),
    "int": ("<i4", "int64", "bigint"),
}


def record_bytes(dim: int, element: str) -> int:
    return HEADER_BYTES + dim * np.dtype(ELEMENTS[element][0]).itemsize


def file_lengths(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """``(path, length)`` of each file, fully qualified and in the given order; contents are not read."""
    found = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(at) or not store.getFileStatus(at).isFile():
            raise FileNotFoundError(path)
        found.append((store.makeQualified(at).toString(), store.getFileStatus(at).getLen()))
    return found


def _records(spark: SparkSession, path: str, size: int, split_bytes: int) -> DataFrame:
    """``(value BINARY, first LONG)``: the records of a file and the position of each within it.

    A task's range is a whole number of records, so the byte it starts at gives its first position.
    """
    conf = spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    conf.set("mapreduce.input.fileinputformat.split.maxsize", str(max(size, split_bytes)))
    records = spark._jsc.sc().binaryRecords(_literal(path), size, conf)
    rows = spark._jsparkSession.createDataset(records, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF()
    within = F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1)
    return DataFrame(rows, spark).select("value", (F.expr(f"input_file_block_start() div {size}") + within).alias("first"))


def _literal(path: str) -> str:
    """``path`` for an input that takes patterns, parted by commas outside braces."""
    return "".join("{\\,}" if c == "," else "\\" + c if c in "{}[]*?\\" else c for c in path)


def _decode(dim: int, element: str):
    """``mapInArrow`` body: records to ``(id, v)``."""
    stored, kept, _ = ELEMENTS[element]
    record = np.dtype([("dim", "<u4"), ("v", stored, (dim,))])

    def run(batches):
        for batch in batches:
            values = batch.column("value").cast(pa.binary())
            start, stop = np.frombuffer(values.buffers()[1], np.int32)[[values.offset, values.offset + len(values)]]
            block = np.frombuffer(values.buffers()[2], record, len(values), start) if stop > start else np.empty(0, record)
            if (block["dim"] != dim).any():
                found = int(block["dim"][block["dim"] != dim][0])
                raise ValueError(f"record of dimension {found}, expected {dim}")
            flat = np.ascontiguousarray(block["v"]).astype(kept).ravel()
            offsets = np.arange(0, (len(block) + 1) * dim, dim, dtype=np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("first"), vectors], names=["id", "v"])

    return run


def _scan(
    spark: SparkSession, paths, dim: int, element: str, split_bytes: int | None = None
) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    size, schema = record_bytes(dim, element), f"id bigint, v array<{ELEMENTS[element][2]}>"
    found, first_id = [], 0
    for path, length in file_lengths(spark, paths):
        if length % size:
            raise ValueError(f"{path}: {length} bytes is not a whole number of {size}-byte records")
        if length:
            rows = _records(spark, path, size, split_bytes or SPLIT_BYTES)
            found.append(rows.withColumn("first", F.col("first") + F.lit(first_id)))
        first_id += length // size
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, found).mapInArrow(_decode(dim, element), schema)


def scan_fvecs(spark: SparkSession, paths, dim: int, **options) -> DataFrame:
    """``(id, v ARRAY<FLOAT>)`` from one or more float files."""
    return _scan(spark, paths, dim, "float", **options)


def scan_bvecs(spark: SparkSession, paths, dim: int, **options) -> DataFrame:
    """``(id, v ARRAY<SMALLINT>)`` from one or more byte files; elements are 0..255."""
    return _scan(spark, paths, dim, "byte", **options)


def scan_ivecs(spark: SparkSession, path: str, topk: int, k1: int | None = None, **options) -> DataFrame:
    """``(qid, neighbours ARRAY<LONG>)``: ground-truth lists, cut to the first ``k1``."""
    rows = _scan(spark, path, topk, "int", **options)
    lists = F.slice("v", 1, k1) if k1 else F.col("v")
    return rows.select(F.col("id").alias("qid"), lists.alias("neighbours"))


def scan_query_vecs(spark: SparkSession, path: str, dim: int, dtype: str = "float", **options) -> DataFrame:
    """``(qid, qv)``: a query set, numbered by position."""
    if dtype not in ("float", "byte"):
        raise ValueError(f"query vectors are float or byte, not {dtype}")
    return _scan(spark, path, dim, dtype, **options).select(F.col("id").alias("qid"), F.col("v").alias("qv"))
