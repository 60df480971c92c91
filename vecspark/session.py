"""Session helpers: shared scratch folder and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A folder every executor can reach, for intermediate tables.

    Taken from ``spark.checkpoint.dir``. Only a local session without that
    setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = os.path.join(tempfile.gettempdir(), "vecspark")
    return f"{root.rstrip('/')}/vecspark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_step(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared scratch folder and read it back.

    The written files survive executor loss, and their known size lets the
    next join pick its strategy.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (as ``--py-files`` would)."""
    conf_key = "vecspark.shipped"
    if spark.conf.get(conf_key, None) == spark.sparkContext.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="vecspark-"), "vecspark_pkg.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(here):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set(conf_key, spark.sparkContext.applicationId)
