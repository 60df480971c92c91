import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(work / "warehouse"))
        .config("spark.checkpoint.dir", str(work / "shared"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def vectors(spark, matrix, ids=None, partitions=3, element="double", **columns):
    """``(id, v, ...)`` from a numpy matrix."""
    ids = range(len(matrix)) if ids is None else ids
    extra = list(columns.items())
    rows = [(int(i), [x.item() for x in v], *[c[n] for _, c in extra]) for n, (i, v) in enumerate(zip(ids, matrix))]
    schema = f"id long, v array<{element}>" + "".join(f", {name} long" for name, _ in extra)
    return spark.createDataFrame(rows, schema).repartition(partitions)


def as_queries(df):
    return df.select(F.col("id").alias("qid"), F.col("v").alias("qv"))


def brute(metric, base, queries, k, ids=None, passing=None):
    """``{query number: [ids]}`` by full sort on (distance, id), NaN last."""
    from vecspark.functions.kernels import paired

    ids = np.arange(len(base)) if ids is None else np.asarray(ids)
    keep = np.ones(len(base), bool) if passing is None else passing
    found = {}
    for n, q in enumerate(queries):
        d = paired(metric, base[keep], q)
        found[n] = ids[keep][np.lexsort((ids[keep], d))][:k].tolist()
    return found


def listed(answers):
    """``{qid: [ids by rank]}`` of ranked answers."""
    found = {}
    for row in sorted(answers.collect(), key=lambda r: (r["qid"], r["rank"])):
        found.setdefault(row["qid"], []).append(row["id"])
    return found


def mean_recall(found, wanted):
    return float(np.mean([len(set(found.get(q, [])) & set(ids)) / len(ids) for q, ids in wanted.items()]))
