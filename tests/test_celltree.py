import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_queries, brute, listed, mean_recall, vectors
from vecspark.operators import celltree, ivf, knn
from vecspark.sources import tables

RNG = np.random.default_rng(41)
CENTRES = RNG.normal(size=(30, 6)) * 4
POINTS = CENTRES[RNG.integers(0, 30, 1200)] + RNG.normal(size=(1200, 6))
POINTS[300:700] = POINTS[0]  # a third of all rows are copies


@pytest.fixture(scope="module")
def base(spark):
    return vectors(spark, POINTS, label=[i % 5 for i in range(len(POINTS))]).cache()


@pytest.fixture(scope="module")
def index(spark, base):
    return ivf.ivf_build(base, "tree_points", 49, "l2", centroid_bytes=600, max_iter=5)


def test_every_row_lies_in_its_nearest_list(spark, base, index):
    assert index.coarse == 7 and 40 <= index.lists <= 56
    assert ivf.ivf_open(spark, "tree_points") == index
    kept = index.postings(spark)
    assert kept.select("id", "v", "label").exceptAll(base).count() == 0 and kept.count() == 1200
    centres = spark.table("tree_points_centroids")
    assert sorted(r["list"] for r in centres.collect()) == list(range(index.lists))
    nearest = knn.knn_join(centres.select(F.col("list").alias("id"), F.col("c").alias("v")), as_queries(base), 1)
    same = kept.join(nearest.select(F.col("qid").alias("id"), F.col("id").alias("nearest")), "id")
    assert same.agg(F.avg((F.col("list") == F.col("nearest")).cast("int"))).first()[0] > 0.95


def test_search_through_the_tree(base, index):
    wanted = brute("l2", POINTS, POINTS, 10)
    assert listed(ivf.ivf_search(index, as_queries(base), 10, index.lists)) == wanted
    recalls = [mean_recall(listed(ivf.ivf_search(index, as_queries(base), 10, p)), wanted) for p in (1, 6)]
    assert recalls[0] <= recalls[1] and recalls[1] > 0.9
    shuffled = ivf.ivf_search(index, as_queries(base), 10, 6, broadcast_bytes=0, chunk_bytes=5000)
    assert listed(shuffled) == listed(ivf.ivf_search(index, as_queries(base), 10, 6))


def test_append_to_a_tree(spark, base):
    index = ivf.ivf_build(base.where("id % 2 = 0"), "tree_grown", 25, "l2", centroid_bytes=300, max_iter=3)
    ivf.ivf_append(index, base.where("id % 2 = 1"))
    assert listed(ivf.ivf_search(index, as_queries(base), 5, index.lists)) == brute("l2", POINTS, POINTS, 5)
    tables.drop_index(spark, "tree_grown")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tree_grown")]


@pytest.mark.parametrize("metric", ["cosine", "ip", "hamming"])
def test_other_metrics(spark, monkeypatch, metric):
    monkeypatch.setattr(knn, "CHUNK_BYTES", 4000)  # several chunks a cell
    a = RNG.integers(0, 1 << 40, (200, 1)) if metric == "hamming" else POINTS[:200]
    base = vectors(spark, a, element="bigint" if metric == "hamming" else "double")
    index = ivf.ivf_build(base, f"tree_{metric}", 16, metric, centroid_bytes=100, max_iter=2)
    assert index.coarse == 4
    assert listed(ivf.ivf_search(index, as_queries(base), 5, index.lists)) == brute(metric, a, a, 5)


def test_sizes():
    assert ivf.coarse_for(100_000, "l2", 768, knn.BROADCAST_BYTES) == 317  # 614 MB of centroids in all, 2 MB broadcast
    assert ivf.coarse_for(1000, "l2", 768, knn.BROADCAST_BYTES) == 0
    with pytest.raises(ValueError, match="fewer lists"):
        ivf.coarse_for(10**10, "l2", 768, knn.BROADCAST_BYTES)
    assert celltree.hops_for(5, 100, 10) == 3 and celltree.hops_for(100, 100, 10) == 10 and celltree.hops_for(40, 100, 10) == 10
