import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_queries, brute, listed, vectors
from vecspark.functions import kernels
from vecspark.operators import knn


def sample(metric, rows=120, seed=0):
    rng = np.random.default_rng(seed)
    if metric in kernels.BIT_METRICS:
        return rng.integers(0, 1 << 12, (rows, 2)), "bigint"
    return rng.normal(size=(rows, 8)), "double"


@pytest.mark.parametrize("metric", kernels.METRICS)
def test_every_way_gives_the_full_sort(spark, metric):
    a, element = sample(metric)
    a[40:80] = a[0]  # a third of all rows are copies
    base = vectors(spark, a, element=element)
    wanted = brute(metric, a, a, 7)
    queries = as_queries(base)
    assert listed(knn.knn_join(base, queries, 7, metric)) == wanted
    assert listed(knn.knn_join(base, queries, 7, metric, broadcast_bytes=1500)) == wanted
    assert listed(knn.knn_join(base, queries, 7, metric, bound_fraction=0.5)) == wanted


def test_distances_and_ranks(spark):
    base = vectors(spark, np.array([[3.0, 4.0], [0.0, 0.0], [0.0, 1.0]]), ids=[30, 10, 20])
    rows = knn.knn_join(base, as_queries(base.where("id = 10")), 3).orderBy("rank").collect()
    assert [(r["qid"], r["rank"], r["id"], r["distance"]) for r in rows] == [
        (10, 1, 10, 0.0), (10, 2, 20, 1.0), (10, 3, 30, 5.0),
    ]


def test_ties_go_to_the_smaller_id(spark):
    base = vectors(spark, np.ones((9, 2)), ids=[8, 3, 5, 1, 9, 2, 7, 4, 6], partitions=4)
    assert listed(knn.knn_join(base, as_queries(base.where("id = 9")), 4)) == {9: [1, 2, 3, 4]}


def test_zero_vectors_come_last_under_cosine(spark):
    a = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 0.0], [-1.0, 0.0]])
    base = vectors(spark, a)
    found = listed(knn.knn_join(base, as_queries(base), 4, "cosine"))
    assert found[1] == [1, 3, 0, 2]
    assert found[0] == [0, 1, 2, 3]


def test_filter_may_leave_fewer_than_k(spark):
    a, _ = sample("l2")
    base = vectors(spark, a)
    found = listed(knn.knn_join(base, as_queries(base), 10, "l2", "id >= 117"))
    assert found == brute("l2", a, a, 10, passing=np.arange(len(a)) >= 117)
    assert all(len(ids) == 3 for ids in found.values())
    assert knn.knn_join(base, as_queries(base), 10, "l2", F.col("id") < 0).count() == 0


def test_empty_sides(spark):
    base = vectors(spark, np.ones((3, 2)))
    none = base.where("id > 5")
    assert knn.knn_join(base, as_queries(none), 3).count() == 0
    assert knn.knn_join(none, as_queries(base), 3).count() == 0
    assert knn.knn_join(none, as_queries(base), 3, broadcast_bytes=0).count() == 0


def test_null_vectors_are_left_out(spark):
    base = spark.createDataFrame([(0, [1.0]), (1, None)], "id long, v array<double>")
    assert listed(knn.knn_join(base, as_queries(base), 3)) == {0: [0]}


def test_dimension_mismatch_is_an_error(spark):
    base = vectors(spark, np.ones((3, 2)))
    with pytest.raises(Exception, match="dimension"):
        knn.knn_join(base, as_queries(vectors(spark, np.ones((1, 3)))), 1).collect()


def test_bad_arguments(spark):
    base = vectors(spark, np.ones((3, 2)))
    with pytest.raises(ValueError):
        knn.knn_join(base, as_queries(base), 0)
    with pytest.raises(ValueError):
        knn.knn_join(base, as_queries(base), 1, "l3")
    with pytest.raises(ValueError):
        knn.expand_workload(as_queries(base), 0)


def test_one_vector(spark):
    a, _ = sample("l2")
    base = vectors(spark, a)
    found = knn.knn(base, a[5].tolist(), 6)
    assert [r["id"] for r in found.collect()] == brute("l2", a, a[5:6], 6)[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_plan_prunes_columns_and_limits_before_the_shuffle(spark, tmp_path):
    a, _ = sample("l2")
    vectors(spark, a, label=list(range(len(a)))).write.parquet(str(tmp_path / "b"))
    base = spark.read.parquet(str(tmp_path / "b"))
    plan = knn.knn_join(base, as_queries(base), 3, "l2", "id >= 7")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,7)" in plan
    assert "label" not in plan.split("ReadSchema")[1]
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_ground_truth_lists(spark):
    a, _ = sample("ip")
    base = vectors(spark, a)
    found = {r["qid"]: r["neighbours"] for r in knn.ground_truth(base, as_queries(base), 5, "ip").collect()}
    assert found == brute("ip", a, a, 5)


def test_workload_repeats_queries_in_order(spark):
    ids = [50, 3, 10**12, -4, 7]
    queries = as_queries(vectors(spark, np.ones((5, 1)), ids=ids))
    found = knn.expand_workload(queries, 3).orderBy("seq").collect()
    ordered = sorted(ids) * 3
    assert [(r["seq"], r["round"], r["qid"]) for r in found] == [(n, n // 5, q) for n, q in enumerate(ordered)]


def test_positions_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 - 300).alias("key"))
    placed, count = knn.with_position(df, "key", buckets=16)
    assert count == 1000
    assert [r["pos"] for r in placed.orderBy("key").collect()] == list(range(1000))


@pytest.mark.parametrize("metric", ["l1", "l2", "ip", "cosine"])
@pytest.mark.parametrize("chunked", [False, True])
def test_non_finite_elements_hide_nothing(spark, monkeypatch, metric, chunked):
    if chunked:
        monkeypatch.setattr(knn, "BROADCAST_BYTES", 1)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 6))
    base[7, 2], base[11, 0], base[12, 5], base[13, 1] = np.nan, np.inf, -np.inf, 1e200
    queries = np.vstack([rng.standard_normal((4, 6)), base[7], base[11]])
    answers = knn.knn_join(vectors(spark, base, partitions=1), as_queries(vectors(spark, queries)), 5, metric)
    with np.errstate(all="ignore"):
        assert listed(answers) == brute(metric, base, queries, 5)
    everything = knn.knn_join(vectors(spark, base), as_queries(vectors(spark, queries)), 300, metric)
    assert {q: len(ids) for q, ids in listed(everything).items()} == {q: 300 for q in range(6)}


def test_non_finite_sample_bound(spark):
    base = np.full((50, 3), np.nan)
    base[40:] = np.arange(30).reshape(10, 3)
    answers = knn.knn_join(vectors(spark, base), as_queries(vectors(spark, base[40:42])), 12, "l2", bound_fraction=0.5)
    assert {q: len(ids) for q, ids in listed(answers).items()} == {0: 12, 1: 12}


def clouds(seed, n, dim, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 20
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)), rng


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("blocks", [1, 3])
def test_cells_prune_and_lose_nothing(spark, monkeypatch, metric, blocks):
    points, rng = clouds(5, 1500, 6)
    points[700:800] = points[3]  # many ties
    points[10] = 0
    if metric == "cosine":  # equal directions, which rounding may tell apart
        points[800:900] = points[4] * rng.uniform(0.1, 50, (100, 1))
    base = vectors(spark, points)
    found = knn.knn_join(base, as_queries(base), 6, metric, broadcast_bytes=points.nbytes // blocks)
    assert listed(found) == brute(metric, points, points, 6)


def test_cells_leave_vectors_out(monkeypatch):
    points, _ = clouds(6, 4000, 8)
    cells = kernels.query_cells("l2", points)
    best = kernels.TopK(len(points), 5)
    queries = kernels.QueryBlock("l2", np.arange(len(points)), points)
    kernels.scan_block(best, queries, np.arange(len(points)), np.arange(1000), points[:1000])
    best.settle(force=True)
    seen = []
    monkeypatch.setattr(kernels, "scan_block", lambda b, q, rows, ids, block: seen.append(len(rows) * len(ids)))
    kernels.scan_cells(best, queries, cells, np.arange(1000, 4000), points[1000:])
    assert 0 < sum(seen) < 0.3 * 4000 * 3000
    assert kernels.query_cells("ip", points) is None and kernels.query_cells("l2", points[:10]) is None


def test_blocks_are_bounded_by_answers_too():
    size = knn.VectorStats(130_000, 64)
    assert knn.query_blocks(size, 1000, knn.BROADCAST_BYTES) == 33 and knn.query_blocks(size, 10, knn.BROADCAST_BYTES) == 1
    assert knn.query_blocks(knn.VectorStats(10, 64), 5, 0) == 10


def test_one_pass_takes_many_blocks_of_queries(spark, monkeypatch):
    points, _ = clouds(7, 600, 4)
    base, passes, held = vectors(spark, points), [], []
    merge, scan = knn.merge_topk, kernels.topk_scan_blocks
    monkeypatch.setattr(knn, "merge_topk", lambda found, k: passes.append(1) or merge(found, k))
    monkeypatch.setattr(kernels, "topk_scan_blocks", lambda shared, *a: held.extend(b.value[1].nbytes for b in shared) or scan(shared, *a))
    assert listed(knn.knn_join(base, as_queries(base), 5, "l2", broadcast_bytes=1000)) == brute("l2", points, points, 5)
    assert len(passes) <= 8 and len(held) >= 19 and max(held) <= 1000


def test_base_is_not_shuffled_by_passes(spark, monkeypatch, tmp_path):
    points = np.random.default_rng(8).normal(size=(60, 3))
    vectors(spark, points).write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    plans, merge = [], knn.merge_topk
    monkeypatch.setattr(knn, "merge_topk", lambda partial, k: plans.append(partial) or merge(partial, k))
    assert listed(knn.knn_join(base, as_queries(base), 4, "l2", broadcast_bytes=500)) == brute("l2", points, points, 4)
    assert len(plans) == 3
    for partial in plans:
        plan = partial._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Scan parquet" in plan and "Exchange" not in plan
