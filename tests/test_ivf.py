import numpy as np
import pytest

from tests.conftest import as_queries, brute, listed, mean_recall, vectors
from vecspark.operators import ivf
from vecspark.plans.sweep import Build, sweep, sweep_builds, sweep_summary
from vecspark.operators.knn import ground_truth
from vecspark.sources import tables

RNG = np.random.default_rng(11)
CENTRES = RNG.normal(size=(12, 8)) * 3
POINTS = CENTRES[RNG.integers(0, 12, 900)] + RNG.normal(size=(900, 8))


@pytest.fixture(scope="module")
def base(spark):
    return vectors(spark, POINTS, label=[i % 5 for i in range(len(POINTS))]).cache()


@pytest.fixture(scope="module")
def index(spark, base):
    return ivf.ivf_build(base, "ivf_points", 16, "l2")


def test_chunks_are_not_copied_more_than_the_other_side_is_large(monkeypatch, base, index):
    held, pair = [], ivf.knn.cogrouped_topk
    monkeypatch.setattr(ivf.knn, "cogrouped_topk", lambda a, b, *rest: held.append((a.count(), b.count())) or pair(a, b, *rest))
    found = ivf.ivf_search(index, as_queries(base), 10, 999, broadcast_bytes=0, chunk_bytes=640)
    assert listed(found) == brute("l2", POINTS, POINTS, 10)
    asked = 900 * index.lists
    assert held[0][0] < 2.5 * asked and held[0][1] < 1.5 * asked


def test_postings_hold_every_row_once(spark, base, index):
    kept = index.postings(spark).select("id", "v", "label")
    assert kept.exceptAll(base).count() == 0 and kept.count() == 900
    assert ivf.ivf_open(spark, "ivf_points") == index


def test_all_probes_is_exact_both_ways(base, index):
    wanted = brute("l2", POINTS, POINTS, 10)
    assert listed(ivf.ivf_search(index, as_queries(base), 10, index.lists)) == wanted
    shuffled = ivf.ivf_search(index, as_queries(base), 10, 999, broadcast_bytes=0, chunk_bytes=2000)
    assert listed(shuffled) == wanted


def test_both_ways_agree_on_some_probes(base, index):
    a = listed(ivf.ivf_search(index, as_queries(base), 10, 3))
    b = listed(ivf.ivf_search(index, as_queries(base), 10, 3, broadcast_bytes=0, chunk_bytes=5000))
    assert a == b


def test_recall_rises_with_probes(base, index):
    wanted = brute("l2", POINTS, POINTS, 10)
    got = [mean_recall(listed(ivf.ivf_search(index, as_queries(base), 10, p)), wanted) for p in (1, 4, 16)]
    assert got[0] < got[1] <= got[2] == 1.0 and got[1] > 0.9


def test_few_queries_read_only_their_folders(spark, base, index):
    found = ivf.ivf_search(index, as_queries(base.where("id = 3")), 5, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "part#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert found.count() == 5


def test_filter_comes_before_ranking(base, index):
    passing = np.arange(900) % 5 == 2
    found = ivf.ivf_search(index, as_queries(base), 10, 16, "label = 2")
    assert listed(found) == brute("l2", POINTS, POINTS, 10, passing=passing)


@pytest.mark.parametrize("metric", ["l1", "ip", "cosine", "hamming", "jaccard"])
def test_every_metric(spark, metric):
    bits = metric in ("hamming", "jaccard")
    a = RNG.integers(0, 1 << 16, (150, 2)) if bits else POINTS[:150].copy()
    if not bits:
        a[7] = 0.0
    base = vectors(spark, a, element="bigint" if bits else "double")
    index = ivf.ivf_build(base, f"ivf_{metric}", 6, metric)
    assert listed(ivf.ivf_search(index, as_queries(base), 5, 6, metric=metric)) == brute(metric, a, a, 5)
    some = mean_recall(listed(ivf.ivf_search(index, as_queries(base), 5, 4)), brute(metric, a, a, 5))
    assert some > 0.6
    with pytest.raises(ValueError, match="serves"):
        ivf.ivf_search(index, as_queries(base), 5, 6, metric="l2")


def test_a_third_of_copies(spark):
    a = POINTS[:600].copy()
    a[200:400] = a[0]
    base = vectors(spark, a)
    index = ivf.ivf_build(base, "ivf_copies", 10, "l2")
    wanted = brute("l2", a, a, 8)
    assert listed(ivf.ivf_search(index, as_queries(base), 8, 10)) == wanted
    assert listed(ivf.ivf_search(index, as_queries(base), 8, 10, broadcast_bytes=0, chunk_bytes=2000)) == wanted


def test_more_lists_than_vectors(spark):
    base = vectors(spark, POINTS[:5])
    index = ivf.ivf_build(base, "ivf_tiny", 50, "l2")
    assert index.lists <= 50
    assert listed(ivf.ivf_search(index, as_queries(base), 3, 50)) == brute("l2", POINTS[:5], POINTS[:5], 3)


def test_nothing_but_copies(spark):
    base = vectors(spark, np.ones((30, 4)))
    index = ivf.ivf_build(base, "ivf_same", 5, "l2")
    assert index.lists == 1
    assert listed(ivf.ivf_search(index, as_queries(base), 3))[29] == [0, 1, 2]


def test_append_and_drop(spark, base):
    first, later = base.where("id < 500"), base.where("id >= 500")
    index = ivf.ivf_build(first, "ivf_grown", 8, "l2")
    ivf.ivf_append(index, later)
    assert listed(ivf.ivf_search(index, as_queries(base), 10, 8)) == brute("l2", POINTS, POINTS, 10)
    with pytest.raises(ValueError, match="label"):
        ivf.ivf_append(index, later.drop("label"))
    tables.drop_index(spark, index.name)
    tables.drop_index(spark, index.name)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("ivf_grown")]


def test_drop_deletes_files(spark, base, tmp_path):
    (tmp_path / "other").mkdir()
    index = ivf.ivf_build(base, "ivf_gone", 4, "l2", location=str(tmp_path))
    assert (tmp_path / "ivf_gone_postings").exists()
    tables.drop_index(spark, index.name)
    assert [x.name for x in tmp_path.iterdir()] == ["other"]


def test_bad_arguments(spark, base, index):
    with pytest.raises(ValueError):
        ivf.ivf_search(index, as_queries(base), 5, 0)
    with pytest.raises(ValueError, match="dimension"):
        ivf.ivf_search(index, as_queries(vectors(spark, np.ones((1, 3)))), 5)
    with pytest.raises(ValueError, match="fewer lists"):
        ivf.coarse_for(10**13, "l2", 8, 64 << 20)
    with pytest.raises(ValueError, match="empty"):
        ivf.ivf_build(base.where("id < 0"), "ivf_none", 4, "l2")
    assert ivf.ivf_search(index, as_queries(base.where("id < 0")), 5).count() == 0


def test_sweep_scores_each_setting(base, index):
    truth = ground_truth(base, as_queries(base), 10)
    recalls = sweep(index, as_queries(base), truth, [1, 16], 10)
    assert recalls.groupBy("setting").count().where("count = 900").count() == 2
    found = {(r["setting"], r["statistic"]): r["value"] for r in sweep_summary(recalls, "99").collect()}
    assert found[(16, "worst")] == found[(16, "P(99%)")] == 1.0
    assert found[(1, "average")] < 1.0


def test_sweep_over_builds(spark, base, tmp_path):
    truth = ground_truth(base, as_queries(base), 10)
    builds = [Build("few", "ivf", {"lists": 3}, (1, 3)), Build("net", "graph", {"m": 8, "ef_construction": 24}, (40,))]
    swept = sweep_builds(base, as_queries(base), truth, builds, 10, name="swept", location=str(tmp_path))
    found = {(r["build"], r["setting"]): r for r in swept.recalls.groupBy("build", "setting").agg(
        {"recall": "avg", "qid": "count"}).collect()}
    assert set(found) == {("few", 1), ("few", 3), ("net", 40)}
    assert all(r["count(qid)"] == 900 for r in found.values())
    assert found[("few", 1)]["avg(recall)"] < found[("few", 3)]["avg(recall)"] == 1.0
    assert found[("net", 40)]["avg(recall)"] > 0.9
    facts = {r["build"]: r for r in swept.builds.collect()}
    assert facts["few"]["lists"] == 3 and facts["few"]["options"] == '{"lists": 3}'
    assert all(r["bytes"] > 0 and r["seconds"] > 0 for r in facts.values())
    assert not list(tmp_path.iterdir()) and not [t.name for t in spark.catalog.listTables() if t.name.startswith("swept")]
    summary = sweep_summary(swept.recalls, "50").collect()
    assert {r["build"] for r in summary} == {"few", "net"}


def test_sweep_over_builds_refuses(spark, base, index):
    queries = as_queries(base.where("id < 2"))
    truth = ground_truth(base, queries, 10)
    few = Build("few", "ivf", {"lists": 3}, (1,))
    for builds, name in (
        ([], "s"), ([few, few], "s"), ([Build("x", "tree")], "s"), ([Build("x", "ivf", {}, ())], "s"),
    ):
        with pytest.raises(ValueError):
            sweep_builds(base, queries, truth, builds, 10, name=name)
    ivf.ivf_build(base, "held_0", 2, "l2")
    with pytest.raises(ValueError, match="already"):
        sweep_builds(base, queries, truth, [few], 10, name="held")
    assert ivf.ivf_open(spark, "held_0").lists == 2


def test_vectors_of_mixed_dimension_are_refused(spark):
    base = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="dimension|shape|size"):
        ivf.ivf_build(base.repartition(3), "ivf_mixed", 2, "l2")
