import numpy as np
import pytest

from tests.test_sources import write_vecs
from vecspark.functions.kernels import paired
from vecspark.plans import phases
from vecspark.sources import registry


@pytest.fixture
def dataset(tmp_path):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(300, 16)).astype(np.float32)
    q = rng.normal(size=(12, 16)).astype(np.float32)
    truth = np.array([np.argsort(paired("l2", a.astype(float), x.astype(float)))[:20] for x in q], dtype=np.int32)
    write_vecs(tmp_path / "b0", a[:200], "<f4")
    write_vecs(tmp_path / "b1", a[200:], "<f4")
    write_vecs(tmp_path / "q", q, "<f4")
    write_vecs(tmp_path / "t", truth, "<i4")
    return registry.Dataset(
        location=str(tmp_path), name="own_set", format="FVECS", base_type="FLOAT", metric="L2",
        base_files=(("b0", 200), ("b1", 100)), fields=(("id", "int"), ("embedding", "vector(16)")),
        vector_field="embedding", dim=16, total_count=300, query_file=("q", 12), truth_file=("t", 12), gt_topk=20,
    )


def test_phases_in_a_chain(spark, dataset):
    table = phases.setup(spark, dataset)
    with pytest.raises(Exception, match="exists"):
        phases.setup(spark, dataset)
    assert phases.load(spark, dataset).count() == 300

    exact = phases.query(spark, dataset, percentages="50,100")
    assert {r["statistic"]: r["value"] for r in exact.summary.collect()}["worst"] == 1.0

    lists = phases.index(spark, dataset, "IVFFlat", lists=8)
    found = phases.query(spark, dataset, lists, 8, k1=5, k2=10)
    assert found.answers.count() == 120
    assert found.recalls.agg({"recall": "min"}).first()[0] == 1.0
    narrow = phases.query(spark, dataset, lists, 1)
    assert narrow.recalls.agg({"recall": "avg"}).first()[0] < 1.0

    # an index that exists before a load takes in the loaded rows
    phases.teardown(spark, dataset, truncate=True)
    assert spark.table(table).count() == 0
    phases.load(spark, dataset, index=lists)
    assert lists.postings(spark).count() == 600

    phases.teardown(spark, dataset, drop_index=True)
    assert spark.catalog.tableExists(table) and not spark.catalog.tableExists(lists.table("postings"))
    net = phases.index(spark, dataset, "hnsw", m=8, ef_construction=32)
    assert phases.query(spark, dataset, net, 60).recalls.agg({"recall": "avg"}).first()[0] > 0.9
    phases.teardown(spark, dataset, drop_index=True)
    phases.teardown(spark, dataset)
    assert not spark.catalog.tableExists(table)


def test_wrong_arguments(spark, dataset):
    with pytest.raises(ValueError, match="hnsw or ivfflat"):
        phases.index(spark, dataset, "btree")
    with pytest.raises(ValueError, match="k2"):
        phases.query(spark, dataset, k2=21)
    with pytest.raises(ValueError, match="rows: 300, not 301"):
        phases.load(spark, registry.replace(dataset, base_files=(("b0", 200), ("b1", 101)), total_count=301))
