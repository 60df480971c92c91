import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import vectors
from vecspark.sources import parquet, registry, tables, vecs


def write_vecs(path, matrix, stored):
    record = np.dtype([("dim", "<u4"), ("v", stored, (matrix.shape[1],))])
    block = np.empty(len(matrix), dtype=record)
    block["dim"], block["v"] = matrix.shape[1], matrix
    path.write_bytes(block.tobytes())
    return str(path)


def test_fvecs_positions_run_over_files_and_splits(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(107, 8)).astype(np.float32)
    # names sort the other way round than the declared order
    files = [
        write_vecs(tmp_path / name, part, "<f4")
        for name, part in zip("zyx", (a[:50], a[50:51], a[51:]))
    ]
    rows = vecs.scan_fvecs(spark, files, 8, split_bytes=10 * 36)
    assert rows.rdd.getNumPartitions() == 5 + 1 + 6
    found = sorted(rows.collect())
    assert [r["id"] for r in found] == list(range(107))
    assert np.array_equal(np.float32([r["v"] for r in found]), a)
    assert dict(rows.dtypes) == {"id": "bigint", "v": "array<float>"}


def test_vecs_through_a_configured_file_system(spark, tmp_path):
    a = np.random.default_rng(3).normal(size=(95, 6)).astype(np.float32)
    for name, part in (("one", a[:40]), ("two", a[40:])):
        write_vecs(tmp_path / name, part, "<f4")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./vecs", f"file://{tmp_path}")
    rows = vecs.scan_fvecs(spark, ["viewfs://shelf/vecs/two", "viewfs://shelf/vecs/one"], 6, split_bytes=300)
    found = sorted(rows.collect())
    assert [r["id"] for r in found] == list(range(95))
    assert np.array_equal(np.float32([r["v"] for r in found]), np.vstack([a[40:], a[:40]]))
    with pytest.raises(FileNotFoundError, match="three"):
        vecs.scan_fvecs(spark, "viewfs://shelf/vecs/three", 6)


def test_names_of_vector_files_are_no_patterns(spark, tmp_path):
    for n, name in enumerate(("a*", "ab", "a,b", "{a,b}", "[a]", "a b%20", "a\\b")):
        write_vecs(tmp_path / name, np.full((2, 3), n, np.float32), "<f4")
        rows = vecs.scan_fvecs(spark, str(tmp_path / name), 3).collect()
        assert [(r["id"], r["v"]) for r in sorted(rows)] == [(0, [n] * 3), (1, [n] * 3)]


def test_ids_survive_what_comes_after_the_scan(spark, tmp_path):
    a = np.arange(60, dtype=np.float32).reshape(20, 3)
    files = [write_vecs(tmp_path / "p", a[:13], "<f4"), write_vecs(tmp_path / "q", a[13:], "<f4")]
    rows = vecs.scan_fvecs(spark, files, 3, split_bytes=64)
    kept = rows.where("id >= 10").repartition(3).join(rows.select("id", F.col("v")[0].alias("x")), "id")
    assert sorted((r["id"], r["x"]) for r in kept.select("id", "x").collect()) == [(i, 3.0 * i) for i in range(10, 20)]


def test_bvecs_bytes_are_unsigned_numbers(spark, tmp_path):
    a = np.array([[0, 127, 128, 255]], dtype=np.uint8)
    rows = vecs.scan_bvecs(spark, [write_vecs(tmp_path / "b", a, "u1")], 4)
    assert rows.first()["v"] == [0, 127, 128, 255]
    queries = vecs.scan_query_vecs(spark, str(tmp_path / "b"), 4, "byte")
    assert queries.columns == ["qid", "qv"] and queries.first()["qv"] == [0, 127, 128, 255]


def test_ivecs_lists_keep_order_and_are_cut(spark, tmp_path):
    a = np.array([[9, 3, 7], [1, 2, 0]], dtype=np.int32)
    path = write_vecs(tmp_path / "t", a, "<i4")
    assert [r["neighbours"] for r in vecs.scan_ivecs(spark, path, 3).orderBy("qid").collect()] == a.tolist()
    assert vecs.scan_ivecs(spark, path, 3, k1=2).orderBy("qid").first()["neighbours"] == [9, 3]


def test_truncated_file_is_named(spark, tmp_path):
    path = write_vecs(tmp_path / "short", np.ones((3, 4), np.float32), "<f4")
    (tmp_path / "short").write_bytes((tmp_path / "short").read_bytes()[:-1])
    with pytest.raises(ValueError, match="short.*whole number"):
        vecs.scan_fvecs(spark, [path], 4)


def test_wrong_record_dimension_is_an_error(spark, tmp_path):
    # 2 records of 3 and 3 records of 1.67 would not fit; 4 x (4 + 2*4) = 3 x (4 + 3*4)
    path = write_vecs(tmp_path / "d", np.ones((4, 2), np.float32), "<f4")
    with pytest.raises(Exception, match="dimension 2, expected 3"):
        vecs.scan_fvecs(spark, [path], 3).collect()


def test_empty_file_gives_no_rows(spark, tmp_path):
    (tmp_path / "none").write_bytes(b"")
    assert vecs.scan_fvecs(spark, [str(tmp_path / "none")], 4).count() == 0


def test_parquet_columns_are_taken_by_position(spark, tmp_path):
    rows = spark.createDataFrame([(4, [1.5, 2.0], "x")], "anything int, `odd name` array<float>, extra string")
    rows.write.parquet(str(tmp_path / "p"))
    found = parquet.scan_parquet_vectors(spark, str(tmp_path / "p"), "double")
    assert dict(found.dtypes) == {"id": "bigint", "v": "array<double>"}
    assert found.first()["v"] == [1.5, 2.0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "extra" not in plan.split("ReadSchema")[1]


def test_parquet_neighbours_use_the_rows_own_list(spark, tmp_path):
    rows = spark.createDataFrame([(1, [7, 8, 9]), (0, [4, 5, 6])], "id long, neighbors_id array<long>").coalesce(1)
    rows.write.parquet(str(tmp_path / "n"))
    found = {r["qid"]: r["neighbours"] for r in parquet.scan_parquet_neighbours(spark, str(tmp_path / "n"), 2).collect()}
    assert found == {1: [7, 8], 0: [4, 5]}


def test_registry_declares_every_dataset(spark):
    df = registry.dataset_registry(spark)
    assert df.count() == 25 == len(registry.DATASETS)
    files = df.select("name", F.size("base_files").alias("n"), F.element_at("base_files", -1)["file"].alias("last"))
    by_name = {r["name"]: (r["n"], r["last"]) for r in files.collect()}
    assert by_name["siftsmall"] == (1, "siftsmall_base.fvecs")
    assert by_name["openai_large_5m_filter1"] == (10, "shuffle_train-09-of-10.parquet")
    assert by_name["laion_large_100m"] == (100, "train-99-of-100.parquet")
    filters = {
        r["name"]: r["filter_fields"][0]["value"]
        for r in df.where(F.size("filter_fields") > 0).collect()
    }
    assert len(filters) == 12
    assert filters["cohere_small_100k_filter1"] == "1000" and filters["cohere_large_10m_filter99"] == "9900000"
    assert filters["openai_small_50k_filter1"] == "500" and filters["openai_large_5m_filter99"] == "4950000"
    assert df.agg(F.sum("total_count")).first()[0] == 1_155_133_509


def test_get_dataset_by_name():
    found = registry.get_dataset("openai_small_50k_filter99")
    assert (found.gt_topk, found.dim, found.base_type, found.metric) == (500, 1536, "DOUBLE", "COSINE")
    assert found.truth_file == ("neighbors_tail_1p.parquet", 1000)
    assert registry.get_dataset("nothing") is None
    assert registry.get_dataset("glove").path("x") == "/opt/datasets/vecs/glove-100/x"
    assert registry.get_dataset("glove").at("/data").path("x") == "/data/x"


def test_declared_rows_must_add_up():
    good = registry.get_dataset("siftsmall")
    with pytest.raises(ValueError, match="files hold"):
        registry.replace(good, total_count=9)


def test_filter_predicate_joins_the_texts(spark):
    df = spark.range(20)
    fields = [("(", "id", "<", "3", ""), (" OR ", "id", ">=", "18", ")"), (" AND ", "id", "!=", "1", "")]
    assert [r[0] for r in df.where(registry.filter_predicate(fields)).collect()] == [0, 2, 18, 19]
    assert registry.filter_predicate([]) is None


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "array(cast(id as float)) v").write.parquet(str(tmp_path / "f"))
    rows = parquet.scan_parquet_vectors(spark, str(tmp_path / "f"))
    fields = registry.get_dataset("cohere_small_100k_filter1").filter_fields
    plan = rows.where(registry.filter_predicate(fields))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,1000)" in plan


def dataset(location, files, rows, dim=4):
    return registry.Dataset(
        location=str(location), name="own", format="FVECS", base_type="FLOAT", metric="L2",
        base_files=tuple(files), fields=(("id", "int"), ("embedding", f"vector({dim})")), vector_field="embedding",
        dim=dim, total_count=rows, query_file=("q", 1), truth_file=("t", 1), gt_topk=1,
    )


def test_validation_finds_what_is_wrong(spark, tmp_path):
    write_vecs(tmp_path / "a", np.ones((3, 4), np.float32), "<f4")
    declared = dataset(tmp_path, [("a", 3)], 3)
    good = registry.validate_dataset(registry.read_base(spark, declared), declared, files=True).collect()
    assert len(good) == 6 and all(r["ok"] for r in good)
    rows = spark.createDataFrame([(0, [1.0]), (1, None), (2, [1.0] * 5), (3, [1.0] * 4)], "id long, v array<float>")
    wrong = {r["check"]: r["actual"] for r in registry.validate_dataset(rows, declared).collect() if not r["ok"]}
    assert wrong == {"rows": 4, "null vectors": 1, "smallest dimension": 1, "largest dimension": 5}
    short = dataset(tmp_path, [("a", 4)], 4)
    checks = registry.validate_dataset(registry.read_base(spark, short), short, files=True)
    assert {r["check"] for r in checks.collect() if not r["ok"]} == {"rows", "bytes of a"}


def test_description_lists_declared_and_actual(spark, tmp_path):
    declared = dataset(tmp_path, [("a", 2), ("b", 1)], 3)
    rows = vectors(spark, np.ones((2, 4)))
    found = {r["property"]: (r["declared"], r["actual"]) for r in registry.describe_dataset(rows, declared).collect()}
    assert found["base_files"] == ("a:2,b:1", None)
    assert found["total_count"] == ("3", "2") and found["dim"] == ("4", "4")


def test_table_life(spark):
    tables.create_table(spark, "life", "id long, v array<float>")
    with pytest.raises(Exception, match="exists"):
        tables.create_table(spark, "life", "id long, v array<float>")
    rows = vectors(spark, np.ones((5, 2)), element="float")
    assert tables.load_table(rows, "life").count() == 5
    assert tables.load_table(rows.select("v", "id"), "life", partitions=2).count() == 10
    tables.truncate_table(spark, "life")
    assert spark.table("life").count() == 0
    tables.drop_table(spark, "life")
    tables.drop_table(spark, "life")
    assert not spark.catalog.tableExists("life")


def test_delimited_text_may_hold_spaces(spark, tmp_path):
    (tmp_path / "rows.txt").write_text("7 | [1.5,2.0]\n8|[0.25,-1]\n")
    found = {r["id"]: r["v"] for r in tables.read_delimited(spark, str(tmp_path / "rows.txt"), 2).collect()}
    assert found == {7: [1.5, 2.0], 8: [0.25, -1.0]}


def test_delimited_round_trip(spark, tmp_path):
    rows = vectors(spark, np.random.default_rng(1).normal(size=(50, 3)).astype(np.float32), element="float")
    tables.export_delimited(rows, str(tmp_path / "out"))
    assert sorted(tables.read_delimited(spark, str(tmp_path / "out"), 3).collect()) == sorted(rows.collect())
