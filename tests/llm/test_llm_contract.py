"""Every training-data entry has SQL, or is named with the test that computes it a second way."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
import check
from vecspark.llm import queries

FOLDER = contract.SMOKE_DIR
#: entry without SQL -> test
TESTED = {
    "op1_quality_classifier": "test_llm_operators.py",
    "op2_minhash_near_dedup": "test_near_duplicates_equal_brute_force",
    "op3_nearest_neighbours": "test_llm_operators.py",
    "op4_source_mixing": "test_llm_operators.py",
    "op6_packed_tokens": "test_llm_operators.py",
    "op8_pii_pseudonyms": "test_llm_operators.py",
    "op9_language_id": "test_llm_operators.py",
    "op10_substring_dedup": "test_llm_operators.py",
    "pipeline": "test_llm_operators.py",
}


def test_every_entry_has_sql_or_a_test():
    assert set(queries.queries()) == set(queries.oracle_sql()) | set(TESTED)
    assert not set(queries.oracle_sql()) & set(TESTED)
    assert set(queries.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["op5_chat_formatting", "op11_warc", "op13_centroid_clustering"])
def test_entry_equals_sql(spark, name):
    ok, note = check.compare(spark, check.connect(FOLDER), FOLDER, name)
    assert ok, note


def test_sql_runs_on_empty_tables():
    db = duckdb.connect()
    for path in glob.glob(os.path.join(FOLDER, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}' WHERE false")
    for sql in queries.oracle_sql().values():
        assert db.execute(sql).fetchall() == []
