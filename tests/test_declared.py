import numpy as np
import pytest

from tests.conftest import as_queries, brute, listed, vectors
from vecspark.operators import declared, graph, ivf
from vecspark.sources import tables

POINTS = np.random.default_rng(51).normal(size=(240, 5))


@pytest.mark.parametrize("kind, options", [("ivf", dict(lists=6)), ("graph", dict(m=6, ef_construction=20))])
def test_loads_after_the_declaration(spark, tmp_path, kind, options):
    base, name = vectors(spark, POINTS), f"declared_{kind}"
    declared.declare_index(spark, name, kind, location=str(tmp_path), **options)
    assert declared.load_index(base.where("id < 0"), name) is None
    declared.load_index(base.where("id < 100"), name)
    index = declared.load_index(base.where("id >= 100"), name)
    assert declared.load_index(base.limit(0), name) == index
    found = ivf.ivf_search(index, as_queries(base), 5, 6) if kind == "ivf" else graph.graph_search(index, as_queries(base), 5, 240)
    assert listed(found) == brute("l2", POINTS, POINTS, 5)
    with pytest.raises(ValueError, match="already"):
        declared.declare_index(spark, name, kind)
    tables.drop_index(spark, name)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(name)]


def test_a_first_load_that_broke_off_starts_anew(spark, monkeypatch):
    base = vectors(spark, POINTS)
    declared.declare_index(spark, "declared_broken", "ivf", lists=4)
    save = tables.save
    monkeypatch.setattr(ivf.tables, "save", lambda df, table, *a, **k: 1 / 0 if table.endswith("_meta") else save(df, table, *a, **k))
    with pytest.raises(ZeroDivisionError):
        declared.load_index(base, "declared_broken")
    monkeypatch.setattr(ivf.tables, "save", save)
    index = declared.load_index(base, "declared_broken")
    assert listed(ivf.ivf_search(index, as_queries(base), 5, 4)) == brute("l2", POINTS, POINTS, 5)


def test_bad_declarations(spark):
    for bad in (dict(kind="tree"), dict(kind="ivf", metric="l7"), dict(kind="ivf", m=3), dict(kind="graph", name_="x")):
        with pytest.raises(ValueError):
            declared.declare_index(spark, "declared_bad", **bad)
