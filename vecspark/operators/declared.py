"""Indexes declared before there are rows: the definition is kept, the first load trains, later loads append."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from vecspark.functions import kernels
from vecspark.operators import graph, ivf
from vecspark.sources import tables

BUILD = {"ivf": ivf.ivf_build, "graph": graph.graph_build}
OPEN = {"ivf": ivf.ivf_open, "graph": graph.graph_open}
APPEND = {"ivf": ivf.ivf_append, "graph": graph.graph_append}
#: options of a build that name columns; an append needs them as well
COLUMNS = ("id_col", "vec_col")


def declare_index(spark: SparkSession, name: str, kind: str, metric: str = "l2", location: str | None = None, **options) -> None:
    """Keep the definition of an index of ``kind`` ivf or graph; ``options`` are those of its build (lists, m, ...).

    An index or a definition of that name is an error, and so is an option the build does not have.
    """
    if kind not in BUILD:
        raise ValueError(f"unknown kind of index {kind!r}; known: {', '.join(BUILD)}")
    kernels.check_metric(metric)
    unknown = set(options) - set(BUILD[kind].__kwdefaults__) - set(BUILD[kind].__code__.co_varnames[: BUILD[kind].__code__.co_argcount])
    if unknown or {"base", "name"} & set(options):
        raise ValueError(f"a build of {kind} has no option {', '.join(sorted(unknown or set(options)))}")
    if spark.catalog.tableExists(f"{name}_meta"):
        raise ValueError(f"there is an index {name} already")
    row = [(kind, metric, json.dumps(options), location)]
    definition = spark.createDataFrame(row, "kind string, metric string, options string, location string")
    tables.save(definition, f"{name}_definition", "errorifexists", location=location)


def load_index(rows: DataFrame, name: str):
    """Load ``rows`` into a declared index: the first load that has rows trains it, later ones append. Returns the index.

    None while nothing has been loaded. A first load that broke off left no meta table; its other
    tables are dropped and it starts anew.
    """
    spark = rows.sparkSession
    kept = spark.table(f"{name}_definition").first()
    options = json.loads(kept["options"])
    if spark.catalog.tableExists(f"{name}_meta"):
        index = OPEN[kept["kind"]](spark, name)
        if rows.isEmpty():
            return index
        return APPEND[kept["kind"]](index, rows, **{c: options[c] for c in COLUMNS if c in options})
    if rows.where(f"{options.get('vec_col', 'v')} IS NOT NULL").isEmpty():
        return None
    tables.drop_index(spark, name, keep=("definition",))
    return BUILD[kept["kind"]](rows, name, metric=kept["metric"], location=kept["location"], **options)
