"""The same query set under several search settings, and over several builds of an index."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from vecspark.operators import declared, evaluate, graph, ivf
from vecspark.session import write_step
from vecspark.sources import tables


@dataclass(frozen=True)
class Build:
    """An index to build: ``kind`` ivf or graph, ``options`` of that build, ``settings`` to search it with."""

    label: str
    kind: str
    options: dict = field(default_factory=dict)
    settings: tuple[int, ...] = (1,)


class BuildSweep(NamedTuple):
    recalls: DataFrame
    builds: DataFrame


def search(index, queries: DataFrame, k: int, setting: int | None = None, predicate=None) -> DataFrame:
    """Approximate search; ``setting`` is ``probes`` or ``ef_search`` by kind of index."""
    knob = {} if setting is None else {"probes" if isinstance(index, ivf.IvfIndex) else "ef_search": setting}
    run = ivf.ivf_search if isinstance(index, ivf.IvfIndex) else graph.graph_search
    return run(index, queries, k, predicate=predicate, **knob)


def sweep(
    index,
    queries: DataFrame,
    truth: DataFrame,
    settings: list[int],
    gt_topk: int,
    k1: int | None = None,
    k2: int | None = None,
    predicate=None,
) -> DataFrame:
    """``(setting, qid, correct, recall)`` for every setting and query."""
    k1, k2 = evaluate.check_topk(gt_topk, k2, k1)
    tagged = [
        search(index, queries, k2, s, predicate).withColumn("setting", F.lit(int(s))) for s in settings
    ]
    answers = reduce(DataFrame.unionByName, tagged)
    return evaluate.recall(answers, truth, gt_topk, k1, k2, ("setting", [int(s) for s in settings]))


def sweep_summary(recalls: DataFrame, percentages=()) -> DataFrame:
    """``([build,] setting, statistic, value)`` of the recalls of a sweep."""
    keys = [c for c in ("build", "setting") if c in recalls.columns]
    return evaluate.recall_summary(recalls, percentages, keys)


def sweep_builds(
    base: DataFrame,
    queries: DataFrame,
    truth: DataFrame,
    builds: list[Build],
    gt_topk: int,
    k1: int | None = None,
    k2: int | None = None,
    predicate=None,
    *,
    name: str,
    metric: str = "l2",
    location: str | None = None,
) -> BuildSweep:
    """``recalls (build, setting, qid, correct, recall)`` of every build, setting and query, and what each build took:
    ``builds (build, kind, options, lists, seconds, bytes)``.

    Indexes are built one at a time as ``<name>_<number>``; the scores of one are written before its index is
    dropped, so no more than one is stored, and none if a search fails. Two builds of one label, a kind that is
    unknown, a build without settings or a name in use are errors before anything is built.
    """
    k1, k2 = evaluate.check_topk(gt_topk, k2, k1)
    labels = [b.label for b in builds]
    if not builds or len(set(labels)) < len(labels):
        raise ValueError("builds must have labels of their own, and there must be one at least")
    for build in builds:
        if build.kind not in declared.BUILD:
            raise ValueError(f"unknown kind of index {build.kind!r}; known: {', '.join(declared.BUILD)}")
        if not build.settings:
            raise ValueError(f"build {build.label} has no settings")
    spark = base.sparkSession
    taken = [f"{name}_{n}" for n in range(len(builds)) if spark.catalog.tableExists(f"{name}_{n}_meta")]
    if taken:
        raise ValueError(f"there is an index {taken[0]} already")
    truth = write_step(truth, "truth")
    scored, facts = [], []
    for number, build in enumerate(builds):
        own = f"{name}_{number}"
        try:
            started = time.perf_counter()
            index = declared.BUILD[build.kind](base, own, metric=metric, location=location, **build.options)
            seconds = time.perf_counter() - started
            found = sweep(index, queries, truth, list(build.settings), gt_topk, k1, k2, predicate)
            scored.append(write_step(found.select(F.lit(build.label).alias("build"), "*"), "swept"))
            stored = tables.index_bytes(spark, own)
            facts.append((build.label, build.kind, json.dumps(build.options, sort_keys=True), index.lists, seconds, stored))
        finally:
            tables.drop_index(spark, own)
    schema = "build string, kind string, options string, lists int, seconds double, bytes long"
    return BuildSweep(reduce(DataFrame.unionByName, scored), spark.createDataFrame(facts, schema))
