"""Approximate nearest neighbours by largest inner product, with random-projection trees.

A forest of trees splits space by hyperplanes between random points. A query
walks all trees from one shared priority queue, nearest side first, until it has
enough candidates; those are ranked by exact inner product. Inner products become
distances on a sphere by one more coordinate, which brings all vectors to one length.
How many are enough is fitted to the recall of some queries whose exact answers are
sought first; where a walk would count every vector, one tree is read whole instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from vecspark.llm.support import ship_package, write_step

TREES = 10
#: The forest's hyperplanes are fitted on at most so many vectors; every vector is indexed.
SAMPLE_ROWS = 50_000
LEAF_ROWS = 1024
#: Least share of each tree's vectors that a query looks at, counted over all trees together. Many vectors of one
#: length without any clusters need this much for a recall of 0.9, clustered ones far less; lengths that differ
#: and small tables need more.
SEARCH_SHARE = 0.09
#: The mean recall of so many queries less three standard errors must reach this.
RECALL = 0.9
FIT_QUERIES = 256
#: A leaf is scored in parts of about so many rows and so many queries.
PART_ROWS = 4096
PART_QUERIES = 2048
#: The first leaves of a walk give each query a lower bound of its k-th score; the others emit only what reaches it.
FIRST_LEAVES = 8


@dataclass(frozen=True)
class Tree:
    normals: np.ndarray  # a row per inner node
    offsets: np.ndarray
    children: np.ndarray  # two per inner node; negative ones are leaves: -1 - leaf


@dataclass(frozen=True)
class Forest:
    trees: list[Tree]
    leaves: list[int]  # of each tree
    longest: float  # length of the longest vector

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors on a sphere: one more coordinate fills up the length of the longest."""
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0.0))
        return np.hstack([x, rest[:, None]]) / (self.longest or 1.0)

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each (lifted) vector in each tree."""
        out = np.empty((len(x), len(self.trees)), np.int32)
        for t, tree in enumerate(self.trees):
            at = np.zeros(len(x), np.int64) if len(tree.normals) else np.full(len(x), -1)
            while True:
                inner = np.flatnonzero(at >= 0)
                if not len(inner):
                    break
                node = at[inner]
                side = (np.einsum("ij,ij->i", x[inner], tree.normals[node]) > tree.offsets[node]).astype(int)
                at[inner] = tree.children[node, side]
            out[:, t] = -1 - at
        return out


def _grow(x: np.ndarray, rng: np.random.Generator, leaf_rows: int) -> tuple[Tree, int]:
    normals, offsets, children, leaves = [], [], [], 0
    stack = [(np.arange(len(x)), None)]
    while stack:
        rows, link = stack.pop()
        side = None
        if len(rows) > leaf_rows:
            for _ in range(5):
                a, b = x[rng.choice(rows, 2, replace=False)]
                normal = a - b
                norm = np.linalg.norm(normal)
                if norm == 0:
                    continue
                values = x[rows] @ (normal / norm)
                cut = float(np.median(values))
                side = values > cut
                if 0.05 < side.mean() < 0.95:
                    break
                side = None
        if side is None:
            code, leaves = -1 - leaves, leaves + 1
        else:
            code = len(normals)
            normals.append(normal / norm), offsets.append(cut), children.append([0, 0])
            stack += [(rows[~side], (code, 0)), (rows[side], (code, 1))]
        if link is not None:
            children[link[0]][link[1]] = code
    return Tree(np.array(normals).reshape(len(normals), x.shape[1]), np.array(offsets), np.array(children, int).reshape(-1, 2)), leaves


def grow_forest(x: np.ndarray, longest: float, trees: int, leaf_rows: int) -> Forest:
    empty = Forest([], [], longest)
    lifted = empty.lift(x)
    grown = [_grow(lifted, np.random.default_rng(1000 + t), leaf_rows) for t in range(trees)]
    return Forest([t for t, _ in grown], [n for _, n in grown], longest)


def walk(forest: Forest, q: np.ndarray, held: list[np.ndarray], wanted: int) -> list[tuple[int, int]]:
    """Leaves to look at: one queue over all trees, ordered by the worst margin on the way."""
    queue = [(-np.inf, t, 0 if len(tree.normals) else -1) for t, tree in enumerate(forest.trees)]
    margins = [tree.normals @ q - tree.offsets if len(tree.normals) else None for tree in forest.trees]
    heapq.heapify(queue)
    out, got = [], 0
    while queue and got < wanted:
        worst, t, node = heapq.heappop(queue)
        if node < 0:
            out.append((t, -1 - node))
            got += int(held[t][-1 - node])
            continue
        margin = margins[t][node]
        low, high = forest.trees[t].children[node]
        heapq.heappush(queue, (max(worst, margin), t, int(low)))
        heapq.heappush(queue, (max(worst, -margin), t, int(high)))
    return out


def counted_before(forest: Forest, q: np.ndarray, held: list[np.ndarray], leaves: np.ndarray) -> np.ndarray:
    """For vectors with these ``leaves`` (one per tree): what a walk has counted when it comes to the first of them."""
    before, got = [np.zeros(len(x), np.int64) for x in held], 0
    for t, leaf in walk(forest, q, held, 1 + sum(int(x.sum()) for x in held)):
        before[t][leaf] = got
        got += int(held[t][leaf])
    return np.min([before[t][leaves[:, t]] for t in range(len(held))], axis=0)


def enough(counted: list[np.ndarray], recall: float) -> int:
    """The least count at which the mean share found, less three standard errors, is ``recall``."""
    for wanted in np.unique(np.concatenate(counted)) + 1:
        shares = np.array([(x < wanted).mean() for x in counted])
        if shares.mean() - 3 * shares.std() / np.sqrt(len(shares)) >= recall:
            break
    return int(wanted)


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v array<double>)`` without vectors that are null, empty, zero or not finite throughout."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def nearest(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    trees: int = TREES,
    share: float = SEARCH_SHARE,
    leaf_rows: int = LEAF_ROWS,
    sample: int = SAMPLE_ROWS,
    recall: float = RECALL,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row with ``vec_id % every = 0`` its ``k`` nearest others.

    Nearness is the inner product of the original vectors in double precision, ties
    go to the smaller vec_id, a query is no candidate for itself. Vectors that are null, empty, zero, or hold
    a null or a non-finite number take no part, nor do rows without vec_id; of rows that repeat a vec_id
    the one with the smallest vector counts, element by element. Vectors of different lengths are an error. Fewer candidates than ``k`` give fewer rows, an empty
    table none.

    Of equal vectors only the ``k + 1`` with the smallest ids can be among the answers, so only they
    are indexed. Leaves are joined with the queries that visit them in parts of bounded size; each part gives its
    best ``k`` per query, and a window keeps the best of all.

    A query looks at ``share`` of each tree, at 50 ``k`` vectors per tree at least, and at more where
    ``recall`` needs it. As soon as that would be as many as there are vectors, the answers are exact.
    """
    ship_package(vectors.sparkSession)
    rows = write_step(usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("key", F.xxhash64("v")), "vectors")
    equal = W.partitionBy("key").orderBy("vec_id")
    base = write_step(rows.withColumn("nth", F.row_number().over(equal)).where(F.col("nth") <= k + 1).select("vec_id", "v"), "base")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, longest, least, most = base.agg(F.count("*"), F.max(norm), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if least != most:
        raise ValueError(f"vectors differ in dimension: {least} and {most}")
    fraction = sample / n
    drawn = base if fraction >= 1 else base.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(fraction * (1 << 30)))
    points = np.array([r["v"] for r in drawn.orderBy("vec_id").select("v").limit(sample).collect()])
    forest = grow_forest(points, float(longest), trees, max(leaf_rows, 1))
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                leaves = forest.route(forest.lift(_matrix(batch.column(1)))) if batch.num_rows else np.zeros((0, trees), np.int32)
                ends = pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * trees)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(leaves.ravel()))], ["vec_id", "v", "leaves"])

    placed = write_step(base.mapInArrow(place, "vec_id long, v array<double>, leaves array<int>"), "placed")
    posted = placed.select("vec_id", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = posted.groupBy("tree", "leaf").count().collect()  # bounded: the forest's leaves
    held = [np.zeros(m, np.int64) for m in forest.leaves]
    for r in sizes:
        held[r["tree"]][r["leaf"]] = r["count"]
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    wanted = int(max(50 * k * trees, share * n * trees))
    if wanted < n:
        wanted = max(wanted, _fitted(placed, queries, forest, held, k, recall))
    if wanted >= n:  # every vector is in each tree, so one is read whole
        wanted, forest = n, Forest(forest.trees[:1], forest.leaves[:1], forest.longest)
        shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                q, who, tree, leaf, turn = _matrix(batch.column(1)), [], [], [], []
                for i, x in enumerate(_directions(q)):
                    for nth, (t, f) in enumerate(walk(forest, x, held, wanted)):
                        who.append(i), tree.append(t), leaf.append(f), turn.append(nth)
                taken = batch.column(0).take(pa.array(who, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), pa.array(turn, pa.int32())], ["query_id", "tree", "leaf", "turn"])

    visits = write_step(queries.mapInArrow(visit, "query_id long, tree int, leaf int, turn int"), "visits")
    return _answers(placed, queries, visits, k)


def _directions(q: np.ndarray) -> np.ndarray:
    return np.hstack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))])


def _fitted(placed: DataFrame, queries: DataFrame, forest: Forest, held: list[np.ndarray], k: int, recall: float) -> int:
    """How many vectors a walk must count for ``recall``, by the exact answers of ``FIT_QUERIES`` queries."""
    some = write_step(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(FIT_QUERIES), "some")
    whole = some.select("query_id", F.lit(0).alias("tree"), F.explode(F.sequence(F.lit(0), F.lit(forest.leaves[0] - 1))).alias("leaf"))
    best = _best(_ranked(placed, some.withColumn("bound", F.lit(float("-inf"))), whole, k), k)
    answers = write_step(best.select("query_id", "vec_id"), "exact")
    found: dict[int, list] = {}
    for r in placed.select("vec_id", "leaves").join(F.broadcast(answers), "vec_id").select("query_id", "leaves").collect():  # k per query
        found.setdefault(r["query_id"], []).append(r["leaves"])
    asked = [r for r in some.collect() if r["query_id"] in found]
    if not asked:
        return 0
    directions = _directions(np.array([r["q"] for r in asked]))
    return enough([counted_before(forest, x, held, np.array(found[r["query_id"]])) for r, x in zip(asked, directions)], recall)


def _answers(placed: DataFrame, queries: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    none = F.lit(float("-inf"))
    first = write_step(_ranked(placed, queries.withColumn("bound", none), visits.where(F.col("turn") < FIRST_LEAVES), k), "first")
    bounds = _best(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    bounded = queries.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", none))
    return _best(first.unionByName(_ranked(placed, bounded, visits.where(F.col("turn") >= FIRST_LEAVES), k)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _ranked(placed: DataFrame, queries: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: of each visited leaf part the best ``k`` for a query that reach its bound."""
    posted = placed.select("vec_id", "v", F.posexplode("leaves").alias("tree", "leaf"))
    parts = posted.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    asked = visits.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / PART_QUERIES).alias("shares"))
    cuts = F.broadcast(write_step(parts.join(asked, ["tree", "leaf"]), "cuts"))  # a row per leaf of the forest
    key = ["tree", "leaf", "part", "share"]
    left = (
        posted.join(cuts, ["tree", "leaf"])
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares").cast("int") - 1)))
        .select(*key, "vec_id", "v")
    )
    right = (
        visits.join(queries, "query_id")
        .join(cuts, ["tree", "leaf"])
        .withColumn("share", F.pmod(F.xxhash64("query_id"), "shares").cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select(*key, "query_id", "q", "bound")
    )

    def rank(points: pa.Table, asked: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        out_q, out_v, out_s = [none], [none], [np.zeros(0)]
        if points.num_rows and asked.num_rows:
            points = points.sort_by("vec_id")
            ids = points["vec_id"].to_numpy()
            base = _matrix(points["v"].combine_chunks())
            who, q, least = asked["query_id"].to_numpy(), _matrix(asked["q"].combine_chunks()), asked["bound"].to_numpy()
            reach = np.sqrt((base * base).sum(1).max())
            for at in range(0, len(q), 256):
                block = q[at : at + 256]
                rough = block @ base.T
                rough[who[at : at + 256, None] == ids[None, :]] = -np.inf
                kept = min(k, len(ids))
                bound = np.maximum(np.partition(rough, len(ids) - kept, axis=1)[:, len(ids) - kept], least[at : at + 256])
                slack = 1e-12 * reach * np.sqrt((block * block).sum(1))  # far above the product's rounding
                i, j = np.nonzero((rough >= (bound - slack)[:, None]) & np.isfinite(rough))
                exact = (block[i] * base[j]).sum(1)
                order = np.lexsort((ids[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.searchsorted(i, i)
                best = np.arange(len(i)) - first < k
                out_q.append(who[at + i[best]]), out_v.append(ids[j[best]]), out_s.append(exact[best])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rank, "query_id long, vec_id long, score double")
