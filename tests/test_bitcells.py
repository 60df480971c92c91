import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_queries, brute, listed, mean_recall, vectors
from vecspark.functions import kernels
from vecspark.operators import bitcells, graph, ivf, knn

RNG = np.random.default_rng(5)
HEARTS = RNG.integers(-(1 << 62), 1 << 62, (9, 3))


def noisy(n, flips=12):
    """Words near one of the hearts: some bits of each are flipped."""
    a = HEARTS[RNG.integers(0, len(HEARTS), n)].copy()
    for row in a:
        for bit in RNG.choice(3 * 63, flips, replace=False):
            row[bit // 63] ^= 1 << int(bit % 63)
    return a


WORDS = noisy(700)


def plain_rounds(rows, weights, centroids, metric, rounds):
    """The same rounds, one row and one bit at a time."""
    for _ in range(rounds):
        own = [min(range(len(centroids)), key=lambda c: (kernels.paired(metric, r, centroids[c]), c)) for r in rows]
        moved = centroids.copy()
        for c in range(len(centroids)):
            held = [(r, w) for r, w, o in zip(rows, weights, own) if o == c]
            if not held:
                continue
            total = sum(w for _, w in held)
            words = []
            for word in range(rows.shape[1]):
                value = 0
                for bit in range(64):
                    value |= (2 * sum(w for r, w in held if int(r[word]) >> bit & 1) > total) << bit
                words.append(value - (1 << 64) if value >> 63 else value)
            if metric == "hamming" or any(words):
                moved[c] = words
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


@pytest.mark.parametrize("metric", ["hamming", "jaccard"])
def test_word_distances_equal_the_plain_ones(metric):
    a, b = np.vstack([WORDS[:40], np.zeros((1, 3), np.int64), -np.ones((1, 3), np.int64)]), np.vstack([HEARTS, np.zeros((1, 3), np.int64)])
    found = kernels.word_distances(metric, a, b)
    mask = (1 << 64) - 1
    for i, row in enumerate(a):
        assert np.allclose(found[i], kernels.paired(metric, b, row))
        for j, other in enumerate(b):
            both = sum(((int(x) & int(y)) & mask).bit_count() for x, y in zip(row, other))
            either = sum(((int(x) | int(y)) & mask).bit_count() for x, y in zip(row, other))
            wanted = either - both if metric == "hamming" else 1 - both / either if either else 0
            assert np.isclose(found[i, j], wanted)


@pytest.mark.parametrize("metric", ["hamming", "jaccard"])
def test_training_equals_plain_rounds(spark, metric):
    a = np.vstack([WORDS[:120], np.repeat(WORDS[:1], 60, axis=0), -np.ones((1, 3), np.int64), np.zeros((2, 3), np.int64)])
    base = vectors(spark, a, element="bigint")
    hashes = base.select("v", F.xxhash64(F.lit(3), "v").alias("h")).distinct().orderBy("h", "v").limit(7)
    start = np.array([r["v"] for r in hashes.collect()], np.int64)
    distinct, counts = np.unique(a, axis=0, return_counts=True)
    wanted = plain_rounds(distinct, counts.tolist(), start, metric, 4)
    assert np.array_equal(bitcells.train(base.select("v"), 7, metric, 3, 4), wanted)


def test_no_more_cells_than_distinct_vectors(spark):
    base = vectors(spark, np.repeat(WORDS[:2], 10, axis=0), element="bigint")
    assert len(bitcells.train(base.select("v"), 8, "hamming", 1, 5)) == 2


def test_cells_follow_the_hearts(spark):
    """With one centroid a heart or more, rows lie as near to their centroid as to the word they come from."""
    base = vectors(spark, WORDS, element="bigint")
    centroids = bitcells.train(base.select("v"), 40, "hamming", 42, 10)
    assert kernels.word_distances("hamming", WORDS, centroids).min(axis=1).mean() <= 14


@pytest.mark.parametrize("metric", ["hamming", "jaccard"])
def test_lists_of_words(spark, metric):
    base = vectors(spark, WORDS, element="bigint")
    index = ivf.ivf_build(base, f"bits_{metric}", 24, metric)
    stored = spark.table(index.table("centroids"))
    assert stored.schema["c"].dataType.simpleString() == "array<bigint>"
    wanted = brute(metric, WORDS, WORDS, 8)
    assert listed(ivf.ivf_search(index, as_queries(base), 8, index.lists)) == wanted
    some = ivf.ivf_search(index, as_queries(base), 8, 6)
    assert listed(some) == listed(ivf.ivf_search(index, as_queries(base), 8, 6, broadcast_bytes=0, chunk_bytes=4000))
    assert mean_recall(listed(some), wanted) > 0.9
    ivf.ivf_append(index, vectors(spark, noisy(20), range(1000, 1020), element="bigint"))
    assert index.postings(spark).count() == 720


def test_two_levels_over_words(spark):
    base = vectors(spark, WORDS, element="bigint")
    index = ivf.ivf_build(base, "bits_levels", 30, "hamming", centroid_bytes=1000)
    assert index.coarse
    assert listed(ivf.ivf_search(index, as_queries(base), 8, index.lists)) == brute("hamming", WORDS, WORDS, 8)


@pytest.mark.parametrize("metric", ["hamming", "jaccard"])
def test_graph_of_words_over_many_cells(spark, metric):
    base = vectors(spark, WORDS[:250], element="bigint")
    net = graph.graph_build(base, f"bits_net_{metric}", 12, 40, metric, cell_rows=60)
    assert net.lists > 1 and net.centroids(spark)[1].dtype == np.int64
    found = graph.graph_search(net, as_queries(base), 8, 60).collect()
    reach = {r["qid"]: r["distance"] for r in knn.knn_join(base, as_queries(base), 8, metric).where("rank = 8").collect()}
    assert sum(r["distance"] <= reach[r["qid"]] for r in found) >= 0.95 * 8 * 250
