import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from vecspark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score double, rank string"


def documents(spark, rows, partitions=3):
    """With extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], SCHEMA).repartition(partitions)


def features(text, longest):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def brute(rows, target, percent=10, least=20, seed=2024, buckets=10_000, longest=1):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    held, wanted = collections.Counter(), collections.Counter()
    for _, text in rows:
        held.update(map(bucket, features(text, longest)[0]))
    for text in target:
        wanted.update(map(bucket, features(text, longest)[0]))
    S, T = sum(held.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (S + buckets) / ((held[b] + 1) * (T + buckets)))) for b in range(buckets)]
    found = []
    for i, text in rows:
        own, n_words = features(text, longest)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([i, len(own), weight, score, None, n_words])
    able = sorted((r for r in found if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, row in enumerate(able[: percent * len(able) // 100], start=1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in found), key=repr)


def texts(seed, n):
    rng = np.random.default_rng(seed)
    return [" ".join(f"W{x}" for x in rng.zipf(1.4, rng.integers(1, 120)) % 3000) for _ in range(n)]


EDGE = [
    (None, "a b c " * 20), (None, None), (1, None), (2, ""), (3, " -- \t"), (4, "one"), (4, "one"), (5, "x " * 70_000),
    (6, "é Ü ß 東京 x1y2 A-B_C" * 30), (7, "a" * 2_500_000 + " b"), (8, "same " * 25), (8, "same " * 25), (8, "other " * 25),
]


@pytest.mark.parametrize("options", [{}, dict(percent=50, least=3, buckets=97, longest=3), dict(percent=100, least=0)])
def test_resampling_equals_brute_force(spark, options):
    rows = EDGE + list(enumerate(texts(1, 400), start=10))
    target = texts(2, 20) + ["same one two", None, ""]
    named = {"least_words" if k == "least" else k: v for k, v in options.items()}
    target_rows = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(documents(spark, rows), target_rows, **named)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, target, **options)


def test_small_blocks_and_slices(spark, monkeypatch):
    for name, value in dict(BLOCK=3, SLICE_BYTES=17, REMEMBERED=5, BROADCAST_IDS=0, BAND=2).items():
        monkeypatch.setattr(importance, name, value)
    rows = list(enumerate(texts(5, 60)))
    target = texts(6, 5)
    target_rows = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(documents(spark, rows), target_rows, longest=2)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, target, longest=2)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(documents(spark, [], 1), none).collect() == []
    rows = list(enumerate(texts(7, 30)))
    assert sorted((tuple(r) for r in importance.resample(documents(spark, rows), none).collect()), key=repr) == brute(rows, [])


def test_planes_give_exact_sums():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 70_000, (9, 130)).astype(np.int32) * (rng.random((9, 130)) < 0.3)
    gain = rng.integers(-20_000, 20_000, 130)
    assert importance.GainPlanes(gain).sums(counts).tolist() == (counts.astype(np.int64) @ gain).tolist()
    assert importance.GainPlanes(np.zeros(130, np.int64)).sums(counts).tolist() == [0] * 9
