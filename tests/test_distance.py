import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import vectors
from vecspark.functions import distance as dist, kernels
from vecspark.functions.literals import from_vector_literal, to_vector_literal


@pytest.mark.parametrize("metric", kernels.METRICS)
def test_expression_equals_batch_kernel(spark, metric):
    rng = np.random.default_rng(5)
    bits = metric in kernels.BIT_METRICS
    a = rng.integers(0, 1 << 31, (30, 2)) if bits else rng.normal(size=(30, 9))
    element = "bigint" if bits else "double"
    rows = vectors(spark, a, element=element).withColumn("q", F.reverse("v"))
    found = rows.select(
        dist.distance(metric, "v", "q").alias("x"), dist.pair_distance(metric)("v", "q").alias("y")
    ).collect()
    assert len(found) == 30
    for row in found:
        assert row["x"] == pytest.approx(row["y"], abs=1e-12)


def test_float_columns_are_widened_first(spark):
    rows = spark.createDataFrame([([0.1], [0.2])], "v array<float>, q array<float>")
    expected = abs(float(np.float32(0.1)) - float(np.float32(0.2)))
    assert rows.select(dist.l1("v", "q")).first()[0] == expected


def test_zero_vector_has_nan_cosine(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "v array<double>, q array<double>")
    row = rows.select(dist.cosine_distance("v", "q").alias("x"), dist.pair_distance("cosine")("v", "q").alias("y")).first()
    assert math.isnan(row["x"]) and math.isnan(row["y"])


def test_empty_bit_sets_are_equal(spark):
    rows = spark.createDataFrame([([0], [0])], "v array<bigint>, q array<bigint>")
    assert rows.select(dist.jaccard("v", "q")).first()[0] == 0.0


def test_unknown_metric_is_an_error():
    with pytest.raises(ValueError, match="unknown metric"):
        dist.distance("manhattan", "v", "q")


@pytest.mark.parametrize("dim", [1, 31, 32, 33, 64, 70])
def test_binarize_packs_sign_bits(spark, dim):
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(5, dim))
    rows = vectors(spark, a).select("id", dist.binarize("v").alias("w")).collect()
    for row in rows:
        signs = a[row["id"]] > 0
        words = [sum(1 << i for i, s in enumerate(signs[lo:lo + 32]) if s) for lo in range(0, dim, 32)]
        assert row["w"] == words


def test_literal_round_trip_is_exact(spark):
    rng = np.random.default_rng(2)
    a = np.float32(rng.normal(size=(200, 7)) * 10.0 ** rng.integers(-20, 20, (200, 7)))
    rows = vectors(spark, a, element="float")
    back = rows.select("v", from_vector_literal(to_vector_literal("v"), 7).alias("w"))
    assert back.where(F.col("v") != F.col("w")).count() == 0
    assert rows.select(to_vector_literal(F.array(F.lit(1.5), F.lit(-2.0)))).first()[0] == "[1.5,-2.0]"


def test_literal_of_wrong_size_is_an_error(spark):
    rows = spark.createDataFrame([("[1,2]",)], "t string")
    assert rows.select(from_vector_literal("t", 2)).first()[0] == [1.0, 2.0]
    with pytest.raises(Exception, match="expected 3 dimensions"):
        rows.select(from_vector_literal("t", 3)).collect()
