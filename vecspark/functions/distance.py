"""Distances as Column expressions: smaller means nearer, arithmetic in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from vecspark.functions import kernels

WORD_BITS = 32


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _doubles(c) -> Column:
    return _col(c).cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def l1(v, q) -> Column:
    """Manhattan distance."""
    return _total(F.zip_with(_doubles(v), _doubles(q), lambda x, y: F.abs(x - y)))


def l2(v, q) -> Column:
    """Euclidean distance."""
    return F.sqrt(_total(F.zip_with(_doubles(v), _doubles(q), lambda x, y: (x - y) * (x - y))))


def neg_ip(v, q) -> Column:
    """Inner product, negated so that a larger product is nearer."""
    return F.lit(0.0) - _dot(_doubles(v), _doubles(q))


def cosine_distance(v, q) -> Column:
    """One minus cosine similarity; NaN when either vector is all zero."""
    a, b = _doubles(v), _doubles(q)
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(
        F.greatest(1.0 - _dot(a, b) / norms, F.lit(0.0))
    )


def _popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w)).cast("double")


def hamming(b1, b2) -> Column:
    """Number of differing bits of two packed bit vectors."""
    return _popcount(F.zip_with(_col(b1), _col(b2), lambda x, y: x.bitwiseXOR(y)))


def jaccard(b1, b2) -> Column:
    """One minus shared bits over all set bits; 0 when both are empty."""
    both = _popcount(F.zip_with(_col(b1), _col(b2), lambda x, y: x.bitwiseAND(y)))
    either = _popcount(F.zip_with(_col(b1), _col(b2), lambda x, y: x.bitwiseOR(y)))
    return F.when(either == 0, F.lit(0.0)).otherwise(1.0 - both / either)


_EXPRESSIONS = {
    "l1": l1,
    "l2": l2,
    "ip": neg_ip,
    "cosine": cosine_distance,
    "hamming": hamming,
    "jaccard": jaccard,
}


def distance(metric: str, v, q) -> Column:
    """Distance under a named metric; an unknown name is an error."""
    return _EXPRESSIONS[kernels.check_metric(metric)](v, q)


def binarize(v) -> Column:
    """Sign bits of a vector, packed little-end first, 32 to a BIGINT word."""
    v = _col(v)
    words = F.ceil(F.size(v) / WORD_BITS).cast("int")
    bits = F.transform(
        v, lambda x, i: F.when(x > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    )
    return F.transform(
        F.sequence(F.lit(0), words - 1),
        lambda w: F.aggregate(
            F.transform(
                F.slice(bits, w * WORD_BITS + 1, WORD_BITS),
                lambda bit, i: F.call_function("shiftleft", bit, i),
            ),
            F.lit(0).cast("bigint"),
            lambda acc, x: acc + x,
        ),
    )


def pair_distance(metric: str):
    """Distance of two array columns of one row, computed by Arrow batch."""
    kernels.check_metric(metric)

    @F.arrow_udf(DoubleType())
    def pairwise(v, q):
        import pyarrow as pa

        if not len(v):
            return pa.array([], pa.float64())
        kind = kernels.exact_type(metric)
        a = kernels.as_matrix(v).astype(kind)
        b = kernels.as_matrix(q).astype(kind)
        return pa.array(kernels.paired(metric, a, b), pa.float64(), from_pandas=False)

    return pairwise
