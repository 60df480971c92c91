import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tests.conftest import brute
from vecspark.functions import kernels


def run(metric, base, queries, k, batches, dtype=np.float64, bound=None):
    block = kernels.QueryBlock(metric, np.arange(len(queries)), queries)
    best = kernels.TopK(len(queries), k, bound)
    for ids in np.array_split(np.arange(len(base)), batches):
        kernels.scan_block(best, block, np.arange(len(queries)), ids, base[ids].astype(dtype))
        best.settle()
    q, ids, d = best.result()
    found = {n: [] for n in range(len(queries))}
    for i in range(len(q)):
        found[int(q[i])].append(int(ids[i]))
    return found


@settings(max_examples=60, deadline=None)
@given(
    metric=st.sampled_from(kernels.METRICS),
    rows=st.integers(1, 60),
    k=st.integers(1, 20),
    batches=st.integers(1, 5),
    copies=st.booleans(),
    seed=st.integers(0, 1000),
)
def test_scan_equals_full_sort(metric, rows, k, batches, copies, seed):
    rng = np.random.default_rng(seed)
    if metric in kernels.BIT_METRICS:
        base = rng.integers(0, 8, (rows, 2))
    else:
        base = rng.normal(size=(rows, 6))
        base[rng.random(rows) < 0.1] = 0.0
    if copies:
        base[rng.random(rows) < 0.4] = base[0]
    queries = base[rng.integers(0, rows, 5)]
    assert run(metric, base, queries, k, batches, base.dtype) == brute(metric, base, queries, k)


@pytest.mark.parametrize("metric", ["l1", "l2", "ip", "cosine"])
def test_float32_screening_misses_nothing(metric):
    rng = np.random.default_rng(3)
    # far from the origin, so that float32 products cancel badly
    base = (1000 + rng.normal(size=(3000, 32))).astype(np.float32)
    base[1000:2000] = base[0]
    queries = base[:40].astype(np.float64)
    wanted = brute(metric, base.astype(np.float64), queries, 10)
    assert run(metric, base, queries, 10, 4, np.float32) == wanted


def test_bound_keeps_ties():
    base = np.array([[0.0], [1.0], [1.0], [1.0], [2.0]])
    queries = np.array([[0.0]])
    found = run("l2", base, queries, 3, 2, bound=np.array([1.0]))
    assert found == {0: [0, 1, 2]}


def test_huge_values_do_not_overflow_the_screen():
    base = np.array([[1e20, 0], [2e20, 0], [3e20, 0]])
    assert run("l2", base, base, 2, 1, np.float32)[2] == [2, 1]


def test_matrix_refuses_ragged_and_null():
    with pytest.raises(ValueError, match="dimension"):
        kernels.as_matrix(pa.array([[1.0], [1.0, 2.0]]))
    with pytest.raises(ValueError, match="null"):
        kernels.as_matrix(pa.array([[1.0], None]))
    with pytest.raises(ValueError, match="null"):
        kernels.as_matrix(pa.array([[1.0, None]]))


def test_cell_space_of_inner_product_ranks_like_the_product():
    rng = np.random.default_rng(1)
    base, queries = rng.normal(size=(200, 8)), rng.normal(size=(5, 8))
    norm = np.linalg.norm(base, axis=1).max()
    a = kernels.cell_space("ip", base, norm)
    b = kernels.cell_space("ip", queries, norm, query=True)
    for n in range(5):
        near = np.argsort(np.linalg.norm(a - b[n], axis=1))
        large = np.argsort(-(base @ queries[n]))
        assert near[:10].tolist() == large[:10].tolist()
