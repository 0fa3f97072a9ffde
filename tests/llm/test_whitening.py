import math

import numpy as np
import pytest

from trackweave.llm.whitening import deviations, exact_products, jacobi, squared, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def brute(vectors, k=32):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)) + 1_000_000
    n = len(x)
    centred = x - x.mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    ints = [[int(v) for v in row] for row in x]
    s = [sum(c) for c in zip(*ints)]
    deviation = [sum((n * v - t) ** 2 for v, t in zip(row, s)) for row in ints]
    return n, deviation, centred @ directions[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(rows, vectors, ids):
    n, deviation, want, explained = brute(vectors)
    k = want.shape[1]
    got = {}
    for r in rows:
        got[r.vec_id, r.component] = r
    assert len(rows) == len(got) == len(ids) * k
    table = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i in ids])
    signs = np.sign((table * want).sum(axis=0))
    assert np.abs(table * signs - want).max() < 1e-6
    for at, i in enumerate(ids):
        assert all(got[i, c].deviation == deviation[at] and got[i, c].n == n for c in range(1, k + 1))
    assert all(math.isclose(got[ids[0], c].explained, explained[c - 1], rel_tol=1e-9) for c in range(1, k + 1))
    assert {r.identity_error for r in rows}.pop() < 1e-9 and len({r.identity_error for r in rows}) == 1
    assert np.abs(np.cov(table.T, bias=True) - np.eye(k)).max() < 1e-9


def test_table_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    check(whiten(df.repartition(5)).collect(), [r.embedding for r in rows], [r.vec_id for r in rows])


def test_rows_without_a_vector_go_and_others_stay(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=5).tolist(), None, "c") for i in range(60)]
    bad = [(100, None, 1, "c"), (101, [], 1, "c"), (102, [1.0, None, 2.0, 3.0, 4.0], 1, "c"), (103, [float("nan")] * 5, 1, "c"), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1, "c"), (105, [1.0, 2.0], 1, "c"), (106, [1e30, 0.0, 0.0, 0.0, 0.0], 1, "c")]
    df = spark.createDataFrame(good + bad, SCHEMA)
    vectors = [[float(np.float32(v)) for v in g[1]] for g in good]
    check(whiten(df).collect(), vectors, [g[0] for g in good])


def test_repeated_and_null_ids_come_back(spark):
    rng = np.random.default_rng(4)
    rows = [(1 if i < 10 else None, rng.normal(size=3).tolist(), 0, "c") for i in range(20)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).groupBy("vec_id").count().collect()
    assert {r.vec_id: r["count"] for r in got} == {1: 30, None: 30}


def test_empty_equal_and_single_vectors_have_no_component(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(i, [1.0, 2.0], 0, "c") for i in range(5)], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, None, 0, "c")], SCHEMA)).count() == 0


def test_dependent_dimensions_leave_out_the_empty_direction(spark):
    rows = [(i, [float(i % 7), float(i % 7), float(i % 3)], 0, "c") for i in range(50)]
    assert {r.component for r in whiten(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 2}


@pytest.mark.parametrize("size", [1, 2, 17, 64])
def test_rotations_keep_small_eigenvalues(size):
    rng = np.random.default_rng(size)
    basis, _ = np.linalg.qr(rng.normal(size=(size, size)))
    want = np.logspace(4, -4, size)
    values, directions = jacobi(basis @ np.diag(want) @ basis.T)
    assert np.allclose(values, want, rtol=1e-7)
    assert np.abs(directions.T @ directions - np.eye(size)).max() < 1e-12


def test_graded_matrix_to_full_precision():
    # Scaled diagonally dominant: rotations find every eigenvalue to many digits, however small.
    d = np.diag([1.0, 1e-6, 1e-12])
    core = np.array([[1, 0.1, 0.2], [0.1, 1, 0.1], [0.2, 0.1, 1]])
    values, _ = jacobi(d @ core @ d)
    assert math.isclose(np.prod(values), np.linalg.det(core) * 1e-36, rel_tol=1e-9)


def test_wide_whole_numbers_stay_exact():
    x = np.array([[2**40, -3], [5, 2**41]], dtype=np.int64)
    assert exact_products(x).tolist() == [[2**80 + 25, -3 * 2**40 + 5 * 2**41], [-3 * 2**40 + 5 * 2**41, 9 + 2**82]]
    assert deviations(x, 2**30, [7, 9]).tolist() == [[2**70 - 7, -3 * 2**30 - 9], [5 * 2**30 - 7, 2**71 - 9]]
    assert squared(np.array([[2**31, 1], [2**32, 0]])) == [2**62 + 1, None]
