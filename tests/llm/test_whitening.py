import numpy as np
import pytest
from pyspark.errors import PythonException

from lexloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>, id string, deviation int, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)


def expected(c):
    x = np.floor(64 * c) + 1e6
    d = x - x.mean(0)
    e, u = np.linalg.eigh(d.T @ d / len(d))
    return e[::-1], u[:, ::-1], d


def rows_of(df, k):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, [None] * k)[r.component - 1] = r
    return out


def test_against_eigendecomposition(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)  # several rounds of merging
    rng = np.random.default_rng(3)
    c = rng.normal(size=(300, 12)) * np.geomspace(30, 0.3, 12) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    e, u, d = expected(c)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(c)]).repartition(9)
    got = rows_of(whitening.component_rows(df, 5), 5)
    w = np.array([[r.whitened for r in got[i]] for i in range(300)])
    want = (d @ u / np.sqrt(e))[:, :5]
    assert np.allclose(w * np.sign((w * want).sum(0)), want, atol=1e-9)
    first = got[0]
    assert np.allclose([r.explained for r in first], e[:5] / e.sum(), rtol=1e-10)
    assert {r.n for v in got.values() for r in v} == {300} and {r.identity_error for v in got.values() for r in v} == {first[0].identity_error}
    assert first[0].identity_error < 1e-10
    x = (np.floor(64 * c) + 1e6).astype(int).astype(object)
    want = ((300 * x - x.sum(0)) ** 2).sum(1)
    assert [got[i][0].deviation for i in range(300)] == list(want)


def test_small_deviations_keep_their_digits():
    """Singular values over 12 orders of magnitude: the covariance has lost the small ones, the rotations have not."""
    rng = np.random.default_rng(5)
    sigma = np.geomspace(1e6, 1e-6, 10)
    u, v = np.linalg.qr(rng.normal(size=(40, 10)))[0], np.eye(10)[rng.permutation(10)]
    got, vectors = whitening.jacobi_svd(np.linalg.qr(u * sigma @ v, mode="r"))
    assert np.allclose(got, sigma, rtol=1e-9)
    assert np.allclose(vectors.T @ vectors, np.eye(10), atol=1e-14)


@pytest.mark.parametrize("shape", [(1, 4), (3, 7), (5, 1), (6, 2)])
def test_fewer_vectors_than_dimensions(spark, shape):
    c = np.random.default_rng(1).normal(size=shape)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(c)])
    got = rows_of(whitening.component_rows(df, 32), shape[1])
    assert len(got) == shape[0] and all(len(v) == shape[1] for v in got.values())
    varied = min(shape[0] - 1, shape[1])
    for v in got.values():
        assert [r.whitened is not None for r in v] == [i < varied for i in range(shape[1])]
        assert v[0].identity_error < 1e-9


def test_rows_left_out_and_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (None, [0.5, -3.0]), (1, [1.0, 2.0]), (4, [9.0, 1.0])]
    bad = [(5, None), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [1.0, -inf]), (9, []), (10, [1.0, 2.0, 3.0])]
    rows = whitening.component_rows(frame(spark, good + bad), 32).collect()
    assert sorted(str(r.id) for r in rows) == sorted(str(i) for i, _ in good for _ in range(2)) and {r.n for r in rows} == {4}
    assert whitening.component_rows(frame(spark, bad[:5]), 32).count() == 0
    assert whitening.component_rows(frame(spark, []), 32).count() == 0
    same = whitening.component_rows(frame(spark, [(i, [2.0, 2.0]) for i in range(3)]), 32).collect()
    assert {(r.whitened, r.deviation, r.explained, r.identity_error) for r in same} == {(None, 0, 0.0, 0.0)}


def test_beyond_longs(spark):
    big = whitening.component_rows(frame(spark, [(1, [1e13]), (2, [-1e13]), (3, [0.0])]), 1).collect()
    assert {r.id: r.deviation for r in big} == {1: None, 2: None, 3: 0}
    with pytest.raises(PythonException, match="beyond 2"):
        whitening.component_rows(frame(spark, [(1, [1e15])]), 1).collect()
