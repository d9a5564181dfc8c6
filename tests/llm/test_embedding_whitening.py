"""Whitening against a plain version with the library's eigensolver and Python integers."""

import math

import numpy as np
import pytest

from terrace.llm import embedding_whitening as whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, whitened string, n long"


def plain(rows):
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    lengths = [len(v) for _, v in kept]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k))
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in kept if len(v) == d]
    n, sums = len(kept), [sum(v[j] for _, v in kept) for j in range(d)]
    centred = np.array([[x - s / n for x, s in zip(v, sums)] for _, v in kept])
    covariance = centred.T @ centred / n
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1], vector[:, ::-1]
    z = centred @ vector / np.sqrt(np.maximum(value, 1e-300))
    return [i for i, _ in kept], [sum((n * x - s) ** 2 for x, s in zip(v, sums)) for _, v in kept], z, value, np.trace(covariance)


def compare(found, rows, k):
    ids, deviations, z, value, trace = plain(rows)
    assert len(found) == len(ids) * k
    assert {r["n"] for r in found} == {len(ids)} and {r["component"] for r in found} == set(range(1, k + 1))
    by = {(r["vec_id"], r["component"]): r for r in found}
    for c in range(k):
        mine = np.array([by[i, c + 1]["whitened"] for i in ids])
        sign = np.sign(mine @ z[:, c])
        assert np.allclose(mine, sign * z[:, c], atol=1e-7)
        assert all(abs(by[i, c + 1]["explained"] / (value[c] / trace) - 1) < 1e-9 for i in ids)
        assert [by[i, c + 1]["deviation"] for i in ids] == deviations
    assert max(r["identity_error"] for r in found) < 1e-9


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return [(i, [float(c) for c in rng.standard_normal(d) * rng.uniform(0.5, 1.5, d) * (1 + np.arange(d)[::-1])]) for i in range(n)]


@pytest.mark.parametrize("d", [3, 40])
def test_equal_to_the_plain_version(spark, d):
    rows = vectors(d, 300, d)
    rows += [(1000, None), (1001, []), (1002, [None] * d), (1003, [float("nan")] * d), (1004, [float("inf")] + [0.0] * (d - 1)), (1005, [1.0])]
    frame = spark.createDataFrame([(i, v, 1, 2, "w", None) for i, v in rows], SCHEMA).repartition(3)
    compare(whitening.whiten(frame).collect(), rows, min(d, 32))


def test_huge_entries_keep_exact_deviations(spark):
    rows = [(i, [float(v) for v in x]) for i, x in enumerate([(1e30, 1.0), (-2.0, 7.0), (3.0, 1.5)])]
    found = whitening.whiten(spark.createDataFrame([(i, v, 1, 2, "w", None) for i, v in rows], SCHEMA)).collect()
    assert {r["deviation"] for r in found} == {None}
    rows = [(i, [2.0**20 * i, float(i % 3)]) for i in range(9)]
    compare(whitening.whiten(spark.createDataFrame([(i, v, 1, 2, "w", None) for i, v in rows], SCHEMA)).collect(), rows, 2)


def test_few_repeated_and_no_vectors(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1, 2, "w", None) for i, v in rows], SCHEMA)
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(None, None)])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0])] * 5)).count() == 0
    two = whitening.whiten(make([(None, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0]), (2, [3.0, 2.0, 1.0])])).collect()
    assert {r["component"] for r in two} == {1} and len(two) == 3 and abs(two[0]["identity_error"]) < 1e-12


def test_splitting_finds_close_and_equal_eigenvalues():
    rng = np.random.default_rng(1)
    for values in ([5, 5, 5, 1], [1, 1 + 1e-9, 1 + 2e-9, 3, 0], np.linspace(1, 1.001, 30), [0, 0, 7], [1] * 6, 10.0 ** -np.arange(12.0)):
        q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
        a = (q * np.array(values, dtype=float)) @ q.T
        a = (a + a.T) / 2
        value, x = whitening.refine(a, whitening.eigenvectors(a))
        assert np.allclose(value, np.sort(values)[::-1], atol=1e-13) and np.allclose(x.T @ x, np.eye(len(values)), atol=1e-12)
        assert np.abs(a @ x - x * value).max() < 1e-13
    u = whitening.polar_factor(a - 0.3 * np.eye(12))
    assert np.allclose(u @ u, np.eye(12), atol=1e-13)
