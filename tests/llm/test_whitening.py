"""Operation 12 against floating-point decomposition, exact integers and another way to the polynomial."""

import math
import os

import numpy as np
import pytest

from stratalog.llm.exact_spectrum import Roots, combined, eigenvectors, is_prime, primes_for, residues
from stratalog.llm.whitening import SCALE, SHIFT, op12_embedding_whitening, sums, whiten

SF = "/root/testdata/sf0.001"


def polynomial(matrix):
    primes = primes_for(matrix)
    return combined(primes, residues(matrix, np.array(primes)).tolist())


def leverrier(matrix):
    """Faddeev and LeVerrier's recursion in exact integers."""
    d = len(matrix)
    m, c, one = np.zeros((d, d), object), [1], np.eye(d, dtype=int).astype(object)
    for k in range(1, d + 1):
        m = matrix @ m + c[-1] * one
        c.append(-int((matrix @ m).trace()) // k)
    return c


def scatter_of(x):
    y = x.astype(object)
    n, s = len(x), y.sum(0)
    return n * (y.T @ y) - s[:, None] * s[None, :]


@pytest.mark.parametrize("d", [1, 2, 3, 6, 9])
def test_polynomial_is_exact(d):
    m = scatter_of(np.random.default_rng(d).integers(-50_000, 50_000, (2 * d, d)))
    assert polynomial(m) == leverrier(m)


@pytest.mark.parametrize("m", [np.diag([5, 5, 5, 2, 0, 0]), np.zeros((3, 3), int), np.array([[4, 2, 0], [2, 1, 0], [0, 0, 9]]), np.full((4, 4), 7)])
def test_equal_and_missing_roots(m):
    m = m.astype(object)
    assert polynomial(m) == leverrier(m)
    roots = Roots(polynomial(m)).largest(8)
    want = [w for w in sorted(np.linalg.eigvalsh(m.astype(float)), reverse=True) if w > 1e-9]
    assert np.allclose([float(r) for r in roots], want)
    axes = eigenvectors(m, roots)
    assert np.allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-14)
    for r, v in zip(roots, axes, strict=True):
        assert np.allclose(m.astype(float) @ v, float(r) * v, atol=1e-9)


def test_close_roots_keep_their_vectors():
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(6, 6)))
    m = np.array([[round(x) for x in row] for row in (q * np.array([1e14, 1e14 + 3, 1e9, 5, 4, 3]) @ q.T).tolist()], object)
    m = m + m.T
    c = leverrier(m)
    if any((x < 0) != (k % 2 == 1) for k, x in enumerate(c) if x):  # rounding may leave it indefinite
        m = m + 100 * np.eye(6, dtype=int).astype(object)
    roots = Roots(polynomial(m)).largest(2)
    axes = eigenvectors(m, roots)
    scaled = [[sum(int(m[i, j]) * v[j] for j in range(6)) / float(r) - v[i] for i in range(6)] for r, v in zip(roots, axes, strict=True)]
    assert float(roots[0] - roots[1]) > 0 and np.abs(scaled).max() < 1e-13 and abs(axes[0] @ axes[1]) < 1e-15


def test_primes():
    assert [n for n in range(2, 60) if is_prime(n)] == [n for n in range(2, 60) if all(n % k for k in range(2, n))]


def brute(rows):
    kept = [(k, [math.floor(SCALE * float(c)) + SHIFT for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], float)
    n, s = len(kept), [sum(v[d] for _, v in kept) for d in range(x.shape[1])]
    y = x - x.mean(0)
    w, axes = np.linalg.eigh(y.T @ y / n)
    w, axes = w[::-1], axes.T[::-1]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for _, v in kept]
    return [k for k, _ in kept], n, deviation, y @ axes[:8].T / np.sqrt(w[:8]), w / w.sum()


def held(rows, got):
    keys, n, deviation, white, explained = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
        assert r["n"] == n and r["identity_error"] <= 1e-4
    assert sorted(by) == sorted(keys)
    for c in range(white.shape[1]):
        mine = np.array([by[k][c + 1]["whitened"] for k in keys])
        assert min(np.abs(mine - white[:, c]).max(), np.abs(mine + white[:, c]).max()) < 1e-6
        assert abs(by[keys[0]][c + 1]["explained"] / explained[c] - 1) < 1e-9
    assert [by[k][1]["deviation"] for k in keys] == deviation


SCHEMA = "vec_id long, embedding array<float>, i string, n string, component string"


def test_against_floating_point(spark):
    r = np.random.default_rng(5)
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(r.normal(size=(300, 10)) * np.arange(1, 11) + 7)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 9 + [None]), (1003, [float("nan")] * 10), (1004, [float("inf")] + [0.0] * 9), (1005, [1.0] * 9)]
    df = spark.createDataFrame([(k, v, "x", "y", "z") for k, v in rows], SCHEMA).repartition(5)
    held([x for x in rows if x[0] != 1005], whiten(df).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    held(rows, op12_embedding_whitening(spark, SF).collect())


def test_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame([(k, v, None, None, None) for k, v in rows], SCHEMA)
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None), (None, [])]):
        assert whiten(frame(rows)).collect() == []
    # One direction only; null and repeated ids count one by one.
    got = whiten(frame([(None, [0.0, 1.0]), (7, [2.0, 1.0]), (7, [4.0, 1.0])])).collect()
    assert len(got) == 3 and {r["component"] for r in got} == {1} and got[0]["explained"] == 1.0
    assert sorted(round(abs(r["whitened"]), 6) for r in got) == [0.0, 1.224745, 1.224745] and {r["deviation"] for r in got} == {0, 6144**2}
    # Equal variances: any basis, but whitened all the same.
    got = whiten(frame([(k, [float(k % 2), float(k // 2 % 2)]) for k in range(8)])).collect()
    assert len(got) == 16 and got[0]["identity_error"] < 1e-9


def test_very_large_entries(spark):
    rows = [(k, [1e30 * (-1) ** k, 1e6 * k]) for k in range(4)]
    df = spark.createDataFrame([(k, [float(c) for c in v], None, None, None) for k, v in rows], SCHEMA.replace("float", "double"))
    n, total = sums(df.select("embedding"))
    assert n == 4 and total == [4 * SHIFT, SCALE * 6_000_000 + 4 * SHIFT]
    got = whiten(df).collect()
    assert {r["deviation"] for r in got} == {None} and got[0]["identity_error"] < 1e-4 and len(got) == 8
