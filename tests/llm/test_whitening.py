import random
from fractions import Fraction

import numpy as np
import pytest

from lodestrand.llm import whitening


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, n long, component int, deviation string")


def row(i, v):
    return (i, v, 1, 7, 7, "x")


def whole(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v)


def check(spark, rows, most=32):
    """Against exact sums in Python's integers."""
    found = whitening.whiten(frame(spark, rows), most=most).collect()
    kept = [(r[0], [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in r[1]]) for r in rows if whole(r[1])]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[i] for _, x in kept) for i in range(d)]
    y = [[n * a - s for a, s in zip(x, sums)] for _, x in kept]
    exact = [[Fraction(sum(a[i] * a[j] for a in y), n**3) for j in range(d)] for i in range(d)]
    trace = float(sum(exact[i][i] for i in range(d)))
    values = np.linalg.eigvalsh(np.array(exact, np.float64))[::-1]
    assert len(found) == n * min(d, most)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, int(r["deviation"])) for r in found if r["component"] == 1) == sorted((k is None, k or 0, sum(a * a for a in c)) for (k, _), c in zip(kept, y))
    assert {r["n"] for r in found} == {n}
    for k in range(1, min(d, most) + 1):
        own = [r for r in found if r["component"] == k]
        assert len({r["explained"] for r in own}) == 1 and own[0]["explained"] == pytest.approx(values[k - 1] / trace, rel=1e-9)
        assert np.mean([r["whitened"] for r in own]) == pytest.approx(0, abs=1e-9)
        assert np.mean([r["whitened"] ** 2 for r in own]) == pytest.approx(1, abs=1e-9)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    return found


def test_exact_sums_and_unit_variance(spark):
    own = random.Random(1)
    check(spark, [row(i, [own.gauss(0, 0.2 * (j + 1)) for j in range(6)]) for i in range(200)])


def test_more_dimensions_than_components(spark):
    own = random.Random(2)
    found = check(spark, [row(i, [own.gauss(0, 1) for _ in range(40)]) for i in range(90)])
    assert {r["component"] for r in found} == set(range(1, 33))


def test_odd_rows(spark):
    own = random.Random(3)
    rows = [row(i, [own.gauss(0, 1), own.gauss(1, 2), own.gauss(5, 0.5)]) for i in range(40)]
    rows += [row(50, None), row(51, []), row(52, [1.0, None, 2.0]), row(53, [1.0, float("nan"), 2.0]), row(54, [float("inf"), 0.0, 0.0]), row(None, [0.5, 0.25, 0.125]), row(3, [0.5, 0.5, 0.5]), rows[3]]
    check(spark, rows)


def test_other_lengths_are_left_out(spark):
    rows = [row(i, [float(i % 5), float(i % 3)]) for i in range(30)] + [row(100 + i, [1.0, 2.0, float(i)]) for i in range(29)]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert {r["vec_id"] for r in found} == set(range(30))


def test_no_rows(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [row(1, None), row(2, [None])])).count() == 0


def test_equal_vectors_have_no_variance(spark):
    found = whitening.whiten(frame(spark, [row(1, [1.0, 2.0]), row(2, [1.0, 2.0])])).collect()
    assert len(found) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in found)


def test_a_constant_dimension(spark):
    own = random.Random(4)
    rows = [row(i, [own.gauss(0, 1), 3.0, own.gauss(0, 2)]) for i in range(50)]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in found)
    assert found[0]["identity_error"] < 1e-9


def test_scales_far_apart(spark):
    """Small components are as exact as large ones: 20 powers of ten between the variances."""
    own = random.Random(5)
    rows = [row(i, [own.gauss(0, 1e9), own.gauss(0, 1e4), own.gauss(0, 0.1)]) for i in range(60)]
    found = whitening.whiten(frame(spark, rows, "double")).collect()
    x = np.array([np.floor(np.array(r[1]) * 64) for r in rows])
    x -= x.mean(axis=0)
    for k, column in ((1, 0), (2, 1)):
        share = next(r["explained"] for r in found if r["component"] == k)
        assert share == pytest.approx((x[:, column] ** 2).mean() / (x**2).mean(axis=0).sum(), rel=0.2)
    assert next(r["explained"] for r in found if r["component"] == 3) == pytest.approx(0, abs=1e-16)


def test_very_large_entries_are_summed_as_big_integers(spark):
    rows = [row(i, [float((-1) ** i * 2.0**40 * (i + 1)), float(i * i * 2.0**36)]) for i in range(20)]
    found = check(spark, rows)
    assert max(int(r["deviation"]) for r in found) > 1 << 63


def test_digit_products_are_exact():
    rng = np.random.default_rng(1)
    for bound in (1000, 1 << 30, 1 << 61):
        y = rng.integers(-bound, bound, (5000, 3))
        own = whitening.Products(3, bound)
        for i in range(0, 5000, 700):
            own.add(y[i : i + 700])
        big = y.astype(object)
        assert (own.recombine() == big.T @ big).all()
        assert [sum(int(v) << (whitening.SUM_BITS * k) for k, v in enumerate(r)) for r in whitening.in_digits(own.total.ravel(), 5)] == own.total.ravel().tolist()


def test_eigenvectors_are_exact():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    exact = np.array([[Fraction(v) for v in r] for r in q @ np.diag([1e8, 1e4, 3.0, 1e-2, 1e-4]) @ q.T])
    exact = (exact + exact.T) * 2**200
    values, vectors = whitening.eigen(np.array([[int(v) for v in r] for r in exact], object), 2**201)
    assert np.allclose(vectors.T @ vectors, np.eye(5), atol=1e-14)
    assert np.allclose(values[:4], [1e8, 1e4, 3.0, 1e-2], rtol=1e-5)
