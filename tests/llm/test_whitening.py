import math
from fractions import Fraction

import numpy as np
import pytest

from flowloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, id int, n int"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(k, None if v is None else [None if c is None else float(c) for c in v], 0, "x", 1, 2) for k, v in vectors], SCHEMA).repartition(parts)


def result(df):
    model = whitening.fit(df)
    return model, whitening.components_of(whitening.whiten(df, model), model)


def by_hand(vectors):
    """Whole numbers and fractions for n, deviations and V; then V in long double."""
    whole = [(k, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for k, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in whole})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    v = [[sum(Fraction(n * x[i] - sums[i], n) * Fraction(n * x[j] - sums[j], n) for x in fit) / n for j in range(d)] for i in range(d)]
    return whole, n, sums, v


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(1)
    mix = rnd.normal(size=(20, 20)) * (0.5 ** np.arange(20))[:, None]
    found = [(k, list(v)) for k, v in enumerate((rnd.normal(size=(120, 20)) @ mix))]
    found += [(500 + k, found[0][1]) for k in range(300)] + [(7, found[7][1]), (None, found[9][1])]
    return found + [(900, None), (901, []), (902, [1.0] * 19 + [None]), (903, [1.0] * 19 + [float("nan")]), (904, [1.0] * 19 + [float("-inf")])]


def test_equals_fractions(spark, vectors):
    whole, n, sums, v = by_hand(vectors)
    model, found = result(table(spark, vectors))
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = found.collect()
    assert len(rows) == 16 * len(whole) and {r["n"] for r in rows} == {n}
    deviation = {(k, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for k, x in whole}
    assert {(r["vec_id"], r["deviation"]) for r in rows} == deviation
    trace = float(sum(v[i][i] for i in range(20)))
    values, axes = np.linalg.eigh(np.array([[float(c) for c in row] for row in v]))
    for r in rows:
        c = 20 - r["component"]
        assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-9) and r["identity_error"] < 1e-9
    by_id = {(r["vec_id"], r["component"]): r["whitened"] for r in rows}
    for component in range(1, 17):
        e, axis = values[20 - component], axes[:, 20 - component]
        hand = {k: float(np.dot([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)], axis) / math.sqrt(e)) for k, x in whole}
        sign = np.sign(sum(hand[k] * by_id[k, component] for k in hand))
        assert all(abs(by_id[k, component] - sign * hand[k]) < 1e-8 for k in hand)


@pytest.mark.parametrize("gaps", [[0, 0, 0, 0], [1e-9, 1e-9, 0, 0], [1e-13, 0, 1e-6, 1e-12], [1e-3, 1e-7, 1e-11, 1e-15]])
def test_clusters_are_refined(gaps):
    rnd = np.random.default_rng(3)
    d = 24
    q = np.linalg.qr(rnd.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (np.eye(d, dtype=np.longdouble) * 1.5 - q.T @ q / 2)
    values = np.array([5.0] * 4 + [5 + g for g in gaps] + [1 + k / 7 for k in range(d - 8)], np.longdouble)
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined(a)
    assert np.abs(np.sort(found) - np.sort(values)).max() < 1e-17 * 100
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-17 * 100
    assert np.abs(a @ x - x * found).max() < 1e-17 * 1000


def test_narrow_gaps_beat_double_precision():
    """Two eigenvalues 1e-9 of the largest apart, where vectors found in doubles are off by some 1e-7."""
    rnd = np.random.default_rng(5)
    d = 12
    q = np.linalg.qr(rnd.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (np.eye(d, dtype=np.longdouble) * 1.5 - q.T @ q / 2)
    values = np.arange(1, d + 1).astype(np.longdouble)
    values[-1] = values[-2] + np.longdouble(1e-8)
    a = q @ np.diag(values) @ q.T
    found, x = whitening.refined((a + a.T) / 2)
    right = q[:, ::-1]
    assert np.abs(np.abs((x * right).sum(0)) - 1).max() < 1e-15
    assert np.abs(x * np.sign((x * right).sum(0)) - right).max() < 1e-10


@pytest.mark.parametrize("size", [30, 10_000, 1 << 40, 1 << 61])
def test_products_are_exact(size):
    rnd = np.random.default_rng(size % 97)
    y = rnd.integers(-size, size, (50, 5))
    assert whitening.exact_products(y) == [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(5)] for i in range(5)]


def test_no_variance_other_lengths_and_large_entries(spark):
    flat = [(1, [0.5, 0.0, 1e30]), (2, [0.5, 1.0, 1e30]), (3, [0.5, 2.0, 1e30]), (4, [0.5, 2.0, 1e30]), (5, [1.0, 2.0])]
    model, found = result(table(spark, flat))
    rows = {(r["vec_id"], r["component"]): r for r in found.collect()}
    assert model.n == 3 and len(rows) == 15 and model.identity_error < 1e-12
    assert all(rows[5, c]["whitened"] is None and rows[5, c]["deviation"] is None for c in (1, 2, 3))
    assert all(rows[k, c]["whitened"] is None and rows[k, c]["explained"] == pytest.approx(0, abs=1e-15) for k in (1, 2, 3, 4) for c in (2, 3))
    assert rows[1, 1]["explained"] == 1.0 and abs(rows[1, 1]["whitened"]) == pytest.approx(math.sqrt(1.5)) and rows[2, 1]["deviation"] == 0 and rows[1, 1]["deviation"] == (3 * 64) ** 2
    far = [(1, [1e30, -1e30]), (2, [-1e30, 0.0]), (3, [0.0, 1e30])]
    assert all(r["deviation"] is None and math.isfinite(r["whitened"]) for r in result(table(spark, far))[1].collect())


def test_one_vector_and_none(spark):
    rows = result(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))[1].collect()
    assert len(rows) == 4 and all(r["deviation"] == 0 and r["whitened"] is None and r["explained"] == 0 and r["n"] == 1 for r in rows)
    assert result(table(spark, [(1, None)]))[1].count() == 0
    assert result(table(spark, [(1, None)]).limit(0))[1].count() == 0
