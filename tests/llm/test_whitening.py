"""Whitening against exact rational arithmetic, on a whole table and on awkward vectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from notemill.llm import whitening
from notemill.llm.common import table

SF = "/root/testdata/sf0.001"


def exact_covariance(x: np.ndarray) -> list[list[Fraction]]:
    n, d = x.shape
    s = [sum(map(int, x[:, i])) for i in range(d)]
    z = [[n * int(v) - s[i] for i, v in enumerate(row)] for row in x]
    return [[Fraction(sum(r[i] * r[j] for r in z), n**3) for j in range(d)] for i in range(d)]


def test_error_free_transformations():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=500) * 10.0 ** rng.integers(-8, 8, 500), rng.normal(size=500) * 10.0 ** rng.integers(-8, 8, 500)
    for op, f in ((whitening.two_sum, lambda x, y: x + y), (whitening.two_product, lambda x, y: x * y)):
        high, low = op(a, b)
        assert all(Fraction(h) + Fraction(l) == f(Fraction(x), Fraction(y)) for h, l, x, y in zip(high, low, a, b, strict=True))
    high, low = whitening.dd_sum(a[:, None], np.zeros((500, 1)))
    assert abs(Fraction(high[0]) + Fraction(low[0]) - sum(map(Fraction, a))) <= Fraction(1, 10**20)


def test_covariance_is_exact_to_its_double(spark):
    rng = np.random.default_rng(2)
    x = (rng.integers(-300, 300, (200, 7)) + 10**9).astype(np.int64)  # a great mean beside small deviations
    frame = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(5)
    means = [whitening.dd_quotient(int(s), 200) for s in x.sum(0)]
    mean = (np.array([m[0] for m in means]), np.array([m[1] for m in means]))
    high, low = whitening.covariance(frame, 7, 200, lambda b: whitening.centred(whitening._matrix(b, 0, 7).astype(float), mean))
    want = exact_covariance(x)
    for i in range(7):
        for j in range(7):
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - want[i][j]) <= abs(want[i][j]) * Fraction(1, 10**25) + Fraction(1, 10**24)


def test_whole_table(spark):
    source = table(spark, SF, "embeddings").toPandas()
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in source["embedding"]], dtype=np.int64)
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    v = np.array([[float(c) for c in row] for row in exact_covariance(distinct)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    rows = whitening.op12_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(rows) == 4 * len(source) and (rows["n"] == n).all() and rows["identity_error"].nunique() == 1
    assert rows["identity_error"].iloc[0] < 1e-9
    order = np.argsort(source["vec_id"].to_numpy())
    got = rows["whitened"].to_numpy().reshape(-1, 4)
    want = ((x - sums / n) @ axes / np.sqrt(values))[order]
    signs = np.sign((got * want).sum(0))
    assert np.abs(got * signs - want).max() < 1e-8
    assert np.allclose(rows["explained"].to_numpy().reshape(-1, 4), values / v.trace(), rtol=1e-10)
    dev = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, sums, strict=True)) for r in x[order]]
    assert rows["deviation"].to_numpy().reshape(-1, 4)[:, 0].tolist() == dev


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n string, `a.b` double").repartition(3)


def test_awkward_vectors(spark):
    some = [[1.0, 2.0], [1.0, 2.0], [0.5, -1.0], [float("nan"), 1.0], [None, 1.0], None, [float("inf"), 1.0], [1.0, 2.0, 3.0], [-0.0, 0.0]]
    got = {r.vec_id: r for r in whitening.whiten(rows_of(spark, some)).collect()}
    assert sorted(got) == [0, 1, 2, 8] and {r.n for r in got.values()} == {3} and got[0].whitened == got[1].whitened
    assert len(got[0].whitened) == 2 and got[0].identity_error < 1e-9
    assert whitening.whiten(rows_of(spark, some).limit(0)).count() == 0
    assert whitening.whiten(rows_of(spark, [None, [float("nan")]])).count() == 0
    alone = whitening.whiten(rows_of(spark, [[1.0, 2.0, 3.0]] * 4)).collect()
    assert len(alone) == 4 and alone[0].whitened == [None] * 3 and alone[0].deviation == 0 and alone[0].identity_error is None
    flat = whitening.whiten(rows_of(spark, [[float(k), 5.0, 2.0 * k] for k in range(10)])).first()
    assert flat.whitened[0] is not None and flat.whitened[1:] == [None, None] and flat.explained[0] == pytest.approx(1)
    huge = whitening.whiten(rows_of(spark, [[1e300, 1.0], [-1e300, 2.0], [0.0, 1.0]])).collect()
    assert [r.deviation for r in huge if r.vec_id < 2] == [None, None]
    assert [r.whitened for r in whitening.whiten(rows_of(spark, [[], [], []])).collect()] == [[], [], []]
