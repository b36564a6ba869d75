"""Coefficients and standard errors on noisy data against numpy: HC1, clustered, with dummies and with many levels absorbed."""

import numpy as np
import pytest

from lodestar.operators import stats


def _data(n, levels, seed=3):
    r = np.random.default_rng(seed)
    g, h = r.integers(0, levels, n), r.integers(0, 7, n)
    a, b = r.normal(size=n) + g % 5, r.normal(size=n) * (1 + h)
    y = 1 + 2 * a - 0.5 * b + g * 0.01 + h + r.normal(size=n) * (1 + np.abs(a))
    return g, h, a, b, y


def _sandwich(x, y, cluster=None):
    x = np.column_stack(x)
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    n, k = x.shape
    if cluster is None:
        meat, scale = (x * e[:, None]).T @ (x * e[:, None]), n / (n - k)
    else:
        s = np.array([(x[cluster == c] * e[cluster == c, None]).sum(0) for c in np.unique(cluster)])
        meat, scale = s.T @ s, len(s) / (len(s) - 1) * (n - 1) / (n - k)
    return beta, np.sqrt(np.diag(inv @ meat @ inv) * scale), 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))


def _dummies(g):
    return [(g == v).astype(float) for v in np.unique(g)[1:]]


def _frame(spark, *columns):
    return spark.createDataFrame([tuple(float(v) if i > 1 else int(v) for i, v in enumerate(row)) for row in zip(*columns)], "g int, h int, a double, b double, y double").repartition(4)


@pytest.mark.parametrize("cluster", [None, "g"])
def test_with_dummies(spark, cluster):
    g, h, a, b, y = _data(800, 40)
    got = {r.name: r for r in stats.ols(_frame(spark, g, h, a, b, y), "y", ["a", "b"], {"h": list(range(7))}, cluster).collect()}
    beta, se, r2 = _sandwich([np.ones(len(y)), a, b, *_dummies(h)], y, g if cluster else None)
    for name, i in (("const", 0), ("a", 1), ("b", 2), ("h=1", 3), ("h=6", 8)):
        assert np.allclose([got[name].coef, got[name].se, got[name].r2], [beta[i], se[i], r2], rtol=1e-8)


@pytest.mark.parametrize("by, cluster", [(["g"], None), (["g"], "h"), (["g", "h"], None), (["h", "g"], "g")])
def test_five_hundred_levels_absorbed(spark, by, cluster):
    g, h, a, b, y = _data(4000, 500)
    df = _frame(spark, g, h, a, b, y)
    got = {r.name: r for r in stats.ols_absorbed(df, "y", ["a", "b"], by, cluster).collect()}
    columns = {"g": g, "h": h}
    beta, se, r2 = _sandwich([a, b, np.ones(len(y)), *[d for c in by for d in _dummies(columns[c])]], y, columns.get(cluster))
    for name, i in (("a", 0), ("b", 1)):
        assert np.allclose([got[name].coef, got[name].se, got[name].r2, got[name].t], [beta[i], se[i], r2, beta[i] / se[i]], rtol=1e-6)


def test_absorbed_without_rows_and_with_a_column_of_levels(spark):
    g, h, a, b, y = _data(300, 10)
    df = _frame(spark, g, h, a, b, y)
    assert stats.ols_absorbed(df.limit(0), "y", ["a"], ["g"]).count() == 0
    names = [r.name for r in stats.ols_absorbed(df.selectExpr("g", "a", "y", "cast(g as double) * 2 as same"), "y", ["a", "same"], ["g"]).collect()]
    assert names == ["a"]
