import random

import numpy as np
import pytest

from saiflow.operators.inference import robust_ols


def brute(rows, lags, within):
    """Least squares and Newey-West errors from (entity, time, y, x1, x2), with full matrices."""
    rows = sorted(r for r in rows if None not in r)
    entity = np.array([r[0] for r in rows])
    y, x = np.array([r[2] for r in rows], float), np.array([r[3:] for r in rows], float)
    if within:
        for e in set(entity):
            y[entity == e] -= y[entity == e].mean()
            x[entity == e] -= x[entity == e].mean(0)
    else:
        x = np.column_stack([x, np.ones(len(y))])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    z = x * (y - x @ beta)[:, None]
    meat = z.T @ z
    for lag in range(1, lags + 1):
        for e in set(entity):
            own = z[entity == e]
            part = own[lag:].T @ own[:-lag]
            meat += (1 - lag / (lags + 1)) * (part + part.T)
    n, k = len(y), x.shape[1] + (len(set(entity)) if within else 0)
    return beta, np.sqrt(np.diag(inverse @ meat @ inverse) * n / (n - k))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for e in range(5):
        shock = 0.0
        for t in range(40 + e):
            a, b = rng.gauss(e, 1), rng.gauss(0, 2)
            shock = 0.7 * shock + rng.gauss(0, 1)
            out.append((e, t, 3 * a - b + 10 * e + shock, a, b))
    return out + [(0, 100, None, 1.0, 1.0), (1, 100, 1.0, None, 1.0)]


@pytest.mark.parametrize("lags,within", [(0, False), (3, False), (3, True), (0, True)])
def test_equals_matrices(spark, rows, lags, within):
    panel = spark.createDataFrame(rows, "e long, t long, y double, a double, b double").repartition(3)
    got = robust_ols(panel, "y", ["a", "b"], "e", "t", lags, within).collect()
    beta, se = brute(rows, lags, within)
    assert [r.term for r in got] == ["a", "b"] + ([] if within else ["intercept"])
    assert np.allclose([r.coef for r in got], beta) and np.allclose([r.std_err for r in got], se)
    assert np.allclose([r.t_value for r in got], beta / se) and {r.n_obs for r in got} == {len(rows) - 2}
    assert all(0 <= r.p_value <= 1 for r in got)


def test_too_few_rows(spark):
    panel = spark.createDataFrame([(1, 1, 1.0, 2.0), (1, 2, 2.0, 4.0)], "e long, t long, y double, a double")
    assert robust_ols(panel, "y", ["a"], "e", "t").count() == 0
