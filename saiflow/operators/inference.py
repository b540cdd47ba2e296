"""Regressions with errors that may be correlated in time and sectors that have levels of their own.

``robust_ols`` fits by least squares and gives Newey-West standard errors:
products of a row's moments with those of up to ``lags`` rows before it, of
the same sector, are weighted 1 - l / (lags + 1). With ``within`` the means
of each sector are taken off first, which is the same as a level for each.

Both steps are one aggregate each; the driver gets sums of products, (k + 1)^2
numbers for k regressors, whatever the number of rows. Lags are windows by
sector, whose rows are periods.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = "term string, coef double, std_err double, t_value double, p_value double, n_obs long"


def within_entity(panel: DataFrame, columns: list[str], entity: str) -> DataFrame:
    """``panel`` with each column less its mean over the entity's rows (rows with a null in any of them go)."""
    full = panel.dropna(subset=columns)
    means = full.groupBy(entity).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns))
    return full.join(means, entity).select(*(c for c in panel.columns if c not in columns),
                                           *((F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns))


def _products(df: DataFrame, left: list[Column], right: list[Column]) -> np.ndarray:
    """Sums of all products of a column of ``left`` and one of ``right``, as a matrix."""
    row = df.agg(*(F.sum(a * b) for a in left for b in right)).first()
    return np.array([0.0 if x is None else float(x) for x in row]).reshape(len(left), len(right))


def robust_ols(panel: DataFrame, y: str, regressors: list[str], entity: str, time: str, lags: int = 0, within: bool = False) -> DataFrame:
    """Term, coef, std_err, t_value, p_value (normal, two-sided), n_obs; one row a regressor, and the
    intercept unless ``within``. ``lags`` = 0 gives errors robust to unequal variances alone.

    Rows with a null in any used column are left out. The covariance is
    scaled by n / (n - parameters), where each entity's level counts as one with ``within``.
    """
    columns = [y, *regressors]
    data = panel.select(entity, time, *(F.col(c).cast("double").alias(c) for c in columns)).dropna(subset=columns)
    if within:
        data = within_entity(data, columns, entity)
    names = list(regressors) + ([] if within else ["intercept"])
    x = [F.col(c) for c in regressors] + ([] if within else [F.lit(1.0)])
    levels = F.count_distinct(entity) if within else F.lit(0)
    n, entities = data.agg(F.count(F.lit(1)), levels).first()
    if n <= len(names) + entities:
        return panel.sparkSession.createDataFrame([], RESULT)
    moments = _products(data, x, [*x, F.col(y)])
    inverse = np.linalg.inv(moments[:, :-1])
    beta = inverse @ moments[:, -1]
    error = F.col(y)
    for b, column in zip(beta.tolist(), x):
        error = error - F.lit(b) * column
    own = [f"_z{k}" for k in range(len(x))]
    scored = data.select(entity, time, *((c * error).alias(z) for z, c in zip(own, x)))
    order = Window.partitionBy(entity).orderBy(time)
    lagged = {(z, lag): f"{z}_{lag}" for z in own for lag in range(1, lags + 1)}
    scored = scored.withColumns({name: F.coalesce(F.lag(z, lag).over(order), F.lit(0.0)) for (z, lag), name in lagged.items()}) if lagged else scored
    # the weighted sum of a row's later moments, so one aggregate gives all lags at once
    past = [sum(((1 - lag / (lags + 1)) * F.col(lagged[z, lag]) for lag in range(1, lags + 1)), F.lit(0.0)) for z in own]
    sums = _products(scored, [F.col(z) for z in own], [*(F.col(z) for z in own), *past])
    k = len(own)
    meat = sums[:, :k] + sums[:, k:] + sums[:, k:].T
    cov = inverse @ meat @ inverse * n / (n - k - entities)
    rows = []
    for name, b, v in zip(names, beta.tolist(), np.diag(cov).tolist()):
        se = math.sqrt(v) if v > 0 else None
        t = b / se if se else None
        rows.append((name, b, se, t, math.erfc(abs(t) / math.sqrt(2)) if t is not None else None, n))
    return panel.sparkSession.createDataFrame(rows, RESULT)
