"""Queries of the regressions with standard errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as X
from ..operators.inference import robust_ols
from .catalog import _PANEL_SQL, _sai, query
from .fixtures import Views

# products of moments with those of the two periods before, weighted 2/3 and 1/3
_LAGS = ("lag({z}, 1, 0) over (partition by bk_code order by period) * 2 / 3 + lag({z}, 2, 0) over (partition by bk_code order by period) / 3")


def _panel(spark, d) -> DataFrame:
    v = Views(spark, d)
    return X.attention_panel(_sai(v), X.sector_returns(v.sector_px()))


def _shown(fit: DataFrame) -> DataFrame:
    return fit.select("term", F.round("coef", 8).alias("coef"), F.round("std_err", 8).alias("std_err"), F.round("t_value", 5).alias("t_value"), "n_obs")


_FIT = ("select '{term}' as term, round({b}, 8) + 0.0 as coef, round(sqrt({v}), 8) + 0.0 as std_err, "
        "round({b} / sqrt({v}), 5) + 0.0 as t_value, cast(n as bigint) as n_obs from cv")


@query("regression_newey_west", _PANEL_SQL + ", q as (select bk_code, period, ret as y, sai_lag as x from pan where ret is not null and sai_lag is not null), "
       "m as (select count(*) as n, sum(x) as sx, sum(x * x) as sxx, regr_slope(y, x) as b, regr_intercept(y, x) as a from q), "
       "z as (select bk_code, period, q.y - a - b * x as z0, (q.y - a - b * x) * x as z1 from q, m), "
       f"w as (select z0, z1, {_LAGS.format(z='z0')} as p0, {_LAGS.format(z='z1')} as p1 from z), "
       "ms as (select sum(z0 * z0 + 2 * z0 * p0) as s00, sum(z0 * z1 + z0 * p1 + z1 * p0) as s01, sum(z1 * z1 + 2 * z1 * p1) as s11 from w), "
       # the inverse of the moments is [[sxx, -sx], [-sx, n]] / det, for (intercept, slope)
       "cv as (select *, n * sxx - sx * sx as det, n / (n - 2) as f from m, ms) " +
       _FIT.format(term="sai_lag", b="b", v="(sx * sx * s00 - 2 * n * sx * s01 + n * n * s11) / det / det * f") + " union all " +
       _FIT.format(term="intercept", b="a", v="(sxx * sxx * s00 - 2 * sx * sxx * s01 + sx * sx * s11) / det / det * f"))
def q_regression_newey_west(spark, d):
    """The next period's return on attention, all sectors together, errors correlated over two periods."""
    return _shown(robust_ols(_panel(spark, d), "ret", ["sai_lag"], "bk_code", "period", lags=2))


@query("regression_within_sector", _PANEL_SQL + ", q as (select bk_code, period, log_amount as y, sai_lag as x from pan where log_amount is not null "
       "and sai_lag is not null), d as (select bk_code, period, y - avg(y) over (partition by bk_code) as y, x - avg(x) over (partition by bk_code) as x from q), "
       "m as (select count(*) as n, count(distinct bk_code) as g, sum(x * x) as sxx, sum(x * y) / sum(x * x) as b from d), "
       "z as (select bk_code, period, (d.y - b * x) * x as z from d, m), "
       f"w as (select z, {_LAGS.format(z='z')} as p from z), ms as (select sum(z * z + 2 * z * p) as s from w), "
       "cv as (select *, n / (n - 1 - g) as f from m, ms) " + _FIT.format(term="sai_lag", b="b", v="s / sxx / sxx * f"))
def q_regression_within_sector(spark, d):
    """The trading amount on the attention of the period before, within sectors."""
    return _shown(robust_ols(_panel(spark, d), "log_amount", ["sai_lag"], "bk_code", "period", lags=2, within=True))
