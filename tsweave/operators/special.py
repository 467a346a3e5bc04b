"""Distribution functions and unit-root tests in numpy, as no statistics library is at hand; Arrow carries the groups.

Student's t by the regularised incomplete beta function (continued fraction). ADF with a constant, the lag of least AIC
over a common sample; its p-value by MacKinnon's response surfaces (1994, 2010), good to about two digits between 0.01 and
0.10. KPSS for level, with Hobijn, Franses and Ooms' automatic lag, and p between the tabulated 0.10 and 0.01.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: MacKinnon (1994), coefficients by powers of tau from the constant on, with a constant term: one series,
#: then two (the residuals of a regression on one other): (tau below which small is used, lowest, highest, small, large).
MACKINNON = {
    1: (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-2.62, -18.86, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}
#: Critical values of KPSS for level at 10, 5, 2.5 and 1 percent.
KPSS = ((0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01))


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d if abs(1 + num * d) > tiny else tiny)
            c = 1 + num / c if abs(1 + num / c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def correlation_p(r: float, n: float) -> float | None:
    if n is None or r is None or n < 3 or r != r:
        return None
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def p_of_correlation(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation r of n pairs; null where either is null or n < 3."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(a, b) for a, b in zip(r, n, strict=True)], dtype="float64")

    return p(r, n.cast("double"))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def mackinnon_p(tau: float, series: int = 1) -> float:
    star, low, high, small, large = MACKINNON[series]
    if tau > high:
        return 1.0
    if tau < low:
        return 0.0
    return normal_cdf(sum(c * tau**i for i, c in enumerate(small if tau <= star else large)))


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    s2 = e @ e / max(1, len(y) - x.shape[1])
    return beta, np.sqrt(np.maximum(np.diag(np.linalg.pinv(x.T @ x)) * s2, 0)), float(e @ e)


def adf(y: np.ndarray, most_lag: int, constant: bool = True) -> tuple[float, int]:
    """(tau, lag): the Dickey-Fuller statistic with the lag of least AIC over a common sample."""
    d = np.diff(y)

    def design(lag: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(first, len(d))
        columns = [y[rows]] + [d[rows - i] for i in range(1, lag + 1)] + ([np.ones(len(rows))] if constant else [])
        return np.column_stack(columns), d[rows]

    def aic(lag: int) -> float:
        x, z = design(lag, most_lag)
        _, _, sse = _ols(x, z)
        return len(z) * math.log(max(sse, 1e-300) / len(z)) + 2 * x.shape[1]

    lag = min(range(most_lag + 1), key=aic)
    x, z = design(lag, lag)
    beta, se, _ = _ols(x, z)
    return (float(beta[0] / se[0]) if se[0] > 0 else math.nan), lag


def kpss(y: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p within 0.01 and 0.10, lag) for stationarity around a level."""
    n, e = len(y), y - y.mean()
    cut = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for i in range(1, cut + 1):
        c = 2 * (e[i:] @ e[:-i]) / n
        s0, s1 = s0 + c, s1 + i * c
    lag = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))) if s0 else 0
    var = e @ e / n + sum(2 * (1 - i / (lag + 1)) * (e[i:] @ e[:-i]) / n for i in range(1, lag + 1))
    stat = float((np.cumsum(e) ** 2).sum() / (n * n * var))
    return stat, float(np.interp(stat, *KPSS)), lag


def cointegration(y: np.ndarray, x: np.ndarray, least: int = 30) -> dict:
    """Engle-Granger with ADF and KPSS of the residuals; what can't be said is None, with a reason."""
    none = dict.fromkeys(["beta", "intercept", "engle_granger_stat", "engle_granger_p", "adf_stat", "adf_p", "kpss_stat", "kpss_p", "kpss_bounded", "tests_agree"])
    good = np.isfinite(x) & np.isfinite(y)
    x, y = x[good], y[good]
    if len(y) < least:
        return none | {"n": len(y), "reason": "insufficient_observations"}
    if np.ptp(x) == 0 or np.ptp(y) == 0:
        return none | {"n": len(y), "reason": "constant_series"}
    design = np.column_stack([np.ones(len(x)), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    e = y - design @ beta
    out = none | {"n": len(y), "beta": float(beta[1]), "intercept": float(beta[0]), "reason": None}
    if not np.isfinite(e).all() or np.abs(e).max() <= 1e-12 * max(1.0, np.abs(y).max()):
        return out | {"reason": "degenerate_residuals"}
    r2 = 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))
    if r2 >= 1 - 100 * math.sqrt(np.finfo(float).eps):
        return out | {"reason": "collinear_series"}
    lag = min(len(y) // 4, 8)
    eg, _ = adf(e, lag, constant=False)
    tau, _ = adf(e, lag)
    if not (math.isfinite(eg) and math.isfinite(tau)):
        return out | {"reason": "unit_root_test_failed"}
    stat, p, _ = kpss(e)
    eg_p, adf_p = mackinnon_p(eg, 2), mackinnon_p(tau, 1)
    return out | {"engle_granger_stat": eg, "engle_granger_p": eg_p, "adf_stat": tau, "adf_p": adf_p, "kpss_stat": stat, "kpss_p": p, "kpss_bounded": p <= 0.01, "tests_agree": (adf_p < 0.05) == (p >= 0.05)}


COINTEGRATION = "n long, beta double, intercept double, engle_granger_stat double, engle_granger_p double, adf_stat double, adf_p double, kpss_stat double, kpss_p double, kpss_bounded boolean, tests_agree boolean, reason string"


def cointegration_by_name(pairs: DataFrame, name: str = "name") -> DataFrame:
    """pairs (name, t, y, x) -> one row of cointegration() a name. A candidate's panel is what a task holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return pd.DataFrame([{name: pdf[name].iloc[0]} | cointegration(pdf["y"].to_numpy(float), pdf["x"].to_numpy(float))])

    return pairs.select(name, "t", "y", "x").groupBy(name).applyInPandas(run, f"{name} string, {COINTEGRATION}")


def map_batches(frame: DataFrame, f, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield f(pdf)

    return frame.mapInPandas(run, schema)
