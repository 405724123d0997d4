"""Time series: rolling and tumbling sums, annual maxima, GEV fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Valid values a year needs: half of the hours, or of the days.
HALF_HOURS, HALF_DAYS = 4380, 183
#: Limits of the fitted shape.
XI_MIN, XI_MAX = -0.5, 0.30


def rolling_sum(series: DataFrame, width: int, value: str = "value", ts: str = "ts", by: tuple[str, ...] = ("series_id",), name: str = "rolled") -> DataFrame:
    """Sum of the last ``width`` rows; null with fewer than half of them (one at least) known."""
    w = Window.partitionBy(*by).orderBy(ts).rowsBetween(-(width - 1), 0)
    return series.withColumn(name, F.when(F.count(value).over(w) >= max(1, width // 2), F.sum(value).over(w)))


def hourly_sum(series: DataFrame, least: int = 6, value: str = "value", ts: str = "ts", by: tuple[str, ...] = ("series_id",), dense: bool = False) -> DataFrame:
    """Sums per hour, null with fewer than ``least`` values; ``dense`` adds the empty hours between first and last."""
    hour = F.date_trunc("hour", F.col(ts)).alias("hour")
    sums = series.groupBy(*by, hour).agg(F.when(F.count(value) >= least, F.sum(value)).alias(value), F.count(value).alias("n"))
    if not dense:
        return sums
    every = series.groupBy(*by).agg(F.min(F.date_trunc("hour", F.col(ts))).alias("a"), F.max(F.date_trunc("hour", F.col(ts))).alias("b")).select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return every.join(sums, [*by, "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def annual_maxima(series: DataFrame, least: int, value: str = "value", ts: str = "ts", by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Largest value per year with at least ``least`` known values."""
    return series.groupBy(*by, F.year(ts).alias("year")).agg(F.max(value).alias("max_value"), F.count(value).alias("n_valid")).where(F.col("n_valid") >= least)


def anomalies(series: DataFrame, value: str = "value", by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Values less the mean of their series (or of a block of it)."""
    means = series.groupBy(*by).agg(F.avg(value).alias("_mean"))
    return series.join(means, list(by)).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")


def spliced_maxima(series: DataFrame, least: int, block: str = "block", value: str = "value", ts: str = "ts", by: str = "series_id") -> DataFrame:
    """Annual maxima of records whose blocks have different datums: each block loses its own mean; a later block wins a shared year."""
    own = annual_maxima(anomalies(series, value, (by, block)), least, value, ts, (by, block))
    return own.groupBy(by, "year").agg(F.max_by("max_value", block).alias("max_value"), F.max_by("n_valid", block).alias("n_valid"))


def log_likelihood(x: np.ndarray, xi: float, mu: float, log_sigma: float) -> float:
    """Negative GEV log-likelihood; infinite outside the support."""
    if abs(log_sigma) > 50:
        return math.inf
    y = (x - mu) / math.exp(log_sigma)
    if abs(xi) < 1e-8:
        return float(len(x) * log_sigma + y.sum() + np.exp(-y).sum())
    t = 1 + xi * y
    if (t <= 0).any():
        return math.inf
    return float(len(x) * log_sigma + (1 + 1 / xi) * np.log(t).sum() + (t ** (-1 / xi)).sum())


def minimised(f, start: np.ndarray, rounds: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """Nelder and Mead's downhill simplex."""
    n = len(start)
    points = [start, *(start + np.eye(n)[i] * (0.1 * abs(start[i]) + 0.05) for i in range(n))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] <= tolerance * (1 + abs(values[0])):
            break
        middle = np.mean(points[:-1], axis=0)
        tried = [(f(p), p) for p in [2 * middle - points[-1]]]
        if tried[0][0] < values[0]:
            far = 3 * middle - 2 * points[-1]
            tried.append((f(far), far))
        elif tried[0][0] >= values[-2]:
            near = 0.5 * (middle + (points[-1] if tried[0][0] >= values[-1] else tried[0][1]))
            tried = [(f(near), near)]
        best, point = min(tried, key=lambda v: v[0])
        if best < values[-1]:
            points[-1], values[-1] = point, best
        else:
            points = [points[0], *(0.5 * (p + points[0]) for p in points[1:])]
            values = [values[0], *(f(p) for p in points[1:])]
    return points[int(np.argmin(values))]


def fit_values(x: np.ndarray, xi_max: float | None = XI_MAX) -> tuple[float, float, float]:
    """Maximum-likelihood (xi, mu, sigma), started from the moments; the shape is held within limits and the rest refitted."""
    scale = max(float(np.std(x)) * math.sqrt(6) / math.pi, 1e-9)
    start = np.array([0.05, float(np.mean(x)) - 0.5772 * scale, math.log(scale)])
    xi, mu, log_sigma = minimised(lambda p: log_likelihood(x, *p), start)
    if xi_max is not None and not XI_MIN <= xi <= xi_max:
        xi = min(max(xi, XI_MIN), xi_max)
        mu, log_sigma = minimised(lambda p: log_likelihood(x, xi, *p), start[1:])
    return float(xi), float(mu), math.exp(log_sigma)


def _fit_group(pdf: pd.DataFrame, by: str, xi_max: float | None) -> pd.DataFrame:
    x = pdf["max_value"].dropna().to_numpy(float)
    if len(x) < 3:
        return pd.DataFrame({by: pdf[by].iloc[:1], "xi": [None], "mu": [None], "sigma": [None], "n_years": [len(x)]})
    xi, mu, sigma = fit_values(x, xi_max)
    return pd.DataFrame({by: pdf[by].iloc[:1], "xi": [xi], "mu": [mu], "sigma": [sigma], "n_years": [len(x)]})


def gev_fit(maxima: DataFrame, by: str = "series_id", xi_max: float | None = XI_MAX) -> DataFrame:
    """GEV parameters per series from its annual maxima; null with fewer than three.  One small group per task."""
    kind = dict(maxima.dtypes)[by]
    return maxima.select(by, "max_value").groupBy(by).applyInPandas(lambda pdf: _fit_group(pdf, by, xi_max), f"{by} {kind}, xi double, mu double, sigma double, n_years long")


def station_years(rain: DataFrame, width: int = 1, least_years: int = 5, least: int = HALF_HOURS) -> DataFrame:
    """Pooled station-year maxima of stations with enough years: 5-minute rain to hours, rolled, largest per year."""
    hours = hourly_sum(rain, dense=True)
    rolled = rolling_sum(hours, width, ts="hour")
    maxima = annual_maxima(rolled, least, "rolled", "hour")
    enough = maxima.groupBy("series_id").agg(F.count("*").alias("years")).where(F.col("years") >= least_years)
    return maxima.join(enough, "series_id", "left_semi")


def first_of_duplicates(series: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The first row for each key."""
    w = Window.partitionBy(*by).orderBy(order)
    return series.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def time_slice(series: DataFrame, start: Column, stop: Column, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` up to but not at ``stop``."""
    return series.where((F.col(ts) >= start) & (F.col(ts) < stop))
