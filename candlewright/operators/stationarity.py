"""Stationarity tests of many series from sums: one pass of built-in aggregates serves all lag orders of all tests.

A regression needs the products of its columns summed over its sample. The columns here are the level, a constant, a trend
and lagged differences, so nearly all of these sums are sums of products h rows apart, less what stands before the sample
or after it: h = 0 to the largest order, and the first and last few values, are all that leaves the rows. From a series'
few numbers each test is solved by sweeping its small matrix, one column after the other, which gives every lag order's
residual sum on the way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .forecast import ADF_CRITICAL, ADF_LARGE, ADF_MAX, ADF_MIN, ADF_SMALL, ADF_STAR, KPSS_5, TREND_5

#: Differences that are tested: fixed value.
DIFFERENCES = 3
#: A column whose own part falls below this share of its square sum is taken for a combination of the others.
PIVOT = 1e-10


def lagged_sums(rows: DataFrame, keys: Sequence[str] = ("name",), time: str = "begin") -> DataFrame:
    """For each series of rows (keys, time, price) and difference d, 0 to 2: n, whether all values are equal, and the sums.

    Values are taken around their mean. level is a value, step the difference to the next one, place its number from 1.
    Equal times are taken in order of price; empty input gives an empty result.
    """
    w = Window.partitionBy(*keys).orderBy(time, "price")
    df = rows.select(*keys, time, "price", F.row_number().over(w).alias("_i"), *(F.lag("price", k).over(w).alias(f"_b{k}") for k in (1, 2)))
    each = [F.col("price"), F.col("price") - F.col("_b1"), F.col("price") - 2 * F.col("_b1") + F.col("_b2")]
    df = df.select(*keys, "_i", F.posexplode(F.array(*each)).alias("d", "v")).filter("v IS NOT NULL")
    of = Window.partitionBy(*keys, "d")
    df = df.select(*keys, "d", (F.col("_i") - F.col("d")).alias("place"), F.count("*").over(of).alias("n"), (F.max("v").over(of) == F.min("v").over(of)).alias("flat"), (F.col("v") - F.avg("v").over(of)).alias("level"))
    longest = df.agg(F.max("n")).first()[0] or 0
    most, width = _most(longest), max(_most(longest), _trend_lags(longest), 1)
    o = of.orderBy("place")
    df = df.withColumns({"step": F.lead("level").over(o) - F.col("level"), "run": F.sum("level").over(o.rowsBetween(Window.unboundedPreceding, 0))})
    back = lambda c, h: F.lag(c, h).over(o) if h else F.col(c)
    here = F.col("step").isNotNull()
    df = df.select(
        *keys, "d", "place", "n", "flat", "level", "step", "run",
        F.array(*(F.col("step") * back("step", h) for h in range(width + 1))).alias("_p"),
        F.array(*(F.when(here, F.col("level") * back("step", h)) for h in range(width + 1))).alias("_q"),
        F.array(*(F.col("level") * back("level", h) for h in range(_kpss_lags(longest) + 1))).alias("_e"),
    )
    total = lambda c, k: F.array(*(F.coalesce(F.sum(F.col(c)[h]), F.lit(0.0)) for h in range(k + 1)))
    ends = lambda c, at: F.transform(F.sort_array(F.collect_list(F.when(here & at, F.struct("place", c)))), lambda x: x[c])
    first, last = F.col("place") <= width, F.col("place") >= F.col("n") - width - 1
    one = lambda c: F.coalesce(F.sum(F.when(here, c)), F.lit(0.0))
    return df.groupBy(*keys, "d").agg(
        F.first("n").alias("n"), F.first("flat").alias("flat"), total("_p", width).alias("p"), total("_q", width).alias("q"), total("_e", _kpss_lags(longest)).alias("e"),
        ends("step", first).alias("steps"), ends("level", first).alias("levels"), ends("step", last).alias("last_steps"), F.sum(F.col("run") * F.col("run")).alias("runs"),
        one(F.col("level")).alias("level_sum"), one(F.col("level") * F.col("level")).alias("square_sum"), one(F.col("step")).alias("step_sum"),
        one(F.col("place") * F.col("level")).alias("place_level"), one(F.col("place") * F.col("step")).alias("place_step"), F.lit(most).alias("most"),
    )


def _most(n: int) -> int:
    """The highest lag order that the test with a constant considers."""
    return min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2) if n else -1


def _trend_lags(n: int) -> int:
    return int(np.cbrt(max(n - 1, 0)) + 1e-9)


def _kpss_lags(n: int) -> int:
    return max(min(int(3 * math.sqrt(n) / 13), n - 1), 0)


def _matrix(s, k: int, lags: int, trend: bool) -> np.ndarray:
    """Products of (constant, [trend], level, lagged steps 1 to lags, step), summed over places k + 1 to the last step."""
    steps, levels, last, n = np.array(s.steps, float), np.array(s.levels, float), np.array(s.last_steps, float)[::-1], s.n - 1
    order = [*range(1, lags + 1), 0]
    mid, place = n / 2, np.arange(1, k + 1)

    def between(h: int, i: int) -> float:  # step i places back, by step i + h places back
        head = steps[h : k - i] @ steps[: max(k - i - h, 0)] if k - i > h else 0.0
        return s.p[h] - head - last[:i] @ last[h : h + i]

    size = 2 + trend + len(order)
    m = np.zeros((size, size))
    at = 2 + trend
    rest = levels[:k]
    m[0, 0], lv = n - k, 1 + trend
    m[0, lv] = s.level_sum - rest.sum()
    m[lv, lv] = s.square_sum - rest @ rest
    for a, i in enumerate(order):
        m[0, at + a] = s.step_sum - steps[: k - i].sum() - last[:i].sum()
        m[lv, at + a] = s.q[i] - levels[i:k] @ steps[: k - i]
        for b, j in enumerate(order):
            m[at + a, at + b] = between(abs(i - j), min(i, j))
    if trend:
        t = np.array([n, k], float)
        ones, squares = t * (t + 1) / 2, t * (t + 1) * (2 * t + 1) / 6
        m[0, 1] = ones[0] - ones[1] - mid * (n - k)
        m[1, 1] = squares[0] - squares[1] - 2 * mid * (ones[0] - ones[1]) + mid**2 * (n - k)
        m[1, lv] = s.place_level - mid * s.level_sum - (place - mid) @ rest
        for a, i in enumerate(order):
            tail = (n - np.arange(i) + i - mid) @ last[:i]
            m[1, at + a] = s.place_step + (i - mid) * s.step_sum - (place[: k - i] + i - mid) @ steps[: k - i] - tail
    return np.triu(m) + np.triu(m, 1).T


def _sweep(m: np.ndarray, j: int) -> np.ndarray:
    """The matrix with column j among the explaining ones."""
    row, column, d = m[j].copy(), m[:, j].copy(), m[j, j]
    m = m - np.outer(column, row) / d
    m[j], m[:, j], m[j, j] = row / d, -column / d, 1 / d
    return m


def _swept(m: np.ndarray) -> tuple[np.ndarray, list[float], set[int]]:
    """After all columns but the last: the matrix, the residual sums after each, and the columns that are taken in."""
    residuals, used, own = [], set(), m.diagonal().copy()
    for j in range(len(m) - 1):
        if m[j, j] > PIVOT * own[j]:
            m = _sweep(m, j)
            used.add(j)
        residuals.append(max(m[-1, -1], 0.0))
    return m, residuals, used


def _statistic(m: np.ndarray, level: int, rows: int) -> float:
    """The level's coefficient by its standard error."""
    swept, residuals, used = _swept(m)
    left = rows - (len(m) - 1)
    if level not in used or left <= 0:
        return math.nan
    se = math.sqrt(residuals[-1] / left * max(swept[level, level], 0.0))
    return swept[level, -1] / se if se > 0 else math.nan


def adf(s) -> tuple[float, float]:
    """Statistic with a constant, lags by AIC over one common sample, and its p-value; NaN for a short or constant series."""
    most = _most(s.n)
    if s.n < 6 or s.flat or most < 0:
        return math.nan, math.nan
    rows = s.n - 1 - most
    _, residuals, _ = _swept(_matrix(s, most, most, False))
    aics = [rows * math.log(max(x, 1e-300) / rows) + 2 * (2 + k) for k, x in enumerate(residuals[1:])]
    k = int(np.argmin(aics))
    t = _statistic(_matrix(s, k, k, False), 1, s.n - 1 - k)
    if math.isnan(t):
        return math.nan, math.nan
    if not ADF_MIN <= t <= ADF_MAX:
        return t, 1.0 if t > ADF_MAX else 0.0
    c = ADF_SMALL if t <= ADF_STAR else ADF_LARGE
    return t, 0.5 * math.erfc(-sum(v * t**i for i, v in enumerate(c)) / math.sqrt(2))


def trend_passes(s) -> bool:
    """Whether the test with a constant and a trend finds a series stationary at 5%, or cannot judge it."""
    lags, n = _trend_lags(s.n), s.n - 1
    if n - lags < lags + 5 or s.flat:
        return True
    t = _statistic(_matrix(s, lags, lags, True), 2, n - lags)
    return not t >= float(np.interp(n, *TREND_5))


def kpss(s) -> float:
    """Statistic around a level, with the short lag; NaN if it cannot be told."""
    if s.n < 3 or s.flat:
        return math.nan
    lags = _kpss_lags(s.n)
    s2 = s.e[0] / s.n + 2 / s.n * sum((1 - j / (lags + 1)) * s.e[j] for j in range(1, lags + 1))
    return s.runs / s.n**2 / s2 if s2 > 0 else math.nan


def tests(rows: DataFrame, keys: Sequence[str] = ("name",), time: str = "begin") -> DataFrame:
    """For each series and difference: adf, p_value, trend_passes, kpss. Numbers that cannot be told are null."""
    sums = lagged_sums(rows, keys, time)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # one row a series and difference
            found = [(*adf(s), trend_passes(s), kpss(s)) for s in pdf.itertuples()]
            out = pd.DataFrame(found, columns=["adf", "p_value", "trend_passes", "kpss"])
            yield pd.concat([pdf[[*keys, "d", "n"]].reset_index(drop=True), out], axis=1)

    kinds = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in (*keys, "d", "n"))
    out = sums.mapInPandas(solve, f"{kinds}, adf double, p_value double, trend_passes boolean, kpss double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("adf", "p_value", "kpss")})


def stationarity(rows: DataFrame, keys: Sequence[str] = ("name",), time: str = "begin") -> DataFrame:
    """The report of each series: adf and p_value of its first difference with critical values; d, the first of 0 to 2
    differences that the test finds stationary or cannot judge, else 3; ndiffs, the larger of the orders, up to 2, that the
    test with a trend and the KPSS test ask for."""
    found = tests(rows, keys, time)
    at = lambda d, c: F.max(F.when(F.col("d") == d, F.col(c)))
    stationary = [F.coalesce(~(at(d, "p_value") >= 0.05), F.lit(True)) for d in range(DIFFERENCES)]
    trend = [F.coalesce(at(d, "trend_passes"), F.lit(True)) for d in range(2)]
    level = [F.coalesce(~(at(d, "kpss") > KPSS_5), F.lit(True)) for d in range(2)]
    order = lambda passes, other: F.coalesce(*(F.when(p, d) for d, p in enumerate(passes)), F.lit(other))
    n = F.greatest(F.coalesce(at(1, "n"), F.lit(0)) - 1, F.lit(1))
    critical = [(F.lit(a) + b / n).alias(f"critical_{k[:-1]}") for k, (a, b) in ADF_CRITICAL.items()]
    d, ndiffs = order(stationary, DIFFERENCES), F.greatest(order(trend, 2), order(level, 2))
    return found.groupBy(*keys).agg(at(1, "adf").alias("adf"), at(1, "p_value").alias("p_value"), *critical, d.cast("int").alias("d"), ndiffs.cast("int").alias("ndiffs"))
