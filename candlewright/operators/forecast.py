"""Forecasts of many series: a baseline in SQL, and order-selected ARIMA models, one (series, order) a task row.

The solver is conditional sum of squares with numpy; AIC = n ln(s2) + 2k over one common sample of a series, so orders
compare. Fits read the whole series, one float array a task, unless max_rows cuts it to its last rows. Prices of equal
times are taken in order of price. A series is gathered once, with its differencing order, and its array then goes to
a task for each order of the grid.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .joins import resolve_tickers

#: (p, q) without (0, 0), and the seasonal grid (p, d, q, P, D, Q): fixed values.
ORDERS = [(p, q) for p in range(4) for q in range(4) if (p, q) != (0, 0)]
SEASONAL = list(itertools.product((0, 1), repeat=6))
PERIOD = 7
#: 5% and other critical values of the Dickey-Fuller test with a constant, large samples and first-order correction,
#: and of the KPSS level test (published constants).
ADF_CRITICAL = {"1%": (-3.43035, -6.5393), "5%": (-2.86154, -2.8903), "10%": (-2.56677, -1.5384)}
KPSS_5 = 0.463
#: Up to so many series, of so many rows each, means of the last rows are broadcast (16 MB).
BROADCAST_SERIES, BROADCAST_PERIODS = 20_000, 100
#: Tasks that a key's requests are dealt to where answers are too many to broadcast.
SALTS = 16
#: 5% critical values of the Dickey-Fuller test with a trend by sample size (published constants).
TREND_5 = ((25, 50, 100, 250, 500, 100_000), (-3.60, -3.50, -3.45, -3.43, -3.42, -3.41))
#: Response surface of the Dickey-Fuller p-value with a constant (published constants): small and large statistics.
ADF_SMALL, ADF_LARGE, ADF_STAR, ADF_MIN, ADF_MAX = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -1.61, -18.83, 2.74


def prices(candles: DataFrame, keys: Sequence[str] = ("name",), time: str = "begin") -> DataFrame:
    """(keys, time, price): closes of a series, or its opens if it has no close at all; nulls go."""
    n = F.count("close").over(Window.partitionBy(*keys))
    return candles.withColumn("price", F.when(n > 0, F.col("close")).otherwise(F.col("open"))).filter("price IS NOT NULL").select(*keys, time, "price")


def baseline_forecast(candles: DataFrame, period: int, keys: Sequence[str] = ("name",), time: str = "begin") -> DataFrame:
    """Mean of the last max(1, min(n, period)) prices of each series; of equal times the larger price is the later one."""
    last = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col("price").desc())
    rows = prices(candles, keys, time).withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= max(1, period))
    return rows.groupBy(*keys).agg(F.avg("price").alias("forecast_price"))


def baseline_answers(requests: DataFrame, candles: DataFrame, model: str = "baseline") -> DataFrame:
    """requests (isin, forecast_period and others) with forecast_price, model, status and error by baseline_forecast.

    isin is the candles' name. Without candles, or for periods that are not positive, a request fails. Series are cut to as
    many rows as the longest period asks for, before anything is joined, so that what meets the requests is short; a
    popular isin's rows are spread by broadcasting it.
    """
    most = requests.agg(F.max("forecast_period")).first()[0] or 1
    last = Window.partitionBy("name").orderBy(F.col("begin").desc(), F.col("price").desc())
    back = prices(candles).withColumns({"_rn": F.row_number().over(last)}).filter(F.col("_rn") <= max(1, most))
    so_far = last.rowsBetween(Window.unboundedPreceding, 0)
    means = back.withColumns({"_mean": F.avg("price").over(so_far)}).groupBy(F.col("name").alias("isin")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_mean"))), lambda x: x["_mean"]).alias("_means"))
    few = means.limit(BROADCAST_SERIES + 1).count() <= BROADCAST_SERIES and most <= BROADCAST_PERIODS
    out = requests.join(F.broadcast(means) if few else means, "isin", "left")
    error = F.when(F.col("_means").isNull(), "no candles").when(F.col("forecast_period") <= 0, "period must be positive")
    price = F.when(error.isNull(), F.get("_means", F.least("forecast_period", F.size("_means")) - 1))
    done = {"forecast_price": price, "model": F.lit(model), "status": F.when(error.isNull(), "completed").otherwise("failed"), "error": error}
    return out.withColumns(done).drop("_means")


def recent(rows: DataFrame, keys: Sequence[str] = ("name",), time: str = "begin", max_rows: int | None = None) -> DataFrame:
    """The last max_rows rows of each series; all without max_rows."""
    if max_rows is None:
        return rows
    last = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return rows.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= max_rows).drop("_rn")


def adf(x: np.ndarray) -> tuple[float, float]:
    """Dickey-Fuller statistic with a constant, lags by AIC, and its p-value; NaN if the input is too short or constant."""
    n = len(x)
    if n < 6 or np.ptp(x) == 0:
        return math.nan, math.nan
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    dx = np.diff(x)

    def regress(lags: int, start: int):
        y = dx[start:]
        cols = [x[start:-1], *(dx[start - j : -j] for j in range(1, lags + 1)), np.ones(len(y))]
        a = np.column_stack(cols)
        b, *_ = np.linalg.lstsq(a, y, rcond=None)
        e = y - a @ b
        s2 = e @ e
        return a, b, s2, len(y)

    if most < 0:
        return math.nan, math.nan
    aics = []
    for lags in range(most + 1):
        a, _, s2, m = regress(lags, most)
        aics.append(m * math.log(max(s2, 1e-300) / m) + 2 * a.shape[1])
    a, b, s2, m = regress(k := int(np.argmin(aics)), k)
    try:
        se = math.sqrt(s2 / (m - a.shape[1]) * np.linalg.inv(a.T @ a)[0, 0])
    except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
        return math.nan, math.nan
    if not se > 0:
        return math.nan, math.nan
    t = b[0] / se
    if t > ADF_MAX:
        return t, 1.0
    if t < ADF_MIN:
        return t, 0.0
    c = ADF_SMALL if t <= ADF_STAR else ADF_LARGE
    return t, 0.5 * math.erfc(-sum(v * t**i for i, v in enumerate(c)) / math.sqrt(2))


def kpss(x: np.ndarray) -> float:
    """KPSS statistic around a level, with the short lag trunc(3 sqrt(n) / 13)."""
    n = len(x)
    if n < 3 or np.ptp(x) == 0:
        return math.nan
    e = x - x.mean()
    lags = min(int(3 * math.sqrt(n) / 13), n - 1)
    s2 = e @ e / n + 2 / n * sum((1 - j / (lags + 1)) * (e[j:] @ e[:-j]) for j in range(1, lags + 1))
    return float((np.cumsum(e) ** 2).sum() / n**2 / s2) if s2 > 0 else math.nan


def adf_with_trend(x: np.ndarray) -> tuple[float, float]:
    """Dickey-Fuller statistic with a constant and a trend, with trunc((n - 1)^(1/3)) lags, and its 5% critical value."""
    lags = int(np.cbrt(max(len(x) - 1, 0)) + 1e-9)
    dx = np.diff(x)
    y, n = dx[lags:], len(dx)
    if len(y) < lags + 5 or np.ptp(x) == 0:
        return math.nan, math.nan
    a = np.column_stack([x[lags:-1], np.ones(len(y)), np.arange(lags, n), *(dx[lags - j : -j] for j in range(1, lags + 1))])
    b, *_ = np.linalg.lstsq(a, y, rcond=None)
    e = y - a @ b
    try:
        se = math.sqrt(e @ e / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[0, 0])
    except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
        return math.nan, math.nan
    return (b[0] / se if se > 0 else math.nan), float(np.interp(n, *TREND_5))


def difference_order(x: np.ndarray) -> int:
    """The first of 0 to 2 whose difference the ADF test finds stationary at 5%, or cannot judge; 3 if there is none."""
    p_values = (adf(np.diff(x, n=d))[1] for d in range(3))
    return next((d for d, p in enumerate(p_values) if not p >= 0.05), 3)


def ndiffs(x: np.ndarray, most: int = 2) -> int:
    """The larger of the orders that the ADF test with a trend and the KPSS test ask for, at 5%; a test that cannot judge its
    input asks for no more."""

    def passes(y: np.ndarray) -> bool:
        t, critical = adf_with_trend(y)
        return not t >= critical

    by_adf = next((d for d in range(most) if passes(np.diff(x, n=d))), most)
    by_kpss = next((d for d in range(most) if not kpss(np.diff(x, n=d)) > KPSS_5), most)
    return max(by_adf, by_kpss)


def _poly(coefs: np.ndarray, seasonal: np.ndarray, period: int) -> np.ndarray:
    """1 - sum coefs B^i, times the same of the seasonal ones."""
    a = np.concatenate([[1.0], -coefs])
    s = np.zeros(len(seasonal) * period + 1)
    s[0] = 1.0
    s[period::period] = -seasonal
    return np.convolve(a, s)


def _residuals(y: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """e with ar(B) y = ma(B) e and e = 0 before the first."""
    u = np.convolve(y, ar)[: len(y)]
    if len(ma) == 1:
        return u
    taps = [(j, c) for j, c in enumerate(ma.tolist()) if j and c]
    e: list[float] = []
    for t, v in enumerate(u.tolist()):
        for j, c in taps:
            if j <= t:
                v -= c * e[t - j]
        if not -1e12 < v < 1e12:
            e += [1e12] * (len(u) - t)
            break
        e.append(v)
    return np.array(e)


def fit_arima(x: np.ndarray, order: tuple[int, int, int], seasonal: tuple[int, int, int] = (0, 0, 0), period: int = PERIOD, skip: int = 0) -> dict | None:
    """Conditional sum of squares by damped Gauss-Newton; None where the fit is not finite.

    skip: leading residuals that don't count, one number for all orders of a series, so that their AICs compare.
    """
    (p, d, q), (sp, sd, sq) = order, seasonal
    y = np.diff(x, n=d).astype(float)
    for _ in range(sd):
        y = y[period:] - y[:-period] if len(y) > period else y[:0]
    n_par = p + q + sp + sq
    if len(y) < max(n_par + 3, skip - (len(x) - len(y)) + n_par + 3):
        return None
    mean = y.mean() if d + sd == 0 else 0.0
    z = y - mean
    from_ = max(0, skip - (len(x) - len(y)))

    def polys(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _poly(b[:p], b[p : p + sp], period), _poly(-b[p + sp : p + sp + q], -b[p + sp + q :], period)

    def loss(b: np.ndarray) -> np.ndarray:
        return _residuals(z, *polys(b))[from_:]

    b = np.full(n_par, 0.01)
    if p and len(z) > 3 * p:
        a = np.column_stack([z[p - i - 1 : len(z) - i - 1] for i in range(p)])
        b[:p] = np.clip(np.linalg.lstsq(a, z[p:], rcond=None)[0], -0.95, 0.95)
    e = loss(b)
    s, damp = e @ e, 1e-2
    for _ in range(25 if n_par else 0):
        jac = np.column_stack([(loss(b + h) - e) / 1e-5 for h in np.eye(n_par) * 1e-5])
        step = np.linalg.lstsq(jac.T @ jac + damp * np.diag(np.maximum((jac * jac).sum(axis=0), 1e-12)), -jac.T @ e, rcond=None)[0]
        new = np.clip(b + step, -0.999, 0.999) if n_par == 1 else b + step
        ne = loss(new)
        ns = ne @ ne
        if np.isfinite(ns) and ns < s:
            done = s - ns < 1e-9 * s
            b, e, s, damp = new, ne, ns, damp / 3
            if done:
                break
        else:
            damp *= 5
            if damp > 1e6:
                break
    s2 = s / max(len(e), 1)
    if not np.isfinite(s2) or s2 >= 1e20:
        return None
    return {"aic": len(e) * math.log(max(s2, 1e-300)) + 2 * (n_par + 1 + (d + sd == 0)), "b": b, "s2": s2, "polys": polys(b), "mean": mean, "y": y, "z": z}


def predict_arima(x: np.ndarray, fit: dict, order: tuple[int, int, int], steps: int, seasonal: tuple[int, int, int] = (0, 0, 0), period: int = PERIOD) -> np.ndarray:
    """Means of the next steps."""
    ar, ma = fit["polys"]
    z, e = list(fit["z"]), list(_residuals(fit["z"], ar, ma))
    for _ in range(steps):
        v = -sum(c * z[-i] for i, c in enumerate(ar[1:], 1) if i <= len(z)) + sum(c * e[-i] for i, c in enumerate(ma[1:], 1) if i <= len(e))
        z.append(v)
        e.append(0.0)
    out = np.array(z[len(fit["z"]) :]) + fit["mean"]
    levels = [np.asarray(x, float)]
    for _ in range(order[1]):
        levels.append(np.diff(levels[-1]))
    base = [levels[-1]]
    for _ in range(seasonal[1]):
        base.append(base[-1][period:] - base[-1][:-period])
    for prev in reversed(base[:-1]):
        tail = list(prev)
        for v in out:
            tail.append(v + tail[-period])
        out = np.array(tail[len(prev) :])
    for prev in reversed(levels[:-1]):
        out = prev[-1] + np.cumsum(out)
    return out


#: A model that the jobs fit: (prices of one series in order, the series' differencing order, a point of the grid as a tuple
#: of numbers, steps) -> (label, score, predicted means), or None where it cannot be fitted. The smallest score wins.
FitPredict = Callable[[np.ndarray, int, tuple, int], tuple[str, float, Sequence[float]] | None]


def arima(x: np.ndarray, d: int, point: tuple, steps: int, skip: int = 3) -> tuple[str, float, Sequence[float]] | None:
    """ARIMA(p, d, q) for point (p, q)."""
    order = (point[0], d, point[1])
    got = fit_arima(x, order, skip=d + skip) if len(x) >= 4 else None
    return got and (str((*order, 0, 0, 0)), got["aic"], predict_arima(x, got, order, steps) if steps > 0 else [])


def sarima(x: np.ndarray, d: int, point: tuple, steps: int) -> tuple[str, float, Sequence[float]] | None:
    """ARIMA(p, d, q)(P, D, Q) of PERIOD for point (p, d, q, P, D, Q); the series' own order is not used."""
    order, season = tuple(point[:3]), tuple(point[3:])
    got = fit_arima(x, order, season, skip=2 * PERIOD + 2) if len(x) >= 4 else None
    return got and (str((*order, *season)), got["aic"], predict_arima(x, got, order, steps, season) if steps > 0 else [])


def stationarity(rows: DataFrame, max_rows: int | None = None) -> DataFrame:
    """For each series (name, begin, price): ADF report of its first difference, and differencing orders."""

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["begin", "price"])["price"].to_numpy(float)
        dx = np.diff(x)
        t, p = adf(dx)
        n = max(len(dx) - 1, 1)
        crit = {f"critical_{k[:-1]}": [a + b / n] for k, (a, b) in ADF_CRITICAL.items()}
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "adf": [t], "p_value": [p], **crit, "d": [difference_order(x)], "ndiffs": [ndiffs(x)]})

    return recent(rows, max_rows=max_rows).groupBy("name").applyInPandas(report, "name string, adf double, p_value double, critical_1 double, critical_5 double, critical_10 double, d int, ndiffs int")


def gathered(rows: DataFrame, differences: Callable[[np.ndarray], int], max_rows: int | None = None) -> DataFrame:
    """(name, prices, d, steps): each series as one array in order of time, with its differencing order."""
    steps = "steps" if "steps" in rows.columns else F.lit(0).alias("steps")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["begin", "price"])["price"].to_numpy(float)
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "prices": [x], "d": [differences(x)], "steps": [pdf["steps"].iloc[0]]})

    rows = recent(rows, max_rows=max_rows).select("name", "begin", "price", steps)
    return rows.groupBy("name").applyInPandas(gather, "name string, prices array<double>, d int, steps int")


def order_fits(rows: DataFrame, period: int | None, max_rows: int | None = None, grid: Sequence[tuple] = tuple(ORDERS), differences: Callable[[np.ndarray], int] = difference_order, model: FitPredict = arima) -> DataFrame:
    """One row for each series (name, begin, price) and point of the grid: grid_index, order (the model's label), aic (its
    score; null if the fit failed) and the forecast path.

    Every point of a series is a row of its own, so those of one series are fitted in parallel. Without a period, a series
    has its number of steps in a column `steps`. Series of too few prices fail, and an empty input has no rows.
    """
    points = list(grid)
    # orders of one series compare over one sample
    fitted = functools.partial(arima, skip=max(max(g) for g in points)) if model is arima else model

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, x, d, steps, k in zip(pdf["name"], pdf["prices"], pdf["d"], pdf["steps"], pdf["grid_index"], strict=True):
                got = fitted(np.asarray(x, float), int(d), points[k], int(steps) if period is None else period)
                ok = got is not None and np.isfinite(got[2]).all()
                out.append((name, k, got[0] if got else None, got[1] if ok else None, list(got[2]) if ok else []))
            yield pd.DataFrame(out, columns=["name", "grid_index", "order", "aic", "path"])

    # dealt by series and point, as many tasks as there are shuffle partitions
    series = gathered(rows, differences, max_rows)
    spread = series.withColumn("grid_index", F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1)))).repartition("name", "grid_index")
    return spread.mapInPandas(fit, "name string, grid_index int, `order` string, aic double, path array<double>")


def auto_forecast(candles: DataFrame, period: int, max_rows: int | None = None, grid: Sequence[tuple] = tuple(ORDERS), differences: Callable[[np.ndarray], int] = difference_order, model: FitPredict = arima, label: str = "arima") -> DataFrame:
    """forecast_price, model, order and path of each series: the last step of the point with the smallest score, or the
    baseline if none could be fitted."""
    if period <= 0:
        raise ValueError("the forecast period must be positive")
    fits = order_fits(prices(candles), period, max_rows, grid, differences, model)
    best = chosen(fits)
    base = baseline_forecast(candles, period).withColumnRenamed("forecast_price", "_base")
    out = base.join(best, "name", "left")
    return out.select("name", F.coalesce(F.element_at("path", -1), "_base").alias("forecast_price"), F.when(F.col("path").isNull(), "baseline").otherwise(label).alias("model"), "order", "path")


def chosen(fits: DataFrame) -> DataFrame:
    """(name, order, path) of the fit with the smallest score, the first in the grid on ties; fits are made once."""
    good = fits.filter(F.col("aic").isNotNull() & ~F.isnan("aic"))
    return good.groupBy("name").agg(F.min_by(F.struct("order", "path"), F.struct("aic", "grid_index")).alias("_b")).select("name", "_b.order", "_b.path")


def walk_forward(rows: DataFrame, order: tuple[int, int, int] = (1, 1, 1), test_share: float = 0.3, max_rows: int | None = None) -> DataFrame:
    """One-step forecasts over each series' test part, with 95% limits; parameters are fixed on the train part. Series whose
    train part cannot be fitted have no rows."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["begin", "price"])["price"].to_numpy(float)
        cut = int(len(x) * (1 - test_share))
        got = fit_arima(x[:cut], order) if cut >= 4 else None
        if got is None:
            return pd.DataFrame({"name": [], "step": [], "y": [], "yhat": [], "lo": [], "hi": []})
        z = np.diff(x, n=order[1]) - got["mean"]
        e = _residuals(z, *got["polys"])
        n = len(x) - cut
        yhat, width = x[cut:] - e[-n:], 1.959963984540054 * math.sqrt(got["s2"])
        return pd.DataFrame({"name": pdf["name"].iloc[0], "step": range(1, n + 1), "y": x[cut:], "yhat": yhat, "lo": yhat - width, "hi": yhat + width})

    return recent(rows, max_rows=max_rows).groupBy("name").applyInPandas(walk, "name string, step int, y double, yhat double, lo double, hi double")


def forecast_requests(requests: DataFrame, candles: DataFrame, max_rows: int | None = None, securities: DataFrame | None = None) -> DataFrame:
    """Responses of request rows (request_id, isin, interval, forecast_period): each distinct (ticker, interval) is fitted
    once, on candles of that interval, for as many steps as its longest request asks for.

    Candles are those of the isin's first security in securities (isin, secid, rank); without such a table their names are
    isins. Candles without an interval column are of one interval, which is not known, and serve all. Unknown intervals and
    keys without candles fail with an error text; all others complete. A null forecast_period counts as 1, repeated
    requests are answered each, and no requests have no answers.
    """
    asked = requests.withColumn("_n", F.greatest("forecast_period", F.lit(1)))
    asked = asked.withColumn("ticker", F.col("isin")) if securities is None else resolve_tickers(asked.drop("ticker"), securities)
    keys = ["ticker", "interval"]
    wanted = asked.filter(F.col("interval").isNotNull() & F.col("ticker").isNotNull()).groupBy(*keys).agg(F.max("_n").cast("int").alias("steps"))
    wanted = wanted.withColumn("_key", F.concat_ws("|", F.col("interval").cast("string"), "ticker"))
    rows = candles.withColumnRenamed("name", "ticker").join(wanted, keys if "interval" in candles.columns else "ticker")
    series = prices(rows.select(F.col("_key").alias("name"), "steps", "begin", "open", "close"), ("name", "steps"))
    paths = chosen(order_fits(series, None, max_rows)).select(F.col("name").alias("_key"), "path")
    last = Window.partitionBy("name").orderBy(F.col("begin").desc(), F.col("price").desc())
    mean = F.avg("price").over(last.rowsBetween(Window.unboundedPreceding, 0))
    back = series.select(F.col("name").alias("_key"), F.row_number().over(last).alias("_rn"), mean.alias("_mean"), "steps").filter("_rn <= steps")
    means = back.groupBy("_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_mean"))), lambda x: x["_mean"]).alias("_means"))
    # one row a key, fitted once and written down; a popular key's requests are not gathered to meet it
    answers = kept(wanted.select(*keys, "_key").join(means, "_key").join(paths, "_key", "left").drop("_key"), "forecasts")
    if answers.limit(BROADCAST_SERIES + 1).count() <= BROADCAST_SERIES:
        out = asked.join(F.broadcast(answers), keys, "left")
    else:
        copies = answers.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = asked.withColumn("_salt", F.pmod(F.xxhash64("request_id"), F.lit(SALTS)).cast("int")).join(copies, [*keys, "_salt"], "left").drop("_salt")
    out = out.withColumn("model", F.when(F.col("path").isNotNull(), "arima").when(F.col("_means").isNotNull(), "baseline"))
    n = F.col("_n").cast("int")
    price = F.coalesce(F.try_element_at("path", n), F.get("_means", F.least(n, F.size("_means")) - 1))
    error = F.when(F.col("interval").isNull(), "unsupported time frame").when(F.col("model").isNull(), "no candles").when(F.col("forecast_period") <= 0, "period must be positive")
    done = F.col("error").isNull()
    answers = [F.when(done, price).alias("forecast_price"), F.when(done, F.col("model")).alias("model"), F.when(done, "completed").otherwise("failed").alias("status")]
    return out.withColumn("error", error).select("request_id", "isin", "forecast_period", *answers, "error")
