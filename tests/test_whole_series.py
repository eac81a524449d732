"""Model queries use whole series, and answer each request for its own interval and period."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from candlewright import registry
from candlewright.operators import forecast
from candlewright.plans import adapters


def test_fits_read_the_whole_series(spark):
    n = forecast.prices(adapters.bars_from_events(spark, SMALL)).groupBy("name").count().collect()
    steps = {r.name: r["count"] for r in registry.QUERIES["walk_forward"](spark, SMALL).groupBy("name").count().collect()}
    assert max(r["count"] for r in n) > 0 and steps == {r.name: r["count"] - int(r["count"] * 0.7) for r in n}
    x = np.cumsum(np.random.default_rng(2).normal(size=2000))
    rows = spark.createDataFrame(pd.DataFrame({"name": "a", "begin": pd.date_range("2024-01-01", periods=2000, freq="h"), "price": x}))
    assert forecast.stationarity(rows).first().adf == forecast.adf(np.diff(x))[0]
    assert forecast.walk_forward(rows).count() == 600


def test_requests_get_their_own_interval_and_period(spark):
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    rows = [("a", 60, at(i), 1.0, float(i + (i % 3))) for i in range(60)] + [("a", 24, at(24 * i), 1.0, 500.0 - i - (i % 3)) for i in range(60)] + [("b", 24, at(24 * i), 1.0, float(i)) for i in range(3)]
    bars = spark.createDataFrame(rows, "name string, interval int, begin timestamp, open double, close double")
    asked = spark.createDataFrame([(1, "a", 60, 30), (2, "a", 24, 30), (3, "a", 7, 1), (4, "a", 60, 1), (5, "b", 24, 2), (6, "b", 24, 9)], "request_id int, isin string, interval int, forecast_period int")
    got = {r.request_id: r for r in forecast.forecast_requests(asked, bars).collect()}
    hours, days = (forecast.auto_forecast(bars.filter(f"name = 'a' AND interval = {k}"), 30).first().path for k in (60, 24))
    assert [got[i].forecast_price for i in (1, 2, 4)] == pytest.approx([hours[29], days[29], hours[0]]) and got[2].forecast_price > got[1].forecast_price + 100
    assert (got[3].status, got[3].error) == ("failed", "no candles")
    assert [(got[i].model, got[i].forecast_price) for i in (5, 6)] == [("baseline", 1.5), ("baseline", 1.0)]


def test_the_stepwise_grid_reaches_order_ten_and_both_tests_choose_d(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(forecast, "auto_forecast", lambda *a, **k: seen.update(k) or a[0])
    registry.QUERIES["arima_stepwise_bound"](spark, SMALL)
    assert set(seen["grid"]) == {(p, q) for p in range(11) for q in range(11)} - {(0, 0)}
    rows = spark.createDataFrame(pd.DataFrame({"name": "a", "begin": pd.date_range("2024-01-01", periods=80, freq="h"), "price": np.random.default_rng(1).normal(size=80)}))
    fits = forecast.order_fits(rows, 1, grid=[(1, 0)], differences=lambda x: 2)
    assert seen["differences"] is forecast.ndiffs and fits.select(F.col("order")).first()[0].startswith("(1, 2, 0")


def test_jobs_accept_other_models(spark):
    """A model is a function of a series, its d, a point of the grid and the steps."""

    def drift(x, d, point, steps):
        slope = (x[-1] - x[-1 - point[0]]) / point[0]
        return f"drift {point[0]}", abs(slope - 2.0), [x[-1] + slope * k for k in range(1, steps + 1)]

    bars = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 1.0, float(2 * i + (i == 57))) for i in range(60)], "name string, begin timestamp, open double, close double")
    got = forecast.auto_forecast(bars, 3, grid=[(1,), (2,), (3,)], model=drift, label="drift").first()
    assert (got.model, got.order, got.path, got.forecast_price) == ("drift", "drift 1", [120.0, 122.0, 124.0], 124.0)


def test_requests_find_candles_by_the_first_security_of_their_isin(spark):
    bars = spark.createDataFrame([(n, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 1.0, p) for n, p in (("T1", 10.0), ("T2", 20.0)) for i in range(3)], "name string, begin timestamp, open double, close double")
    securities = spark.createDataFrame([("I", "T2", 2), ("I", "T1", 1), ("J", "T2", 1)], "isin string, secid string, rank int")
    asked = spark.createDataFrame([(1, "I", 24, 1), (2, "J", 24, 1), (3, "K", 24, 1)], "request_id int, isin string, interval int, forecast_period int")
    got = {r.request_id: (r.isin, r.forecast_price, r.error) for r in forecast.forecast_requests(asked, bars, securities=securities).collect()}
    assert got == {1: ("I", 10.0, None), 2: ("J", 20.0, None), 3: ("K", None, "no candles")}


def test_periods_and_intervals_equal_fits_of_single_series(spark):
    rng = np.random.default_rng(4)
    series = {("a", 60): np.cumsum(rng.normal(size=90)) + 50, ("a", 24): np.cumsum(rng.normal(size=70)) + 90}
    at = lambda k, i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * (1 if k == 60 else 24))
    bars = spark.createDataFrame([(n, k, at(k, i), 1.0, float(v)) for (n, k), x in series.items() for i, v in enumerate(x)], "name string, interval int, begin timestamp, open double, close double")
    asked = [(i, "a", k, p) for i, (k, p) in enumerate((k, p) for k in (60, 24) for p in (1, 7, 20))]
    got = {r.request_id: r.forecast_price for r in forecast.forecast_requests(spark.createDataFrame(asked, "request_id int, isin string, interval int, forecast_period int"), bars).collect()}
    for i, name, k, p in asked:
        x, d = series[(name, k)], forecast.difference_order(series[(name, k)])
        fits = [(f["aic"], j, g, f) for j, g in enumerate(forecast.ORDERS) if (f := forecast.fit_arima(x, (g[0], d, g[1]), skip=d + 3))]
        _, _, g, best = min(fits, key=lambda f: f[:2])
        assert got[i] == pytest.approx(forecast.predict_arima(x, best, (g[0], d, g[1]), p)[-1])


def test_conditional_sum_of_squares_equals_a_plain_search():
    rng = np.random.default_rng(9)
    e, y = rng.normal(size=400), np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.5 * y[t - 1] + e[t] + 0.4 * e[t - 1]
    fit = forecast.fit_arima(y, (1, 0, 1), skip=1)

    def loss(a, b):
        z, r = y - y.mean(), [0.0] * len(y)
        for t in range(len(z)):
            r[t] = z[t] - (a * z[t - 1] + b * r[t - 1] if t else 0.0)
        return sum(v * v for v in r[1:])

    a, b = 0.0, 0.0
    for h in (0.1, 0.03, 0.01, 0.003, 0.001):
        while True:
            best = min(((loss(a + i * h, b + j * h), a + i * h, b + j * h) for i in (-1, 0, 1) for j in (-1, 0, 1)), key=lambda v: v[0])
            if (best[1], best[2]) == (a, b):
                break
            a, b = best[1:]
    assert fit["b"] == pytest.approx([a, b], abs=2e-3) and fit["s2"] * 399 == pytest.approx(loss(a, b), rel=1e-5)


def test_stationarity_tests_by_their_definitions():
    rng = np.random.default_rng(6)
    x = np.cumsum(rng.normal(size=120))
    n, lags = len(x), int(3 * np.sqrt(120) / 13)
    e = x - x.mean()
    var = (e**2).sum() / n + sum(2 * (1 - j / (lags + 1)) * sum(e[t] * e[t - j] for t in range(j, n)) / n for j in range(1, lags + 1))
    assert forecast.kpss(x) == pytest.approx((np.cumsum(e) ** 2).sum() / n**2 / var)
    k = int((n - 1) ** (1 / 3))
    dx = np.diff(x)
    rows = [[x[t], 1.0, t, *(dx[t - j] for j in range(1, k + 1))] for t in range(k, n - 1)]
    a, y = np.array(rows), dx[k:]
    b = np.linalg.solve(a.T @ a, a.T @ y)
    s2 = ((y - a @ b) ** 2).sum() / (len(y) - a.shape[1])
    assert forecast.adf_with_trend(x)[0] == pytest.approx(b[0] / np.sqrt(s2 * np.linalg.inv(a.T @ a)[0, 0]), rel=1e-6)
    noise = rng.normal(size=(20, 200))
    for k, rows in enumerate((noise, np.cumsum(noise, axis=1), np.cumsum(np.cumsum(noise, axis=1), axis=1))):
        assert np.median([forecast.ndiffs(v) for v in rows]) == k
