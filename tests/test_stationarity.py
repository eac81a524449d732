"""Stationarity tests from sums equal those on whole series."""

import datetime as dt
import math

import numpy as np
import pytest

from candlewright.operators import forecast, stationarity

T = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(8)
    out = {}
    for n in (1, 2, 3, 5, 6, 7, 9, 13, 30, 61, 150, 400):
        e = rng.normal(0, 1, n)
        out[f"noise {n}"], out[f"walk {n}"], out[f"twice {n}"] = e, 1000 + np.cumsum(e), np.cumsum(np.cumsum(e))
    out |= {"flat": np.full(40, 7.0), "line": np.arange(50.0), "square": np.arange(50.0) ** 2, "ar": np.zeros(200)}
    for i in range(1, 200):
        out["ar"][i] = 0.6 * out["ar"][i - 1] + rng.normal()
    return out


def test_all_tests_of_all_series(spark, walks):
    rows = [(name, T + dt.timedelta(hours=i), float(v)) for name, x in walks.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "name string, begin timestamp, price double").repartition(6)
    got = {(r.name, r.d): r for r in stationarity.tests(df).collect()}
    for name, x in walks.items():
        for d in range(3):
            y = np.diff(x, n=d)
            if not len(y):
                assert (name, d) not in got
                continue
            r = got[name, d]
            if name in ("line", "square"):  # exact fits: what is left is rounding
                continue
            for mine, theirs in zip((r.adf, r.p_value, r.kpss), (*forecast.adf(y), forecast.kpss(y)), strict=True):
                assert (mine is None) == math.isnan(theirs) and (mine is None or mine == pytest.approx(theirs, rel=1e-6, abs=1e-9)), (name, d)
            t, critical = forecast.adf_with_trend(y)
            assert r.trend_passes == (not t >= critical), (name, d)
    report = {r.name: r for r in stationarity.stationarity(df).collect()}
    assert set(report) == set(walks)
    for name, x in walks.items():
        if name not in ("line", "square"):
            assert (report[name].d, report[name].ndiffs) == (forecast.difference_order(x), forecast.ndiffs(x)), name
    assert report["walk 400"].d == report["walk 400"].ndiffs == 1 and report["twice 400"].ndiffs == 2 and report["ar"].d == 0
    assert stationarity.stationarity(df.limit(0)).count() == 0
