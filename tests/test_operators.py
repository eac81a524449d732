import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewright.operators import clean, features, forecast, joins, stats
from candlewright.plans import pipelines
from candlewright.sources import candles


def panel(spark, n=301, names=("a", "b"), seed=1):
    rng = np.random.default_rng(seed)
    frames = []
    for name in names:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        frames.append(pd.DataFrame({"name": name, "begin": pd.date_range("2024-01-01", periods=n, freq="D"), "open": close * 1.001, "close": close, "high": close * 1.01, "low": close * 0.99, "volume": rng.integers(1, 100, n).astype(float)}))
    return pd.concat(frames), spark.createDataFrame(pd.concat(frames))


def test_ewm_equals_pandas_across_blocks_and_leading_nulls(spark):
    pdf, df = panel(spark, 700)
    pdf["x"] = pdf.groupby("name")["close"].diff()
    df = df.withColumn("x", F.col("close") - F.lag("close").over(clean.series()))
    got = features.ewm(df, {"y": ("x", 1 / 14), "z": ("close", 2 / 10), "one": ("close", 1.0)}).toPandas().sort_values(["name", "begin"])
    pdf = pdf.sort_values(["name", "begin"])
    for c, x, a in (("y", "x", 1 / 14), ("z", "close", 0.2), ("one", "close", 1.0)):
        want = pdf.groupby("name")[x].transform(lambda s, a=a: s.ewm(alpha=a, adjust=False).mean())
        np.testing.assert_allclose(got[c].to_numpy(float), want.to_numpy(float), atol=1e-9, equal_nan=True)


def test_rolling_features_equal_pandas_and_one_series_equals_the_panel(spark):
    pdf, df = panel(spark, 60)
    f = features.Features()
    got = df.withColumn("z", f.zscore()).toPandas().sort_values(["name", "begin"])
    g = pdf.sort_values(["name", "begin"]).groupby("name")["close"]
    want = (pdf.sort_values(["name", "begin"])["close"] - g.transform(lambda s: s.rolling(20).mean())) / g.transform(lambda s: s.rolling(20).std())
    np.testing.assert_allclose(got["z"].to_numpy(float), want.to_numpy(float), atol=1e-9, equal_nan=True)
    alone = features.all_features(df.filter("name = 'a'")).orderBy("begin").toPandas()
    both = features.all_features(df).filter("name = 'a'").orderBy("begin").toPandas()
    pd.testing.assert_frame_equal(alone, both)


def test_zero_prices_give_null(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 1.0), ("a", 2, 2.0, 0.0), ("a", 3, 1.0, 3.0)], "name string, begin int, open double, close double")
    f = features.Features()
    rows = df.select("begin", f.intraday().alias("i"), f.overnight().alias("o"), f.log_return().alias("l")).orderBy("begin").collect()
    assert [r.i for r in rows] == [None, -1.0, 2.0] and rows[2].o is None and rows[2].l is None


@pytest.mark.parametrize(("n", "want"), [(301, 111), (190, 0), (191, 1), (5, 0)])
def test_window_counts(spark, n, want):
    _, df = panel(spark, n, ("a",))
    w = clean.training_windows(df, ["close", "volume"], "close", 100, 90)
    assert w.count() == want
    if want:
        row = w.select(F.size("feature_window").alias("a"), F.size("target_window").alias("b")).first()
        assert (row.a, row.b) == (100, 90)


def test_splits_and_scaling(spark):
    pdf, df = panel(spark, 100)
    got = clean.split(df, [("train", 0.7), ("val", 0.15), ("test", 0.15)]).groupBy("name", "split").count().toPandas()
    assert sorted(got[got.name == "a"][["split", "count"]].itertuples(index=False, name=None)) == [("test", 100 - int(100 * (0.7 + 0.15))), ("train", 70), ("val", int(100 * (0.7 + 0.15)) - 70)]
    scaled = clean.scale(df.withColumn("k", F.lit(5.0)), ["close", "k"]).groupBy("name").agg(F.avg("close").alias("m"), F.max(F.abs("k")).alias("k")).collect()
    assert all(abs(r.m) < 1e-9 and r.k == 0 for r in scaled)
    assert clean.scale(df.filter("begin = '2024-01-01'"), ["close"]).first().close is None


def test_pipeline_of_empty_and_duplicated_input(spark):
    _, df = panel(spark, 230, ("a",))
    twice = df.withColumn("seq", F.lit(0)).union(df.withColumn("close", F.col("close") * 2).withColumn("seq", F.lit(1)))
    a, b = pipelines.featured(twice), pipelines.featured(df.withColumn("seq", F.lit(0)))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() > 0
    assert pipelines.training_set(df.withColumn("seq", F.lit(0)).limit(0)).count() == 0


def test_encoder_and_unseen(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 2)], "name string, begin int")
    enc = clean.fit_encoder(df)
    assert {r.name: r.ticker_id for r in enc.collect()} == {"b": 0, "a": 1, "c": 2}
    assert clean.encode(spark.createDataFrame([("z", 1)], "name string, begin int"), enc).first().ticker_id is None
    back = clean.decode(spark.createDataFrame([(2, 0.5), (0, 0.1), (7, 0.2)], "ticker_id int, yhat double"), enc)
    assert {r.yhat: r.name for r in back.collect()} == {0.5: "c", 0.1: "b", 0.2: None}


def test_durations_and_cache_at_the_limits(spark):
    t = dt.datetime(2024, 1, 1)
    req = spark.createDataFrame([(1, t), (2, t)], "request_id int, ts timestamp")
    resp = spark.createDataFrame([(1, t + dt.timedelta(seconds=600)), (2, t + dt.timedelta(seconds=599)), (3, t)], "request_id int, ts timestamp")
    assert {r.request_id: r.duration_s for r in joins.durations(req, resp).collect()} == {1: None, 2: 599.0, 3: None}
    answers = spark.createDataFrame([("k", t, "1h", "completed", 5.0), ("k", t, "1q", "completed", 9.0)], "cache_key string, ts timestamp, time_frame string, status string, forecast_price double")
    asked = spark.createDataFrame([(1, "k", t), (2, "k", t + dt.timedelta(hours=1)), (3, "k", t - dt.timedelta(seconds=1)), (4, "x", t)], "request_id int, cache_key string, ts timestamp")
    got = {r.request_id: (r.hit, r.cached_price, r.status) for r in joins.cache_lookup(asked, answers).collect()}
    assert got == {1: (True, 5.0, "COMPLETED"), 2: (False, None, "PENDING"), 3: (False, None, "PENDING"), 4: (False, None, "PENDING")}


def test_repeated_ids_and_equal_times(spark):
    t = dt.datetime(2024, 1, 1)
    asked = spark.createDataFrame([(1, t, 5), (1, t + dt.timedelta(seconds=9), 7), (2, t, None)], "request_id int, ts timestamp, telegram_id int")
    answers = spark.createDataFrame([(1, t + dt.timedelta(seconds=10)), (2, t)], "request_id int, ts timestamp")
    assert sorted((r.request_id, r.duration_s) for r in joins.durations(asked, answers).collect()) == [(1, 10.0), (2, 0.0)]
    assert sorted((r.request_id, r.telegram_id) for r in joins.publish_messages(answers, asked).collect()) == [(1, 7), (2, None)]
    cached = spark.createDataFrame([("k", t, "1h", "completed", p) for p in (5.0, 8.0, 6.0)], "cache_key string, ts timestamp, time_frame string, status string, forecast_price double")
    assert joins.cache_lookup(spark.createDataFrame([(1, "k", t)], "request_id int, cache_key string, ts timestamp"), cached).first().cached_price == 8.0
    old = spark.createDataFrame([("1", "PENDING", None, None, None)], "id string, status string, model string, error string, duration_s double")
    new = spark.createDataFrame([("1", t, s, m, None, None) for s, m in (("failed", "a"), ("completed", "b"), ("failed", "c"))], "id string, ts timestamp, status string, model string, error string, duration_s double")
    r = joins.apply_responses(old, new).first()
    assert (r.status, r.model) == ("FAILED", "c")
    securities = spark.createDataFrame([("I", "B", 1), ("I", "A", 1), ("I", "Z", 0), (None, "N", 0)], "isin string, secid string, rank int")
    got = joins.resolve_tickers(spark.createDataFrame([("I",), (None,)], "isin string"), securities.filter("rank = 1 OR isin IS NULL"))
    assert {r.isin: r.ticker for r in got.collect()} == {"I": "A", None: None}


def test_density_of_one_series_uses_many_tasks(spark):
    x = np.random.default_rng(2).normal(size=300).round(2)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0), ("b", None)], "name string, close double")
    got = stats.kernel_density(df, points=250).orderBy("point").toPandas()
    h = len(x) ** -0.2 * x.std(ddof=1)
    grid = np.linspace(x.min() - np.ptp(x) / 2, x.max() + np.ptp(x) / 2, 250)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert list(got.name.unique()) == ["a"]
    np.testing.assert_allclose(got.density, want, atol=1e-12)


def test_partial_update_keeps_old_values(spark):
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("1", "PENDING", "m0", None, None)], "id string, status string, model string, error string, duration_s double")
    new = spark.createDataFrame([("1", t, "completed", "m1", None, 2.0), ("1", t + dt.timedelta(1), "failed", None, "e", None)], "id string, ts timestamp, status string, model string, error string, duration_s double")
    r = joins.apply_responses(old, new).first()
    assert (r.status, r.model, r.error, r.duration_s) == ("FAILED", "m1", "e", 2.0)


def test_stats_edges(spark):
    df = spark.createDataFrame([(0.0,), (None,), (1.0,), (2.0,), (4.0,)], "duration_s double")
    got = stats.duration_stats(df, ["mean", "quantile 50%", "quantile 25.5%", "odd"]).first().stats
    assert got["mean"] == pytest.approx(7 / 3) and got["quantile 50%"] == 2.0 and got["odd"] is None
    assert got["quantile 25.5%"] == pytest.approx(np.quantile([1, 2, 4], 0.255))
    flat = spark.createDataFrame([("a", 3.0), ("a", 3.0)], "name string, close double")
    assert [(r.bin, r["count"]) for r in stats.histogram(flat).collect()] == [(11, 2)]
    fits = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 1.0), ("a", 0, float("nan")), ("a", 3, None)], "name string, grid_index int, aic double")
    assert stats.best_model(fits).first().grid_index == 1


def test_pacf_of_an_autoregression(spark):
    rng = np.random.default_rng(3)
    x = [0.0]
    for _ in range(3000):
        x.append(0.7 * x[-1] + rng.normal())
    df = spark.createDataFrame(pd.DataFrame({"name": "a", "begin": range(len(x)), "close": x}))
    p = stats.partial_autocorrelation(stats.autocorrelation(df, lags=5)).orderBy("lag").toPandas()["pacf"]
    assert abs(p[0] - 0.7) < 0.05 and (p[1:].abs() < 0.06).all()


def test_arima_helpers():
    rng = np.random.default_rng(0)
    e = rng.normal(size=1200)
    ar = np.zeros(1200)
    for t in range(1, 1200):
        ar[t] = 0.6 * ar[t - 1] + e[t]
    ma = e[1:] + 0.5 * e[:-1]
    assert abs(forecast.fit_arima(ar, (1, 0, 0))["b"][0] - 0.6) < 0.06
    assert abs(forecast.fit_arima(ma, (0, 0, 1))["b"][0] - 0.5) < 0.06
    assert forecast.adf(ar)[1] < 0.05 and forecast.difference_order(ar) == 0
    walk = np.cumsum(e)
    assert forecast.difference_order(walk) == 1 and forecast.ndiffs(walk) == 1
    assert np.isnan(forecast.adf(np.ones(50))[0])
    line = np.arange(100.0)
    fit = forecast.fit_arima(line, (0, 1, 0))
    assert forecast.predict_arima(line, fit, (0, 1, 0), 3) == pytest.approx([99, 99, 99])
    fit = forecast.fit_arima(line, (0, 2, 0))
    assert forecast.predict_arima(line, fit, (0, 2, 0), 3) == pytest.approx([100, 101, 102])
    week = np.tile(np.arange(7.0), 20)
    fit = forecast.fit_arima(week, (0, 0, 0), (0, 1, 0))
    assert forecast.predict_arima(week, fit, (0, 0, 0), 8, (0, 1, 0)) == pytest.approx([0, 1, 2, 3, 4, 5, 6, 0])


def test_forecast_jobs(spark):
    pdf, df = panel(spark, 60)
    flat = spark.createDataFrame([("c", dt.datetime(2024, 1, 1), 1.0, 5.0, 1.0, 1.0, 1.0)], df.schema)
    got = {r.name: r for r in forecast.auto_forecast(df.union(flat), 3).collect()}
    assert got["a"].model == "arima" and len(got["a"].path) == 3 and got["c"].model == "baseline" and got["c"].forecast_price == 5.0
    with pytest.raises(ValueError, match="positive"):
        forecast.auto_forecast(df, 0)
    walk = forecast.walk_forward(forecast.prices(df)).toPandas()
    assert len(walk) == 36 and ((walk.lo < walk.yhat) & (walk.yhat < walk.hi)).all()
    asked = spark.createDataFrame([(1, "a", 24, 2), (2, "nix", 24, 2), (3, "a", None, 2)], "request_id int, isin string, interval int, forecast_period int")
    status = {r.request_id: (r.status, r.error) for r in forecast.forecast_requests(asked, df).collect()}
    assert status == {1: ("completed", None), 2: ("failed", "no candles"), 3: ("failed", "unsupported time frame")}


def test_sources_round_trip(spark, tmp_path):
    _, df = panel(spark, 5)
    full = df.withColumn("value", F.lit(None).cast("double")).select(*(f.name for f in candles.CANDLES))
    candles.write_csv(full, f"{tmp_path}/c")
    back = candles.read_candles(spark, f"{tmp_path}/c")
    assert back.count() == 10 and back.exceptAll(full).count() == 0
    rows = spark.createDataFrame([("1", "x", "1d", True, "m", None, 7, "completed", None, False, 1.5, dt.datetime(2024, 1, 1))], candles.HISTORY)
    candles.append_history(rows, f"{tmp_path}/h")
    assert candles.read_history(spark, f"{tmp_path}/h").first().status == "COMPLETED"
    candles.clear_history(spark, f"{tmp_path}/h")
    assert candles.read_history(spark, f"{tmp_path}/h").count() == 0
    (tmp_path / "log.json").write_text('{"level": "INFO", "message": "m", "line": 3}\n{broken\n')
    assert candles.read_logs(spark, f"{tmp_path}/log.json").filter("line = 3").count() == 1
    (tmp_path / "d.csv").write_text("secid;isin;registryclosedate;value;currencyid\nSBER;RU1;2024-05-01;1.7e-05;RUB\n")
    d = candles.read_dividends(spark, f"{tmp_path}/d.csv").first()
    assert (d.name, str(d.date), d.value) == ("SBER", "2024-05-01", 1.7e-05)
    assert candles.enrich(df.drop("name"), "SBER", None, 24).first().end is not None
    with pytest.raises(ValueError, match="interval"):
        candles.enrich(df, "SBER", None, 5)
