"""Long series in chunks give what the plain forms give."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from candlewright.operators import chunks, clean, features
from candlewright.plans import adapters, pipelines

T = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(3)
    rows = []
    for name, n in (("a", 700), ("b", 101), ("c", 1), (None, 260), ("d", 200)):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for i in range(n):
            hole = name == "a" and (i < 60 or 120 <= i < 260) or rng.random() < 0.1
            rows.append((name, T + dt.timedelta(minutes=int(i)), *(None if hole else float(price[i] * f) for f in (1.0, 1.01, 1.02, 0.99)), float(i % 7)))
    return spark.createDataFrame(rows, "name string, begin timestamp, open double, close double, high double, low double, volume double").repartition(5)


def same(a, b, columns, tolerance=1e-9):
    a, b = (df.select("name", "begin", *columns).toPandas().sort_values(["name", "begin"]).reset_index(drop=True) for df in (a, b))
    assert len(a) == len(b)
    for c in columns:
        x, y = a[c].astype(float), b[c].astype(float)
        assert (x.isna() == y.isna()).all(), c
        assert np.allclose(x.fillna(0), y.fillna(0), rtol=tolerance, atol=tolerance), c


def test_chunks_number_the_rows(spark, bars):
    out = chunks.chunked(bars, rows=50).withColumn("at", chunks.positions(bars, 50)).toPandas()
    for _, g in out.groupby("name", dropna=False):
        g = g.sort_values("begin")
        assert list(g["at"]) == list(range(len(g))) and (g["_at"] < 50).all()
    assert out["_chunk"].max() == 13 and len(out) == bars.count()
    assert chunks.chunked(bars.limit(0)).count() == 0 and chunks.is_long(bars, rows=699) and not chunks.is_long(bars, rows=700) and not chunks.is_long(bars.limit(0))
    with pytest.raises(ValueError, match="halo"):
        chunks.with_halo(bars, rows=10, halo=11)


@pytest.mark.parametrize("method", ["ffill", "bfill", "zero"])
def test_fills(bars, method):
    columns = ["open", "close"]
    same(chunks.fill_missing(chunks.chunked(bars, rows=40), columns, method), clean.fill_missing(bars, columns, method), columns, 0)


def test_exponential_means_against_pandas(spark, bars):
    # slow means, so that many chunks hand on; leading nulls over more than a chunk
    filled = clean.fill_missing(bars, ["close"])
    specs = {"fast": ("close", 0.5), "slow": ("close", 0.002), "one": ("close", 1.0)}
    got = chunks.ewm(chunks.chunked(filled, rows=25), specs).toPandas().sort_values(["name", "begin"])
    for _, g in got.groupby("name", dropna=False):
        for out, (column, alpha) in specs.items():
            want = g[column].ewm(alpha=alpha, adjust=False).mean()
            assert (g[out].isna() == want.isna()).all() and np.allclose(g[out].dropna(), want.dropna(), rtol=1e-9)


@pytest.mark.parametrize("rows", [64, 130])
def test_all_features(bars, rows):
    filled = clean.fill_missing(bars, pipelines.PRICES)
    plain, cut = features.all_features(filled), chunks.all_features(chunks.chunked(filled, rows=rows), rows=rows)
    columns = [c for c in plain.columns if c not in ("name", "begin")]
    assert set(columns) == set(cut.columns) - {"name", "begin", "_chunk", "_at"}
    same(cut, plain, columns)


def test_the_pipeline_in_chunks(spark):
    b = adapters.dup_bars(spark, SMALL)
    plain, cut = pipelines.featured(b), pipelines.featured(b, chunk_rows=100)
    assert "_chunk" in cut.columns and "_chunk" not in plain.columns
    same(cut, plain, [*pipelines.FEATURES, pipelines.TARGET])


def test_the_training_set_in_chunks(spark):
    b = adapters.dup_bars(spark, SMALL)
    for more in ({}, {"fit_split": "train", "stride": 7}):
        plain, cut = (pipelines.training_set(b, input_window=20, horizon=9, chunk_rows=rows, **more).toPandas().sort_values(["name", "begin"]).reset_index(drop=True) for rows in (None, 90))
        assert len(plain) == len(cut) > 10 and (plain["begin"] == cut["begin"]).all() and (plain["name"] == cut["name"]).all()
        for c in ("feature_window", "target_window"):
            assert np.allclose(np.array([np.array(list(x)) for x in plain[c]]), np.array([np.array(list(x)) for x in cut[c]]), rtol=1e-7, atol=1e-7)


def test_one_series_uses_all_tasks(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("one").alias("name"), F.timestamp_seconds(F.col("id")).alias("begin"), (F.col("id") % 97).cast("double").alias("close"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would join small partitions
    try:
        cut = chunks.chunked(df, rows=5000)
        out = chunks.ewm(chunks.fill_missing(cut, ["close"]), {"y": ("close", 0.1)})
        sizes = out.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert sizes.sum() == n and len(sizes) == 4 and sizes.max() < 0.6 * n
    want = pd.Series(np.arange(n) % 97, dtype=float).ewm(alpha=0.1, adjust=False).mean()
    got = out.orderBy("begin").select("y").toPandas()["y"]
    assert np.allclose(got, want, rtol=1e-9)
