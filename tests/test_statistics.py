"""Sketches and binned densities against the exact forms."""

import datetime as dt

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from candlewright.operators import stats
from candlewright.plans import adapters

T = dt.datetime(2024, 1, 1)


def test_sketches_of_days_merge(spark, tmp_path):
    h = adapters.history_rows(spark, SMALL)
    more = h.unionByName(h.limit(5).withColumns({"isin": F.lit("none"), "duration_s": F.lit(None).cast("double")}))
    more = more.unionByName(h.limit(1).withColumns({"isin": F.lit(None).cast("string"), "duration_s": F.lit(2.5)}))
    stats.duration_sketches(more).write.partitionBy("day").parquet(f"{tmp_path}/sketches")
    held = spark.read.parquet(f"{tmp_path}/sketches")
    for where in ("true", "day >= '1994-01-01'", "isin = 'none'", "isin IS NULL", "false"):
        got = stats.sketch_stats(held.filter(where)).first().stats
        raw = more.withColumn("day", F.to_date("created_at")).filter(where)
        want = stats.duration_stats(raw).first().stats
        x = np.sort([r.duration_s for r in raw.collect() if r.duration_s])
        assert set(got) == set(want) and (got["mean"] is None) == (want["mean"] is None) == (len(x) == 0)
        if len(x):
            assert got["mean"] == pytest.approx(want["mean"])
            for q in (50, 95, 99):
                v = got[f"quantile {q}%"]
                assert v in x and np.mean(x < v) - 0.01 <= q / 100 <= np.mean(x <= v) + 0.01
    assert stats.sketch_stats(held, ["mean", "quantile 99.9%", "odd", "quantile 101%"]).first().stats["odd"] is None
    assert {r.isin for r in stats.sketch_stats(held, keys=["isin"]).collect()} == {r.isin for r in more.select("isin").distinct().collect()}
    # a sketch holds a bounded number of values
    big = spark.range(300_000).select(F.lit("x").alias("isin"), (1 + F.col("id")).cast("double").alias("duration_s"), F.lit(T).alias("created_at"))
    one = stats.duration_sketches(big).select(F.length("sketch").alias("b"), "n", "sketch").first()
    assert one.n == 300_000 and one.b < 60_000
    assert stats.sketch_stats(stats.duration_sketches(big)).first().stats["quantile 95%"] == pytest.approx(285_000, rel=0.01)


def test_approximate_quantiles_through_the_metric_list(spark):
    h = adapters.history_rows(spark, SMALL)
    got, want = (stats.duration_stats(h, approximate=a).first().stats for a in (True, False))
    assert got["mean"] == want["mean"] and got["quantile 95%"] == pytest.approx(want["quantile 95%"], rel=0.02)


@pytest.mark.parametrize("kind", ["normal", "outliers", "two values", "far"])
def test_density_equals_the_sum_of_all_kernels(spark, kind):
    rng = np.random.default_rng(1)
    x = {"normal": rng.normal(0, 1, 900), "outliers": np.concatenate([rng.normal(5, 0.1, 300), [1e4, -1e3]]), "two values": np.array([1.0] * 7 + [2.0]), "far": 1e6 + rng.normal(0, 1e-2, 400)}[kind]
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("a", None), ("one", 3.0), ("flat", 2.0), ("flat", 2.0)], "name string, close double")
    got = stats.kernel_density(df, points=120).orderBy("point").toPandas()
    h = len(x) ** -0.2 * x.std(ddof=1)
    at = np.linspace(x.min() - np.ptp(x) / 2, x.max() + np.ptp(x) / 2, 120)
    want = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(axis=1) / len(x) / h / np.sqrt(2 * np.pi)
    assert set(got.name) == {"a"} and np.allclose(got.x, at) and np.abs(got.density - want).max() <= 1e-9 * want.max()
