"""Tables that grow: candles by partition, a dictionary of series, windows as rows and an index."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewright.operators import chunks, clean
from candlewright.sources import candles

T = dt.datetime(2024, 1, 1)
CANDLES = "ticker string, interval int, begin timestamp, close double, seq int"


def at(h):
    return T + dt.timedelta(hours=h)


@pytest.mark.parametrize("few", [True, False])
def test_an_upsert_reads_the_touched_partitions(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(candles, "BROADCAST_KEYS", 0)
    path = f"{tmp_path}/candles"
    rows = [(t, i, at(h), float(h), 0) for t in "abcd" for i in (1, 60) for h in range(20)]
    candles.append_candles(spark, path, spark.createDataFrame(rows, CANDLES), ["seq"])
    assert sorted(x for x in os.listdir(path) if x.startswith("interval")) == ["interval=1", "interval=60"]
    incoming = spark.createDataFrame([("a", 60, at(5), -1.0, 0), ("a", 60, at(50), 2.0, 1), ("a", 60, at(50), 1.0, 0), ("new", 1, at(0), 3.0, 0), (None, 1, at(0), 9.0, 0)], CANDLES)
    existing = spark.read.parquet(path)
    plan = candles.touched_rows(existing, incoming.dropna())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ticker" in plan.split("PartitionFilters")[1].split("]")[0] and "GreaterThanOrEqual(begin" in plan
    seen = candles.touched_rows(existing, incoming.dropna())
    assert {r.ticker for r in seen.collect()} == {"a"} and (seen.count() == 1) == few
    candles.append_candles(spark, path, incoming, ["seq"])
    got = {(r.ticker, r.interval, r.begin): r.close for r in spark.read.parquet(path).collect()}
    assert got == {r[:3]: r[3] for r in rows} | {("a", 60, at(50)): 1.0, ("new", 1, at(0)): 3.0} and spark.read.parquet(path).count() == len(got)
    candles.append_candles(spark, path, incoming.limit(0), ["seq"])
    candles.append_candles(spark, path, incoming, ["seq"])
    assert spark.read.parquet(path).count() == len(got)
    monkeypatch.setattr(candles, "CHOSEN", 1)  # too many pairs to choose by
    candles.append_candles(spark, path, incoming, ["seq"])
    assert spark.read.parquet(path).count() == len(got)


@pytest.mark.parametrize("few", [100_000, 0])
def test_ids_once_given_stay(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(clean, "FEW_SERIES", few)
    df = lambda rows: spark.createDataFrame(rows, "name string, begin timestamp").repartition(4)
    path = f"{tmp_path}/names"
    first = {r.name: r.ticker_id for r in clean.extend_encoder(df([("b", at(1)), ("a", at(2)), ("c", at(0)), ("b", at(0)), (None, at(9))]), path).collect()}
    assert first == {"b": 0, "c": 1, "a": 2, None: 3}
    later = {r.name: r.ticker_id for r in clean.extend_encoder(df([("z", at(0)), ("a", at(-5)), (None, at(-9)), *((f"n{i:03}", at(i % 7)) for i in range(200))]), path).collect()}
    assert {k: later[k] for k in first} == first and sorted(later.values()) == list(range(205))
    new = sorted((k for k in later if k not in first), key=lambda k: later[k])
    assert new == sorted(new, key=lambda k: (0 if k == "z" else int(k[1:]) % 7, k))
    assert clean.extend_encoder(df([("z", at(0))]), path).count() == 205
    encoder = clean.fit_encoder(df([("q", at(0)), ("p", at(0))]))
    assert {r.name: r.ticker_id for r in encoder.collect()} == {"p": 0, "q": 1} and clean.fit_encoder(df([]).limit(0)).count() == 0


def test_windows_as_rows_and_an_index(spark, tmp_path):
    rows = [(n, at(i), float(i), float(i * i % 17)) for n, k in (("a", 400), ("b", 50), ("c", 5)) for i in range(k)]
    df = spark.createDataFrame(rows, "name string, begin timestamp, x double, y double").repartition(3)
    cut = chunks.chunked(df, rows=70)
    chunks.save_windows(cut, f"{tmp_path}/w", ["x", "y"], "y", 30, 9, rows=70)
    for stride in (1, 4):
        got, want = (d.toPandas().sort_values(["name", "begin"]).reset_index(drop=True) for d in (chunks.load_windows(spark, f"{tmp_path}/w", stride=stride), clean.training_windows(df, ["x", "y"], "y", 30, 9, stride=stride)))
        assert len(got) == len(want) > 50 and (got["name"] == want["name"]).all() and (got["begin"] == want["begin"]).all()
        for c in ("feature_window", "target_window"):
            assert all(np.array_equal(np.array(list(a)), np.array(list(b))) for a, b in zip(got[c], want[c], strict=True))
    # each row is stored once, and the index has a row for each chunk
    assert spark.read.parquet(f"{tmp_path}/w/rows").count() == len(rows) and spark.read.parquet(f"{tmp_path}/w/index").count() == 8
    some = chunks.load_windows(spark, f"{tmp_path}/w", chosen=(F.col("name") == "a") & (F.col("_chunk") == 2)).collect()
    assert len(some) == 70 and {r.name for r in some} == {"a"}
    assert spark.read.parquet(f"{tmp_path}/w/index").agg(F.sum("length")).first()[0] == (400 - 39) + (50 - 39)
