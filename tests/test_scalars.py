from pyspark.sql import functions as F

from candlewright.functions import scalars as S


def test_cache_key_of_a_known_request(spark):
    row = spark.range(1).select(S.cache_key(F.lit("RU0009029540"), F.lit("1w"), F.lit(7), F.lit(False)).alias("k")).first()
    assert row.k == "postman:forecasts:c153ed9f864d806e2ce747f51ab27515a5911818dac258b66b581285db30471b"


def test_time_frames(spark):
    df = spark.createDataFrame([(" 1H ",), ("1q",), ("60",), ("2h",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(S.time_frame_interval(F.col("t"))).collect()] == [60, 4, 60, None, None, None]
    df = spark.createDataFrame([("10",), ("x15min",), ("m",), (None,)], "t string")
    got = [r[0] and (r[0].interval, r[0].unit) for r in df.select(S.parse_time_frame(F.col("t"))).collect()]
    assert got == [(1, "0"), (15, "min"), None, None]


def test_expiry_clamps_month_ends_and_unknown_units(spark):
    df = spark.createDataFrame([("2024-01-31 00:00:00", "1mo"), ("2024-01-31 00:00:00", "1q"), ("2024-02-29 00:00:00", "1y"), ("2024-01-31 00:00:00", "30s")], "ts string, t string")
    got = [str(r[0]) for r in df.select(S.expires_at(F.col("ts").cast("timestamp"), F.col("t"))).collect()]
    assert got == ["2024-02-29 00:00:00", "None", "2025-02-28 00:00:00", "2024-01-31 00:00:30"]


def test_intervals_and_identifiers(spark):
    df = spark.createDataFrame([(1,), (4,), (5,)], "c int")
    assert [r[0] for r in df.select(S.interval_seconds(F.col("c"))).collect()] == [60, 7862400, None]
    df = spark.createDataFrame([(" a ", ""), ("a", "b"), (None, " "), (" ", " x")], "ticker string, isin string")
    assert [r.reject for r in S.validate_identifiers(df).collect()] == [None, "both identifiers", "no identifier", None]
