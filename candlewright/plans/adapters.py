"""Panels and messages made from the driver's tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = ("1m", "10m", "1h", "1d", "1w", "1mo", "1q")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(rows: DataFrame, tie: list[str], *keys: str) -> DataFrame:
    at = F.struct(*tie)
    return rows.groupBy("name", *keys, "begin").agg(F.min_by("price", at).alias("open"), F.max_by("price", at).alias("close"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("amount").alias("volume"))


def bars_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.date_trunc("hour", "ts").alias("begin"), F.col("value").alias("price"), F.lit(1.0).alias("amount"), "ts", "event_id")
    return _bars(e, ["ts", "event_id"])


def bars_by_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each event type for every interval that a time frame can name."""
    from ..functions.scalars import time_frame_interval

    at = {"1m": F.date_trunc("minute", "ts"), "10m": F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600) * 600), "1h": F.date_trunc("hour", "ts"), "1d": F.date_trunc("day", "ts"), "1w": F.date_trunc("week", "ts"), "1mo": F.date_trunc("month", "ts"), "1q": F.date_trunc("quarter", "ts")}
    begins = F.array(*(F.struct(time_frame_interval(F.lit(k)).alias("interval"), v.cast("timestamp").alias("begin")) for k, v in at.items()))
    e = table(spark, sf_dir, "events").select(F.explode(begins).alias("b"), F.col("event_type").alias("name"), F.col("value").alias("price"), F.lit(1.0).alias("amount"), "ts", "event_id")
    return _bars(e.select("b.*", "name", "price", "amount", "ts", "event_id"), ["ts", "event_id"], "interval")


def bars_from_lineitem(spark: SparkSession, sf_dir: str, name: str = "l_suppkey") -> DataFrame:
    """Daily bars of each supplier (or of another column)."""
    i = table(spark, sf_dir, "lineitem").withColumns({"name": F.col(name).cast("string"), "begin": F.col("l_shipdate").cast("timestamp"), "price": F.col("l_extendedprice") / F.col("l_quantity"), "amount": F.col("l_quantity")})
    return _bars(i, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


def gappy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, h = bars_from_events(spark, sf_dir), F.hour("begin")
    return b.withColumns({"close": F.when(h % 5 != 0, F.col("close")), "open": F.when(h % 7 != 0, F.col("open"))})


def dup_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_from_events(spark, sf_dir)
    again = b.filter(F.day("begin") % 3 == 0).withColumn("close", F.col("close") + 1)
    return b.withColumn("seq", F.lit(0)).union(again.withColumn("seq", F.lit(1)))


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service's candles: hourly, the name as ticker and isin."""
    from ..functions.scalars import interval_end

    b = bars_from_events(spark, sf_dir).withColumn("interval", F.lit(60))
    return b.select(F.col("name").alias("ticker"), F.col("name").alias("isin"), "interval", "begin", interval_end(F.col("begin"), F.col("interval")).alias("end"), "open", "close", "high", "low", "volume")


def _frame(at: Column) -> Column:
    return F.get(F.array(*map(F.lit, FRAMES)), at.cast("int"))


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("FAILED")
    o = table(spark, sf_dir, "orders").withColumn("status", status)
    duration = F.when(F.col("status") == "PENDING", F.lit(None)).when(k % 50 == 0, 0.0).otherwise(F.col("o_totalprice") / 1000)
    return o.select(
        k.alias("id"), F.col("o_orderpriority").alias("isin"), _frame(k % 7).alias("time_frame"), (k % 2 == 0).alias("requested_plot"), F.lit("baseline").alias("model"), F.col("o_custkey").alias("user_id"),
        "status", F.lit(None).cast("string").alias("error"), (k % 3 == 0).alias("used_cache"), duration.alias("duration_s"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def history_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two responses for each history row."""
    h = history_rows(spark, sf_dir)
    one = h.filter("id % 2 = 0").select("id", F.col("created_at").alias("ts"), F.lit("completed").alias("status"), F.lit("arima").alias("model"), F.lit(None).cast("string").alias("error"), F.lit(1.5).alias("duration_s"))
    two = h.filter("id % 3 = 0").select("id", (F.col("created_at") + F.make_dt_interval(F.lit(1))).alias("ts"), F.lit("failed").alias("status"), F.lit(None).cast("string").alias("model"), F.lit("no data").alias("error"), F.lit(None).cast("double").alias("duration_s"))
    return one.union(two)


def _keyed(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.select(e.alias("request_id"), (F.col("user_id") % 20).cast("string").alias("isin"), _frame(e % 7).alias("time_frame"), (1 + e % 3).cast("int").alias("forecast_period"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")


def request_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(table(spark, sf_dir, "events").filter("event_type = 'click'"))


def asked_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for forecasts of the event types, one in three of a type that has no candles."""
    q = request_messages(spark, sf_dir)
    isin = F.get(F.array(*map(F.lit, ("click", "view", "none"))), (F.col("request_id") % 3).cast("int"))
    return q.select("request_id", isin.alias("isin"), "time_frame", "forecast_period", F.lit(False).alias("provide_plot"), F.col("user_id").cast("string").alias("user_id"), "ts")


def response_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer to each request, some of them after its start time has expired."""
    late = F.make_dt_interval(secs=F.floor(F.col("value") * 4).cast("decimal(18,6)"))
    return request_messages(spark, sf_dir).select("request_id", (F.col("ts") + late).alias("ts"), F.when(F.col("request_id") % 11 == 0, "failed").otherwise("completed").alias("status"))


def cached_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _keyed(table(spark, sf_dir, "events").filter("event_type = 'purchase'"))
    return r.withColumns({"status": F.when(F.col("request_id") % 11 == 0, "failed").otherwise("completed"), "forecast_price": F.col("value")}).drop("value", "user_id")


#: The same in DuckDB, as common table expressions.
_FRAMES_SQL = "['1m', '10m', '1h', '1d', '1w', '1mo', '1q']"
SQL = {
    "bars": """bars AS (SELECT event_type AS name, date_trunc('hour', ts) AS begin, first(value ORDER BY ts, event_id) AS open, last(value ORDER BY ts, event_id) AS
close, max(value) AS high, min(value) AS low, count(*)::DOUBLE AS volume FROM events GROUP BY ALL)""",
    "gappy": """gappy AS (SELECT name, begin, CASE WHEN hour(begin) % 7 <> 0 THEN open END AS open, CASE WHEN hour(begin) % 5 <> 0 THEN close END AS close, high,
low, volume FROM bars)""",
    "dup": "dup AS (SELECT *, 0 AS seq FROM bars UNION ALL SELECT name, begin, open, close + 1, high, low, volume, 1 FROM bars WHERE day(begin) % 3 = 0)",
    "candles": "candles AS (SELECT name AS ticker, name AS isin, 60 AS interval, begin, begin + to_seconds(3600) AS \"end\", open, close, high, low, volume FROM bars)",
    "hist": f"""hist AS (SELECT o_orderkey AS id, o_orderpriority AS isin, {_FRAMES_SQL}[o_orderkey % 7 + 1] AS time_frame, o_orderkey % 2 = 0 AS requested_plot,
'baseline' AS model, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status,
NULL::VARCHAR AS error, o_orderkey % 3 = 0 AS used_cache, CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_totalprice /
1000 END AS duration_s, o_orderdate AS created_at FROM orders)""",
    "hresp": """hresp AS (SELECT id, created_at AS ts, 'completed' AS status, 'arima' AS model, NULL AS error, 1.5::DOUBLE AS duration_s FROM hist WHERE id % 2 = 0
UNION ALL SELECT id, created_at + to_days(1), 'failed', NULL, 'no data', NULL FROM hist WHERE id % 3 = 0)""",
    "req": f"""req AS (SELECT event_id AS request_id, (user_id % 20)::VARCHAR AS isin, {_FRAMES_SQL}[event_id % 7 + 1] AS time_frame, (1 + event_id % 3)::INT AS
forecast_period, ts, user_id, value FROM events WHERE event_type = 'click')""",
    "asked": f"""asked AS (SELECT event_id AS request_id, ['click', 'view', 'none'][event_id % 3 + 1] AS isin, {_FRAMES_SQL}[event_id % 7 + 1] AS time_frame,
(1 + event_id % 3)::INT AS forecast_period, ts FROM events WHERE event_type = 'click')""",
    "resp": """resp AS (SELECT request_id, ts + to_seconds(floor(value * 4)::BIGINT) AS ts, CASE WHEN request_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS
status FROM req)""",
    "cached": f"""cached AS (SELECT event_id AS request_id, (user_id % 20)::VARCHAR AS isin, {_FRAMES_SQL}[event_id % 7 + 1] AS time_frame, (1 + event_id % 3)::INT AS
forecast_period, ts, CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS status, value AS forecast_price FROM events
WHERE event_type = 'purchase')""",
}
