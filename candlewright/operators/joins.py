"""Joins of requests, responses, candles and securities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import expires_at

#: A request's start time is kept for so many seconds (fixed value).
START_TTL = 600
#: A table of securities whose isins and tickers take up to so many bytes is broadcast.
BROADCAST_BYTES = 16 << 20


def new_candles(existing: DataFrame, incoming: DataFrame, tie: Sequence[str], key: Sequence[str] = ("ticker", "interval", "begin")) -> DataFrame:
    """Rows of incoming whose key is new, the first of each key in the order of tie."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*tie))
    return incoming.withColumn("_rn", first).filter("_rn = 1").drop("_rn").join(existing.select(*key), list(key), "left_anti")


def resolve_tickers(rows: DataFrame, securities: DataFrame, isin: str = "isin") -> DataFrame:
    """Adds ticker: the first security (by rank, then by name) of the isin; null if there is none or the isin is null."""
    first = securities.groupBy("isin").agg(F.min_by("secid", F.struct("rank", "secid")).alias("ticker")).withColumnRenamed("isin", "_isin")
    few = (first.agg(F.sum(F.coalesce(F.length("_isin"), F.lit(0)) + F.length("ticker") + 32)).first()[0] or 0) <= BROADCAST_BYTES
    return rows.join(F.broadcast(first) if few else first, F.col(isin) == F.col("_isin"), "left").drop("_isin")


def apply_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests after their responses (id, ts, status, model, error, duration_s): status is the last one; of the other
    fields the last non-null one, if any, replaces the old value. Of responses at one time the larger value counts.
    Responses without a request, and null ids, change nothing."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", c)))
    status = F.max_by(F.upper("status"), F.struct("ts", F.upper("status")))
    folded = responses.groupBy("id").agg(status.alias("_status"), *(last(c).alias(f"_{c}") for c in ("model", "error", "duration_s")))
    joined = requests.join(folded, "id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in ("status", "model", "error", "duration_s")}).drop("_status", "_model", "_error", "_duration_s")


def publish_messages(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """Responses with the telegram_id of their request; without one it is null. Where a request_id comes several times, the
    largest telegram_id counts, so no response is multiplied."""
    ids = requests.groupBy(F.col("request_id").alias("_id")).agg(F.max("telegram_id").alias("telegram_id"))
    return responses.join(ids, responses["request_id"] == F.col("_id"), "left").drop("_id")


def durations(requests: DataFrame, responses: DataFrame, ttl: int = START_TTL) -> DataFrame:
    """Responses (request_id, ts) with duration_s since the request; null if it came ttl seconds later, or before. Where a
    request_id comes several times, its first start counts, so no response is multiplied."""
    start = requests.groupBy(F.col("request_id").alias("_id")).agg(F.min("ts").alias("_start"))
    within = (F.col("request_id") == F.col("_id")) & (F.col("ts") >= F.col("_start")) & (F.col("ts") < F.col("_start") + F.make_dt_interval(secs=F.lit(ttl).cast("decimal(18,6)")))
    seconds = (F.unix_micros("ts") - F.unix_micros("_start")) / 1e6
    return responses.join(start, within, "left").withColumn("duration_s", seconds).drop("_id", "_start")


def cache_lookup(requests: DataFrame, responses: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests (request_id, key, ts) with hit, cached_price, used_cache and status, as of their time.

    A request hits if the last completed response of its key, at its time or before, has not expired: time frame is the
    response's life. Responses without a life are never cached; of those at one time the one that lives longest counts,
    then the one with the larger price. A null key is a key like others.
    """
    life = expires_at(F.col("ts"), F.col("time_frame"))
    value = responses.filter(F.upper("status") == "COMPLETED").withColumn("_until", life).filter(F.col("_until").isNotNull())
    value = value.select(key, "ts", F.lit(0).alias("_kind"), F.struct("_until", F.col("forecast_price").alias("price")).alias("_v"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"))
    asked = requests.select(key, "ts", F.lit(1).alias("_kind"), F.lit(None).cast(value.schema["_v"].dataType).alias("_v"), "request_id")
    w = Window.partitionBy(key).orderBy("ts", "_kind", "_v").rowsBetween(Window.unboundedPreceding, 0)
    seen = value.unionByName(asked).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_kind = 1")
    hit = F.coalesce(F.col("ts") < F.col("_last._until"), F.lit(False))
    return seen.select("request_id", key, "ts", hit.alias("hit"), F.when(hit, F.col("_last.price")).alias("cached_price"), hit.alias("used_cache"), F.when(hit, "COMPLETED").otherwise("PENDING").alias("status"))


def align(predictions: DataFrame, actuals: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Predictions (keys, step, yhat) with the actual value of the same step."""
    return predictions.join(actuals, [*keys, "step"])


def request_filter(history: DataFrame, from_date: Column | str | None = None, to_date: Column | str | None = None, **equal) -> DataFrame:
    """History rows with the given values (None: any) and created_at within the inclusive range."""
    for c, v in equal.items():
        history = history if v is None else history.filter(F.col(c) == v)
    history = history if from_date is None else history.filter(F.col("created_at") >= from_date)
    return history if to_date is None else history.filter(F.col("created_at") <= to_date)
