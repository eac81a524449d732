"""The forecast service as two chained streams over one store.

The front takes requests and responses. A request that finds a live forecast of its key becomes a COMPLETED row with
used_cache and is answered at once; any other becomes a PENDING row and goes to the topic `work`. A response fills the cache
if it is completed and its time frame has a life, updates its request's row, and is published with the request's
telegram_id. The worker reads `work` and writes to the topic `responses`, which the front reads beside the requests.

Each batch is one commit of the store: rows, cache and topics change together or not at all, and a batch that is run again
after its commit changes nothing. Within a batch things happen in order of time, responses before requests; a response
counts from the batch on in which it arrives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..operators import joins
from ..sources import topics
from .store import Store

#: What a client sends; ts is when.
ASK = "request_id string, isin string, forecast_period int, time_frame string, provide_plot boolean, user_id string, telegram_id bigint, ts timestamp"
HISTORY = "id string, isin string, time_frame string, requested_plot boolean, model string, user_id string, telegram_id bigint, status string, error string, used_cache boolean, duration_s double, created_at timestamp"
CACHE = "cache_key string, ts timestamp, until timestamp, price double, model string"
HISTORY_COLUMNS, CACHE_COLUMNS = ([f.split()[0] for f in x.split(", ")] for x in (HISTORY, CACHE))
NEEDED = ("request_id", "isin", "ts")
#: Seconds that a request may be older than the latest one, and still find what was cached at its time.
LATENESS = 3600

Worker = Callable[[DataFrame], DataFrame]


def keyed(messages: DataFrame) -> DataFrame:
    return messages.withColumn("cache_key", S.cache_key(F.col("isin"), F.col("time_frame"), F.col("forecast_period"), F.coalesce("provide_plot", F.lit(False))))


def front(store: Store, source: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch work on rows (kind, value): kind `request` or `response`, value its message.

    Messages that are no JSON, or lack an id, an isin or a time, go to the topic `rejects`; a field that cannot be read is
    null, as is the life of a time frame that is out of bounds. Of requests with one id the first in time counts, and none
    that the table has already. Responses to requests that the table does not have update nothing and are published
    without a telegram_id. source names the stream: batch numbers count within it.
    """

    def work(batch: DataFrame, number: int) -> None:
        if store.seen(source, number):
            return
        change = store.begin()
        batch = batch.persist()
        try:
            parts = {k: topics.parse(batch.filter(F.col("kind") == k).select("value"), schema, NEEDED) for k, schema in (("request", ASK), ("response", topics.RESPONSE))}
            asked = keyed(S.message_defaults(parts["request"][0]))
            first = Window.partitionBy("request_id").orderBy("ts", "cache_key")
            asked = asked.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
            answers = keyed(parts["response"][0])
            change.send("rejects", parts["request"][1].union(parts["response"][1]))
            ids = change.touched(asked.select("request_id"), answers.select("request_id"))
            held = change.old("history", ids)
            held = store.spark.createDataFrame([], HISTORY) if held is None else held
            asked = asked.join(held.select(F.col("id").alias("request_id")), "request_id", "left_anti")
            seen = _looked_up(store, change, asked, answers).persist()
            new = seen.select(
                F.col("request_id").alias("id"), "isin", "time_frame", F.col("provide_plot").alias("requested_plot"), F.when(F.col("hit"), F.col("_last.model")).alias("model"), "user_id", "telegram_id",
                F.when(F.col("hit"), "COMPLETED").otherwise("PENDING").alias("status"), F.lit(None).cast("string").alias("error"), F.col("hit").alias("used_cache"), F.when(F.col("hit"), 0.0).alias("duration_s"), F.col("ts").alias("created_at"),
            )
            rows = held.unionByName(new)
            starts = rows.filter("NOT used_cache").select(F.col("id").alias("request_id"), F.col("created_at").alias("ts"))
            timed = joins.durations(starts, answers.select("request_id", "ts", "status", "model", "error")).withColumnRenamed("request_id", "id")
            change.replace("history", joins.apply_responses(rows, timed).select(HISTORY_COLUMNS), "id", ids)
            sent = rows.select(F.col("id").alias("request_id"), "telegram_id")
            change.send("publish", topics.publish(joins.publish_messages(answers, sent)))
            change.send("work", topics.to_messages(seen.filter("NOT hit").select("request_id", "isin", "forecast_period", "time_frame", "provide_plot", "ts")))
            hits = seen.filter("hit").select("request_id", "isin", "forecast_period", "time_frame", F.col("_last.price").alias("forecast_price"), "provide_plot", F.col("_last.model").alias("model"), F.lit("completed").alias("status"), "ts")
            change.send("answers", topics.to_messages(hits))
            change.close(source, number)
            seen.unpersist()
        finally:
            batch.unpersist()

    return work


def _looked_up(store: Store, change, asked: DataFrame, answers: DataFrame) -> DataFrame:
    """asked with hit and _last (the cached forecast at its time), and the cache's table changed by the batch's answers.

    Of values at one time the one that lives longest counts, then the larger price. The table keeps what a request can
    still find that is no more than LATENESS earlier than the latest one: the last value up to then and all later ones.
    """
    done = answers.filter(F.upper("status") == "COMPLETED").withColumn("until", S.expires_at(F.col("ts"), F.col("time_frame"))).filter("until IS NOT NULL")
    fresh = done.select("cache_key", "ts", "until", F.col("forecast_price").alias("price"), "model")
    keys = change.touched(asked.select("cache_key"), fresh.select("cache_key"))
    old = change.old("cache", keys)
    values = fresh if old is None else old.unionByName(fresh)
    value = F.struct("until", "price", "model")
    tagged = values.select("cache_key", "ts", F.lit(0).alias("_kind"), value.alias("_v"))
    both = tagged.unionByName(asked.withColumns({"_kind": F.lit(1), "_v": F.lit(None).cast(tagged.schema["_v"].dataType)}), allowMissingColumns=True)
    w = Window.partitionBy("cache_key").orderBy("ts", "_kind", "_v").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_kind = 1")
    latest = asked.agg(F.unix_micros(F.max("ts"))).first()[0]
    change.marks["latest"] = max(x for x in (latest, change.marks.get("latest"), 0) if x is not None)
    low = F.timestamp_micros(F.lit(change.marks["latest"] - LATENESS * 1_000_000))
    before = F.row_number().over(Window.partitionBy("cache_key", F.col("ts") <= low).orderBy(F.col("ts").desc(), value.desc()))
    kept = values.withColumn("_rn", before).filter((F.col("ts") > low) | (F.col("_rn") == 1)).filter(F.col("until") > low)
    change.replace("cache", kept.select(CACHE_COLUMNS), "cache_key", keys)
    return seen.withColumn("hit", F.coalesce(F.col("ts") < F.col("_last.until"), F.lit(False))).drop("_kind", "_v")


def worker(store: Store, source: str, answer: Worker) -> Callable[[DataFrame, int], None]:
    """foreachBatch work on messages (value) of the topic `work`: answer's rows go to the topic `responses`."""

    def work(batch: DataFrame, number: int) -> None:
        if store.seen(source, number):
            return
        change = store.begin()
        asked, bad = topics.parse(batch, topics.REQUEST, NEEDED)
        change.send("responses", topics.to_messages(answer(asked)))
        change.send("rejects", bad)
        change.close(source, number)

    return work


def start_front(spark: SparkSession, store: Store, requests: DataFrame, responses: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """requests and responses: streams of `value`. One query takes both, so a batch is one commit."""
    both = requests.select(F.lit("request").alias("kind"), "value").union(responses.select(F.lit("response").alias("kind"), "value"))
    return both.writeStream.foreachBatch(front(store, f"front {checkpoint}")).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_worker(store: Store, work: DataFrame, answer: Worker, checkpoint: str, **trigger) -> StreamingQuery:
    return work.writeStream.foreachBatch(worker(store, f"worker {checkpoint}", answer)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
