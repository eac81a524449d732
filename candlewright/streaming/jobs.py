"""Registered stream queries: a table's rows as JSON files, read as a stream until all are taken, and the sink's rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import adapters as A
from ..operators import forecast
from ..session import shared_dir
from ..sources import topics
from . import flows, service
from .store import Store

BATCHES = 4
FAR = "2100-01-01 00:00:00"
#: Rows of a file that a stream reads.
FILE_ROWS = 50_000


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _files(rows: DataFrame, time: str = "ts", tail: DataFrame | None = None) -> tuple[str, int]:
    """(folder, files of a batch): rows as text files of JSON, BATCHES ranges of time one after the other, each written by as
    many tasks as its rows need; tail is one more batch."""
    path = f"{_folder(rows.sparkSession)}/in"
    got = rows.agg(F.percentile_approx(time, [i / BATCHES for i in range(1, BATCHES)]).alias("cuts"), F.count("*").alias("n")).first()
    files = max(1, -(-got["n"] // (BATCHES * FILE_ROWS)))
    edges = [None, *(got["cuts"] or []), None]
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = rows if lo is None else rows.filter(F.col(time) > F.lit(lo))
        part = part if hi is None else part.filter(F.col(time) <= F.lit(hi))
        topics.to_messages(part).repartition(files).write.mode("append").text(path)
    if tail is not None:
        topics.to_messages(tail).repartition(1).write.mode("append").text(path)
    return path, files


def _drain(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _sink(stream: DataFrame) -> DataFrame:
    where = _folder(stream.sparkSession)
    _drain(stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{where}/out")


def _broken_requests(spark: SparkSession, d: str) -> tuple[str, int]:
    """A topic of requests of which some are no JSON and some lack a field."""
    r = A.request_messages(spark, d)
    whole = F.struct(F.col("request_id").cast("string").alias("request_id"), "isin", "time_frame", "forecast_period")
    broken = F.when(F.col("request_id") % 17 == 0, F.lit("{oops")).when(F.col("request_id") % 19 == 0, F.to_json(F.struct("isin"))).otherwise(F.to_json(whole))
    path, files = f"{_folder(spark)}/in", max(BATCHES, -(-r.count() // FILE_ROWS))
    r.select(broken.alias("value")).repartition(files).write.text(path)
    return path, -(-files // BATCHES)


NEEDED = ("request_id", "isin", "time_frame")


def stream_parse(spark: SparkSession, d: str) -> DataFrame:
    path, files = _broken_requests(spark, d)
    good, _ = topics.parse(topics.read_topic(spark, "files", path, per_trigger=files), topics.REQUEST, NEEDED)
    return _sink(S.message_defaults(good).select(F.col("request_id").cast("bigint").alias("request_id"), "isin", "time_frame", "forecast_period", "provide_plot"))


def stream_rejects(spark: SparkSession, d: str) -> DataFrame:
    """The side output: messages that are no requests, and how often each came."""
    path, files = _broken_requests(spark, d)
    where = _folder(spark)
    raw = topics.read_topic(spark, "files", path, per_trigger=files)
    _drain(flows.split_sink(raw, topics.REQUEST, NEEDED, S.message_defaults, f"{where}/out", f"{where}/rejects", f"{where}/checkpoint"))
    return spark.read.parquet(f"{where}/rejects").groupBy("value").agg(F.count("*").alias("n"))


def _messages(spark: SparkSession, source: tuple[str, int], schema: str) -> DataFrame:
    return topics.parse(topics.read_topic(spark, "files", source[0], per_trigger=source[1]), schema, ("ts",))[0]


def stream_durations(spark: SparkSession, d: str) -> DataFrame:
    far = spark.range(1).select(F.lit(-1).cast("bigint").alias("request_id"), F.lit(FAR).cast("timestamp").alias("ts"))
    req = _files(A.request_messages(spark, d).select("request_id", "ts"), tail=far)
    resp = _files(A.response_messages(spark, d), tail=far.withColumn("status", F.lit("none")))
    joined = flows.stream_durations(_messages(spark, req, "request_id bigint, ts timestamp"), _messages(spark, resp, "request_id bigint, ts timestamp, status string"))
    return _sink(joined).filter("request_id >= 0").select("request_id", "status", F.when(F.abs("duration_s") < 5e-7, 0.0).otherwise(F.round("duration_s", 6)).alias("duration_s"))


def stream_publish(spark: SparkSession, d: str) -> DataFrame:
    """Responses enriched and published to a topic, and what a reader of it gets."""
    q = A.request_messages(spark, d)
    static = q.filter("request_id % 3 <> 0").select("request_id", F.col("user_id").alias("telegram_id"))
    answered = A.response_messages(spark, d).join(q.select("request_id", "isin", "time_frame", "forecast_period"), "request_id")
    rows = _messages(spark, _files(answered), "request_id bigint, ts timestamp, status string, isin string, time_frame string, forecast_period int")
    where = _folder(spark)
    sent = topics.publish(flows.stream_publish(rows, static))
    _drain(topics.write_topic(sent, "files", f"{where}/topic", f"{where}/checkpoint"))
    schema = "isin string, forecast_period int, time_frame string, telegram_id bigint, forecast_price double"
    got = topics.parse(spark.read.text(f"{where}/topic"), schema, ("isin",))[0]
    return got.groupBy("isin", "forecast_period", "time_frame", "telegram_id").agg(F.count("*").alias("n"))


def stream_cache(spark: SparkSession, d: str) -> DataFrame:
    key = lambda df: df.withColumn("cache_key", S.cache_key(F.col("isin"), F.col("time_frame"), F.col("forecast_period"), F.lit(False)))
    both = key(A.request_messages(spark, d)).select("cache_key", "ts", "request_id", "time_frame", F.lit("request").alias("status"), F.lit(None).cast("double").alias("forecast_price"))
    both = both.unionByName(key(A.cached_responses(spark, d)).select("cache_key", "ts", "request_id", "time_frame", "status", "forecast_price"))
    far = spark.range(1).select(F.lit("").alias("cache_key"), F.lit(FAR).cast("timestamp").alias("ts"), F.lit("none").alias("status"))
    rows = _messages(spark, _files(both, tail=far), "cache_key string, ts timestamp, request_id string, time_frame string, status string, forecast_price double")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", flows.ROCKSDB)
    try:
        out = _sink(flows.stream_cache(rows.filter("status IN ('request', 'none')"), rows.filter("status NOT IN ('request', 'none')")))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return out.filter("cache_key <> ''").select(F.col("request_id").cast("bigint").alias("request_id"), "hit", F.round("cached_price", 6).alias("cached_price"))


def stream_forecasts(spark: SparkSession, d: str) -> DataFrame:
    q = A.request_messages(spark, d).withColumn("isin", F.get(F.array(*map(F.lit, ("click", "view", "none"))), (F.col("request_id") % 3).cast("int")))
    source = _files(q.select("request_id", "isin", "time_frame", "forecast_period", "ts"))
    rows = _messages(spark, source, "request_id bigint, isin string, time_frame string, forecast_period int, ts timestamp")
    where = _folder(spark)
    _drain(flows.each_batch(rows, flows.forecast_worker(A.bars_by_interval(spark, d)), f"{where}/out", f"{where}/checkpoint"))
    return spark.read.parquet(f"{where}/out").drop("batch")


def stream_updates(spark: SparkSession, d: str) -> DataFrame:
    where = _folder(spark)
    flows.start_table(A.history_rows(spark, d), f"{where}/table")
    rows = _messages(spark, _files(A.history_responses(spark, d)), "id bigint, ts timestamp, status string, model string, error string, duration_s double")
    _drain(rows.writeStream.foreachBatch(flows.history_updater(spark, f"{where}/table")).option("checkpointLocation", f"{where}/checkpoint"))
    return flows.read_table(spark, f"{where}/table").select("id", "status", "model", "error", F.round("duration_s", 6).alias("duration_s"))


def _staged(requests: DataFrame) -> DataFrame:
    """Adds stage, 0 to BATCHES - 1: equal spans of time."""
    us = F.unix_micros("ts")
    span = requests.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    return requests.withColumn("stage", F.expr(f"{BATCHES} * (unix_micros(ts) - {lo}) div {hi - lo + 1}"))


def flow_b(spark: SparkSession, d: str) -> DataFrame:
    """Requests through the service, a span of time after the other; the worker's answers come with the next span. One row for
    each request: its row of the history, and the price that was published or answered."""
    where = _folder(spark)
    q = _staged(A.asked_forecasts(spark, d)).withColumns({"request_id": F.col("request_id").cast("string"), "telegram_id": F.col("request_id")})
    bars = A.bars_from_events(spark, d)
    late = F.make_dt_interval(secs=(F.col("request_id").cast("bigint") % 900).cast("decimal(18,6)"))
    answer = lambda asked: forecast.baseline_answers(asked, bars).withColumn("ts", F.col("ts") + late)
    store = Store(spark, f"{where}/store", buckets=8)
    files = max(1, -(-q.count() // (BATCHES * FILE_ROWS)))
    read = lambda path: topics.read_topic(spark, "files", path, per_trigger=1_000_000)
    for stage in range(BATCHES + 1):
        topics.to_messages(q.filter(F.col("stage") == stage).drop("stage")).repartition(files).write.mode("append").text(store.topic("requests"))
        service.start_front(spark, store, read(store.topic("requests")), read(store.topic("responses")), f"{where}/front").awaitTermination()
        service.start_worker(store, read(store.topic("work")), answer, f"{where}/worker").awaitTermination()
    sent = topics.parse(spark.read.text(store.topic("publish")), "telegram_id bigint, forecast_price double", ("telegram_id",))[0].select(F.col("telegram_id").cast("string").alias("id"), "forecast_price", F.lit(True).alias("published"))
    told = topics.parse(spark.read.text(store.topic("answers")), topics.RESPONSE, ("request_id",))[0].select(F.col("request_id").alias("id"), "forecast_price", F.lit(False).alias("published"))
    out = store.read("history").join(sent.union(told), "id", "left")
    return out.select(F.col("id").cast("bigint").alias("id"), "status", "used_cache", "model", "error", F.round("duration_s", 6).alias("duration_s"), "published", F.round("forecast_price", 6).alias("forecast_price"))


def _flow_b_sql() -> str:
    """Each span's requests against the values that earlier spans' misses gave."""
    stages, values = [], []
    for k in range(BATCHES):
        known = " UNION ".join(f"SELECT isin, time_frame, forecast_period, given, until FROM h{j} WHERE NOT hit AND isin <> 'none' AND until IS NOT NULL" for j in range(k))
        known = known or "SELECT isin, time_frame, forecast_period, ts AS given, ts AS until FROM q WHERE false"
        stages.append(f"""v{k} AS ({known}),
h{k} AS (SELECT q.*, coalesce(q.ts < v.until, false) AS hit, q.ts + to_seconds(request_id % 900) AS given, CASE q.time_frame WHEN '1m' THEN q.ts + to_seconds(request_id % 900) + to_minutes(1)
WHEN '10m' THEN q.ts + to_seconds(request_id % 900) + to_minutes(10) WHEN '1h' THEN q.ts + to_seconds(request_id % 900) + to_hours(1)
WHEN '1d' THEN q.ts + to_seconds(request_id % 900) + to_days(1) WHEN '1w' THEN q.ts + to_seconds(request_id % 900) + to_days(7)
WHEN '1mo' THEN q.ts + to_seconds(request_id % 900) + to_months(1) END AS until FROM q ASOF LEFT JOIN v{k} v
ON q.isin = v.isin AND q.time_frame = v.time_frame AND q.forecast_period = v.forecast_period AND q.ts >= v.given WHERE stage = {k})""")
        values.append(f"SELECT request_id, isin, forecast_period, hit FROM h{k}")
    return f"""WITH q AS (SELECT *, {BATCHES} * (epoch_us(ts) - min(epoch_us(ts)) OVER ()) // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1) AS stage FROM asked),
{", ".join(stages)},
n AS (SELECT name, close, row_number() OVER (PARTITION BY name ORDER BY begin DESC) AS k FROM bars),
m AS (SELECT name, p.k AS forecast_period, avg(close) AS price FROM n JOIN (SELECT unnest([1, 2, 3]) AS k) p ON n.k <= p.k GROUP BY ALL),
a AS ({" UNION ALL ".join(values)})
SELECT request_id AS id, CASE WHEN hit OR price IS NOT NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status, hit AS used_cache, 'baseline' AS model,
CASE WHEN price IS NULL THEN 'no candles' END AS error, CASE WHEN hit THEN 0 WHEN request_id % 900 < 600 THEN request_id % 900 END::DOUBLE AS duration_s,
NOT hit AS published, round(price, 6) AS forecast_price FROM a LEFT JOIN m ON m.name = a.isin AND m.forecast_period = a.forecast_period"""


QUERIES = {f.__name__: f for f in (stream_parse, stream_rejects, stream_durations, stream_publish, stream_cache, stream_forecasts, stream_updates, flow_b)}
#: The stream gives what its batch form gives.
ORACLES: dict[str, tuple[str, ...]] = {
    "stream_parse": ("SELECT request_id, isin, time_frame, forecast_period, false AS provide_plot FROM req WHERE request_id % 17 <> 0 AND request_id % 19 <> 0", "req"),
    "stream_durations": ("""WITH j AS (SELECT request_id, resp.status, CASE WHEN resp.ts >= req.ts AND resp.ts < req.ts + to_seconds(600) THEN (epoch_us(resp.ts) -
epoch_us(req.ts)) / 1000000.0 END::DOUBLE AS v FROM resp
JOIN req USING (request_id)) SELECT request_id, status, CASE WHEN abs(v) < 5e-7 THEN 0.0::DOUBLE ELSE round(v, 6) END AS duration_s FROM j""", "req", "resp"),
    "stream_rejects": (
        """WITH v AS (SELECT CASE WHEN request_id % 17 = 0 THEN '{oops' ELSE '{"isin":"' || isin || '"}' END AS value FROM req
WHERE request_id % 17 = 0 OR request_id % 19 = 0)
SELECT value, count(*) AS n FROM v GROUP BY value""",
        "req",
    ),
    "stream_publish": (
        """WITH p AS (SELECT req.isin, req.forecast_period, req.time_frame, CASE WHEN request_id % 3 <> 0 THEN user_id END AS telegram_id FROM resp
JOIN req USING (request_id))
SELECT isin, forecast_period, time_frame, telegram_id, count(*) AS n FROM p GROUP BY ALL""",
        "req",
        "resp",
    ),
    "stream_cache": (
        """WITH v AS (SELECT *, CASE time_frame WHEN '1m' THEN ts + to_minutes(1) WHEN '10m' THEN ts + to_minutes(10) WHEN '1h' THEN ts + to_hours(1) WHEN '1d'
THEN ts + to_days(1) WHEN '1w' THEN ts + to_days(7) WHEN '1mo' THEN ts + to_months(1) END AS until FROM cached WHERE status = 'completed'),
j AS (SELECT q.request_id, coalesce(q.ts < v.until, false) AS hit, v.forecast_price AS p FROM req q ASOF LEFT JOIN (SELECT * FROM v
WHERE until IS NOT NULL) v ON q.isin = v.isin AND q.time_frame = v.time_frame AND q.forecast_period = v.forecast_period AND q.ts >= v.ts)
SELECT request_id, hit, CASE WHEN hit THEN round(p, 6) END AS cached_price FROM j""",
        "req",
        "cached",
    ),
    "stream_updates": (
        """WITH f AS (SELECT id, upper(arg_max(status, ts)) AS status, arg_max(model, ts) FILTER (model IS NOT NULL) AS model, arg_max(error, ts) FILTER (error
IS NOT NULL) AS error, arg_max(duration_s, ts) FILTER (duration_s IS NOT NULL) AS duration_s FROM hresp GROUP BY id)
SELECT h.id, coalesce(f.status, h.status) AS status, coalesce(f.model, h.model) AS model, coalesce(f.error, h.error) AS error,
round(coalesce(f.duration_s, h.duration_s), 6) AS duration_s FROM hist h LEFT JOIN f USING (id)""",
        "hist",
        "hresp",
    ),
    "flow_b": (_flow_b_sql(), "bars", "asked"),
}
