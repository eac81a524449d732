"""Streams: sinks, side outputs, restarts, and the request table's versions."""

import datetime as dt
import os

from conftest import SMALL
from pyspark.sql import functions as F

from candlewright import registry
from candlewright.operators import forecast
from candlewright.functions.scalars import time_frame_interval
from candlewright.plans import adapters
from candlewright.sources import candles, topics
from candlewright.streaming import flows

T = dt.datetime(2024, 1, 1)


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_forecast_stream_equals_batch(spark):
    got = {r.request_id: (r.status, r.model, r.error, r.forecast_price) for r in registry.QUERIES["stream_forecasts"](spark, SMALL).collect()}
    q = adapters.request_messages(spark, SMALL).withColumn("isin", F.get(F.array(*map(F.lit, ("click", "view", "none"))), (F.col("request_id") % 3).cast("int")))
    asked = q.withColumn("interval", time_frame_interval(F.col("time_frame")))
    want = {r.request_id: (r.status, r.model, r.error, r.forecast_price) for r in forecast.forecast_requests(asked, adapters.bars_by_interval(spark, SMALL)).collect()}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()} and len(got) > 100
    assert all(v[3] is None or abs(v[3] - want[k][3]) < 1e-6 for k, v in got.items())


def test_topics_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "I", 7, "1d", 1.5, 5), ("r2", "J", 1, "1h", None, None)], "request_id string, isin string, forecast_period int, time_frame string, forecast_price double, telegram_id long")
    topics.publish(rows).write.text(f"{tmp_path}/in")
    drain(topics.write_topic(topics.read_topic(spark, "files", f"{tmp_path}/in"), "files", f"{tmp_path}/out", f"{tmp_path}/checkpoint"))
    schema = ", ".join(f"{c} {'bigint' if c == 'telegram_id' else 'int' if c == 'forecast_period' else 'double' if c == 'forecast_price' else 'string'}" for c in topics.PUBLISH)
    good, bad = topics.parse(spark.read.text(f"{tmp_path}/out"), schema, ("isin",))
    assert sorted(tuple(r) for r in good.collect()) == [("I", 7, "1d", 5, 1.5, None, None), ("J", 1, "1h", None, None, None, None)] and bad.isEmpty()
    for fields, schema in ((("request_id", "isin", "forecast_period", "time_frame"), topics.REQUEST), (("request_id", "isin", "forecast_period", "time_frame", "forecast_price"), topics.RESPONSE)):
        back, _ = topics.parse(topics.to_messages(rows.select(*fields)), schema, ("request_id",))
        assert back.select(*fields).exceptAll(rows.select(*fields)).isEmpty() and back.count() == 2


def test_rejects_go_to_their_own_folder(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    with open(f"{tmp_path}/in/a.txt", "w") as f:
        f.write('{"request_id": "1", "isin": "I"}\n{oops\n{"isin": "J"}\n[]\n')
    drain(flows.split_sink(topics.read_topic(spark, "files", f"{tmp_path}/in"), topics.REQUEST, ("request_id",), lambda rows: rows, f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/checkpoint"))
    assert [r.request_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["1"]
    assert sorted(r.value for r in spark.read.parquet(f"{tmp_path}/bad").collect()) == ["[]", '{"isin": "J"}', "{oops"]


def responses(spark, path, rows):
    df = spark.createDataFrame(rows, "id long, ts timestamp, status string, model string, error string, duration_s double")
    topics.to_messages(df).repartition(1).write.mode("append").text(path)


def test_a_restarted_stream_goes_on_where_it_stopped(spark, tmp_path):
    old = spark.createDataFrame([(i, "PENDING", "m0", None, None) for i in range(200)], "id long, status string, model string, error string, duration_s double")
    table, source = f"{tmp_path}/table", f"{tmp_path}/in"
    flows.start_table(old, table)
    schema = "id bigint, ts timestamp, status string, model string, error string, duration_s double"

    def run():
        rows = topics.parse(topics.read_topic(spark, "files", source, per_trigger=1), schema, ("ts",))[0]
        drain(rows.writeStream.foreachBatch(flows.history_updater(spark, table)).option("checkpointLocation", f"{tmp_path}/checkpoint"))

    responses(spark, source, [(1, T, "completed", "m1", None, 2.0)])
    run()
    responses(spark, source, [(1, T, "failed", None, "e", None), (2, T, "completed", "m2", None, 1.0)])
    run()
    responses(spark, source, [(999, T, "completed", "m9", None, 1.0)])
    run()
    got = {r.id: (r.status, r.model, r.error, r.duration_s) for r in flows.read_table(spark, table).collect()}
    want = {i: ("PENDING", "m0", None, None) for i in range(200)} | {1: ("FAILED", "m1", "e", 2.0), 2: ("COMPLETED", "m2", None, 1.0)}
    assert got == want
    # a batch rewrites its own buckets only, and folders that nobody can read any more are gone
    folders = [f for f in os.listdir(table) if f.startswith("version=")]
    kept = {f: {b for b in os.listdir(f"{table}/{f}") if b.startswith("bucket=")} for f in folders}
    assert len(kept["version=1"]) <= 1 and len(kept["version=2"]) <= 2 and sum(map(len, kept.values())) <= flows.BUCKETS + 2
    # the last batch once more
    before = sorted(map(tuple, flows.read_table(spark, table).collect()), key=repr)
    batch = spark.createDataFrame([(1, T, "failed", None, "e", None), (2, T, "completed", "m2", None, 1.0)], schema)
    flows.history_updater(spark, table)(batch, 1)
    assert sorted(map(tuple, flows.read_table(spark, table).collect()), key=repr) == before


def test_history_of_another_source(spark, tmp_path):
    rows = spark.createDataFrame([("1", "x", "1d", True, "m", None, 7, "completed", None, False, 1.5, T)], candles.HISTORY)
    candles.save_history(rows, "json", path=f"{tmp_path}/h")
    got = candles.load_history(spark, "json", path=f"{tmp_path}/h")
    assert got.schema.simpleString() == candles.HISTORY.simpleString() and got.first().status == "COMPLETED" and got.first().created_at == T
