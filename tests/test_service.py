"""The service's streams over one store: order of arrival, restarts, crashes, bad values and repeats."""

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from candlewright.functions.scalars import cache_key
from candlewright.operators import forecast, joins
from candlewright.sources import topics
from candlewright.streaming import flows, service
from candlewright.streaming.store import Files, Store

T = dt.datetime(2024, 1, 1)
AT = lambda s: T + dt.timedelta(seconds=s)
MESSAGES = "cache_key string, ts timestamp, request_id string, time_frame string, status string, forecast_price double"


def send(spark, path, rows, schema):
    topics.to_messages(spark.createDataFrame(rows, schema)).repartition(1).write.mode("append").text(path)


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, flows.ROCKSDB)
    yield
    spark.conf.set(name, old)


def test_the_cache_is_exact_in_any_order_of_arrival(spark, tmp_path, rocksdb):
    rng = random.Random(4)
    rows = []
    for _ in range(120):
        ask, at = rng.random() < 0.6, AT(rng.randrange(3000) + rng.choice([0, 0.0004]))
        status = "request" if ask else rng.choice(["completed", "completed", "failed"])
        frame = rng.choice(["1m", "10m", "1q", "999999999y", "99999999999999999999m", "9999999mo", None])
        rows.append((rng.choice(["a", "b", None]), at, str(uuid.UUID(int=rng.getrandbits(128))) if rng.random() < 0.9 else None, frame, status, None if ask or rng.random() < 0.2 else rng.random()))
    rng.shuffle(rows)
    for k in range(0, 120, 40):
        send(spark, f"{tmp_path}/in", rows[k : k + 40], MESSAGES)
    send(spark, f"{tmp_path}/in", [("end", AT(90_000_000), "end", None, "request", None)], MESSAGES)
    stream = topics.parse(topics.read_topic(spark, "files", f"{tmp_path}/in", per_trigger=1), MESSAGES, ("ts",))[0]
    out = flows.stream_cache(stream.filter("status = 'request'"), stream.filter("status <> 'request'"))
    drain(out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint"))
    got = [(str(r.cache_key), str(r.request_id), r.hit, r.cached_price) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.cache_key != "end"]
    df = spark.createDataFrame(rows, MESSAGES)
    want = joins.cache_lookup(df.filter("status = 'request'"), df.filter("status <> 'request'"))
    key = lambda r: (r[0], r[1], r[2], r[3] is not None, r[3] or 0)
    want = [(str(r.cache_key), str(r.request_id), r.hit, r.cached_price) for r in want.collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and any(r[2] for r in want)


def test_repeated_requests_multiply_no_response(spark, tmp_path):
    schema = "request_id string, ts timestamp, status string"
    asked = [("r1", AT(0), None), ("r1", AT(0), None), ("r2", AT(5), None), ("r2", AT(5), None), ("r3", AT(9), None)]
    told = [("r1", AT(30), "completed"), ("r2", AT(700), "completed"), ("r4", AT(9), "failed")]
    for name, rows in (("q", asked), ("a", told)):
        send(spark, f"{tmp_path}/{name}", rows, schema)
        send(spark, f"{tmp_path}/{name}", [("end", AT(90_000_000), None)], schema)
    read = lambda name: topics.parse(topics.read_topic(spark, "files", f"{tmp_path}/{name}", per_trigger=1), schema, ("ts",))[0]
    out = flows.stream_durations(read("q").select("request_id", "ts"), read("a"))
    drain(out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint"))
    got = sorted((r.request_id, r.duration_s) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.request_id != "end")
    df = lambda rows: spark.createDataFrame(rows, schema)
    want = sorted((r.request_id, r.duration_s) for r in joins.durations(df(asked), df(told)).collect())
    assert got == want == [("r1", 30.0), ("r2", None), ("r4", None)]


def test_no_time_frame_raises(spark):
    df = spark.createDataFrame([("999999999y",), ("9999999mo",), ("99999999w",), ("9000y",), ("4000000000000d",), ("7d",), ("1q",), ("",), (None,)], "f string")
    from candlewright.functions.scalars import expires_at

    got = [r.u for r in df.select(expires_at(F.lit(T), F.col("f")).alias("u")).collect()]
    assert got == [None] * 5 + [AT(7 * 86400)] + [None] * 3


# ---- the store ----


def rows_of(store, table="t"):
    return sorted(map(tuple, store.read(table).collect()))


def put(store, rows, batch, source="s"):
    if store.seen(source, batch):
        return
    change = store.begin()
    new = store.spark.createDataFrame(rows, "id string, n long")
    ids = change.touched(new.select("id"))
    old = change.old("t", ids)
    merged = new if old is None else new.unionByName(old.join(new.select("id"), "id", "left_anti"))
    change.replace("t", merged, "id", ids)
    change.send("log", topics.to_messages(new))
    change.close(source, batch)


def test_a_commit_touches_its_buckets_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=16)
    assert store.read("t") is None and store.versions() == []
    put(store, [(f"k{i}", i) for i in range(100)], 0)
    before = store.manifest().tables["t"][1]
    put(store, [("k7", -7), ("new", 5)], 1)
    after = store.manifest().tables["t"][1]
    ids = store.begin().touched(spark.createDataFrame([("k7",), ("new",)], "id string"))
    assert {b for b in after if after[b] != before.get(b)} == set(map(str, ids)) and len(ids) == 2
    assert rows_of(store) == sorted([(f"k{i}", i) for i in range(100) if i != 7] + [("k7", -7), ("new", 5)])
    # what is read of the table for such a change lists the files of these buckets, and no others
    files = store.begin().old("t", ids).inputFiles()
    assert files and all(any(f"_bucket={b}/" in f for b in ids) for f in files)
    assert rows_of(Store(spark, store.root, buckets=3)) == rows_of(store)  # the number of buckets stays
    # older versions can be read as long as they are kept
    assert ("k7", 7) in map(tuple, store.read("t", version=1).collect())
    for k in range(2, 9):
        put(store, [("k7", k)], k)
    assert store.versions() == [6, 7, 8, 9] and dict(rows_of(store))["k7"] == 8 and len(rows_of(store)) == 101


def test_what_is_not_committed_does_not_exist(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    put(store, [("a", 1), ("b", 2)], 0)
    real = Files.rename

    def dies(self, old, new):
        raise RuntimeError("killed")

    monkeypatch.setattr(Files, "rename", dies)  # between the write and the commit
    with pytest.raises(RuntimeError, match="killed"):
        put(store, [("a", 9), ("c", 3)], 1)
    monkeypatch.setattr(Files, "rename", real)
    again = Store(spark, store.root)
    assert rows_of(again) == [("a", 1), ("b", 2)] and spark.read.text(again.topic("log")).count() == 2

    def dies_later(self, old, new):
        if "/topics/" in new:  # between the commit and the delivery
            raise RuntimeError("killed")
        real(self, old, new)

    monkeypatch.setattr(Files, "rename", dies_later)
    with pytest.raises(RuntimeError, match="killed"):
        put(again, [("a", 9), ("c", 3)], 1)
    monkeypatch.setattr(Files, "rename", real)
    third = Store(spark, store.root)  # delivers
    put(third, [("a", 9), ("c", 3)], 1)  # the batch comes again
    assert rows_of(third) == [("a", 9), ("b", 2), ("c", 3)] and spark.read.text(third.topic("log")).count() == 4
    assert third.versions() == [1, 2]
    put(third, [("z", 1)], 0, source="another checkpoint")  # whose numbers begin anew
    assert len(rows_of(third)) == 4


# ---- the service ----

ASKED = [
    # id, isin, period, frame, plot, user, telegram, ts
    ("11111111-0000-0000-0000-000000000001", "A", 2, "1d", False, "u", 1, AT(0)),
    ("11111111-0000-0000-0000-000000000001", "A", 2, "1d", False, "u", 1, AT(0)),
    ("2", "NONE", 1, "1d", None, None, 2, AT(1)),
    ("3", "A", 2, "999999999y", None, "u", 3, AT(2)),
    ("4", "A", None, None, None, "u", None, AT(3)),
]
LATER = [
    ("5", "A", 2, "1d", False, "v", 5, AT(3600)),
    ("6", "A", 2, "1d", True, "v", 6, AT(3601)),
    ("7", "A", 2, "999999999y", None, "v", 7, AT(3602)),
    ("8", "A", 2, "1d", False, "v", 8, AT(200_000)),
    ("4", "A", 1, "1h", False, "w", 9, AT(3700)),
]


def run(spark, store, tmp_path, answer, check="c"):
    read = lambda name: topics.read_topic(spark, "files", store.topic(name), per_trigger=1000)
    service.start_front(spark, store, read("requests"), read("responses"), f"{tmp_path}/{check}-front").awaitTermination()
    service.start_worker(store, read("work"), answer, f"{tmp_path}/{check}-worker").awaitTermination()


def history(store):
    return {r.id: r for r in store.read("history").collect()}


def test_the_service_from_request_to_publication(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    candles = spark.createDataFrame([("A", AT(i), float(i), float(i)) for i in range(10)], "name string, begin timestamp, open double, close double")
    answer = lambda asked: forecast.baseline_answers(asked, candles).withColumn("ts", F.col("ts") + F.expr("INTERVAL 20 SECONDS"))
    send(spark, store.topic("requests"), ASKED, service.ASK)
    spark.createDataFrame([("{oops",), ('{"request_id": "9"}',)], "value string").repartition(1).write.mode("append").text(store.topic("requests"))
    run(spark, store, tmp_path, answer)
    got = history(store)
    assert {i: (r.status, r.used_cache, r.model, r.time_frame) for i, r in got.items()} == {ASKED[0][0]: ("PENDING", False, None, "1d"), "2": ("PENDING", False, None, "1d"), "3": ("PENDING", False, None, "999999999y"), "4": ("PENDING", False, None, "1d")}
    send(spark, store.topic("requests"), LATER, service.ASK)
    run(spark, store, tmp_path, answer)
    run(spark, Store(spark, store.root), tmp_path, answer)  # as after a restart
    got = {i: (r.status, r.used_cache, r.model, r.error, r.duration_s) for i, r in history(store).items()}
    done, hit = ("COMPLETED", False, "baseline", None, 20.0), ("COMPLETED", True, "baseline", None, 0.0)
    assert got == {ASKED[0][0]: done, "2": ("FAILED", False, "baseline", "no candles", 20.0), "3": done, "4": done, "5": hit, "6": done, "7": done, "8": done}
    sent = topics.parse(spark.read.text(store.topic("publish")), "telegram_id bigint, isin string, forecast_price double", ("isin",))[0].collect()
    assert sorted((r.telegram_id or 0, r.forecast_price) for r in sent if r.forecast_price) == [(0, 6.0), (1, 8.5), (3, 8.5), (6, 8.5), (7, 8.5), (8, 8.5)] and len(sent) == 7
    told = topics.parse(spark.read.text(store.topic("answers")), topics.RESPONSE, ("request_id",))[0].collect()
    assert [(r.request_id, r.forecast_price, r.model) for r in told] == [("5", 8.5, "baseline")]
    assert sorted(r.value for r in spark.read.text(store.topic("rejects")).collect()) == ['{"request_id": "9"}', "{oops"]
    # all over again with nothing new, and a batch that is run twice
    versions = store.versions()
    run(spark, store, tmp_path, answer)
    assert store.versions() == versions
    kind = spark.createDataFrame([("request", '{"request_id": "x", "isin": "A", "ts": "2024-01-01T00:00:00Z"}')], "kind string, value string")
    service.front(store, f"front {tmp_path}/c-front")(kind, 0)
    assert store.versions() == versions and "x" not in history(store)


def test_a_crash_in_the_middle_of_a_batch(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s", buckets=2)
    candles = spark.createDataFrame([("A", T, 1.0, 1.0)], "name string, begin timestamp, open double, close double")
    answer = lambda asked: forecast.baseline_answers(asked, candles)
    send(spark, store.topic("requests"), ASKED[:3], service.ASK)
    from candlewright.streaming import store as module

    real = module.Commit.close
    monkeypatch.setattr(module.Commit, "close", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):
        run(spark, store, tmp_path, answer)
    assert store.versions() == [] and "work" in os.listdir(f"{tmp_path}/s/topics") and not os.listdir(f"{tmp_path}/s/topics/work")
    monkeypatch.setattr(module.Commit, "close", real)
    run(spark, store, tmp_path, answer)
    run(spark, store, tmp_path, answer)
    assert {i: r.status for i, r in history(store).items()} == {ASKED[0][0]: "COMPLETED", "2": "FAILED"}
    assert spark.read.text(store.topic("publish")).count() == 2 and spark.read.text(store.topic("work")).count() == 2


def test_the_latest_values_of_a_key_are_kept(spark, tmp_path):
    # a value from the future must not hide the one that a request now finds; expired ones go
    store = Store(spark, f"file://{tmp_path}/s", buckets=1)
    work, schema = service.front(store, "f"), "request_id string, isin string, forecast_period int, time_frame string, provide_plot boolean, status string, forecast_price double, model string, ts timestamp"

    def batch(n, asked, told):
        parts = [topics.to_messages(spark.createDataFrame(rows, s)).select(F.lit(k).alias("kind"), "value") for k, rows, s in (("request", asked, service.ASK), ("response", told, schema)) if rows]
        work(parts[0] if len(parts) == 1 else parts[0].union(parts[1]), n)

    batch(0, [], [("a", "A", 1, "1d", False, "completed", 1.0, "m", AT(0)), ("b", "A", 1, "1d", False, "completed", 2.0, "m", AT(50_000)), ("c", "A", 1, "1m", False, "failed", 3.0, "m", AT(60_000))])
    batch(1, [("q1", "A", 1, "1d", False, None, None, AT(20_000))], [])
    assert store.read("cache").count() == 2
    batch(2, [("q2", "A", 1, "1d", False, None, None, AT(53_000))], [])
    assert store.read("cache").count() == 2  # q2 may be followed by a request an hour older, at which the first value counts
    batch(3, [("q3", "A", 1, "1d", False, None, None, AT(135_000)), ("q4", "A", 1, "1d", False, None, None, AT(136_400))], [])
    told = topics.parse(spark.read.text(store.topic("answers")), topics.RESPONSE, ("request_id",))[0]
    assert {r.request_id: r.forecast_price for r in told.collect()} == {"q1": 1.0, "q2": 2.0, "q3": 2.0}
    key = spark.range(1).select(cache_key(F.lit("A"), F.lit("1d"), F.lit(1), F.lit(False)).alias("k")).first().k
    assert [(r.cache_key, r.price) for r in store.read("cache").collect()] == [(key, 2.0)]
