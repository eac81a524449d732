"""Streams of forecast requests and responses. Checkpoints hold the offsets; bad rows never stop a query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import expires_at, time_frame_interval
from ..operators import forecast, joins
from ..sources import topics

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_durations(requests: DataFrame, responses: DataFrame, ttl: int = joins.START_TTL, lateness: str = "1 hour") -> DataFrame:
    """Streaming form of joins.durations: state is bounded by ttl plus lateness; unmatched responses appear, with null,
    once the watermark has passed them. A request that is delivered again within the lateness counts once; if its copies
    differ in time, the one that arrives first counts."""
    req = requests.select(F.col("request_id").alias("_id"), F.col("ts").alias("_start")).withWatermark("_start", lateness).dropDuplicatesWithinWatermark(["_id"])
    resp = responses.withWatermark("ts", lateness)
    within = (F.col("request_id") == F.col("_id")) & (F.col("ts") >= F.col("_start")) & (F.col("ts") < F.col("_start") + F.expr(f"INTERVAL {int(ttl)} SECONDS"))
    joined = resp.join(req, within, "leftOuter")
    return joined.withColumn("duration_s", (F.unix_micros("ts") - F.unix_micros("_start")) / 1e6).drop("_id", "_start")


def ttl_cache() -> StatefulProcessor:
    """The processor of stream_cache; a local class travels by value to the workers that the driver starts."""
    fields = ("at", "kind", "until", "price", "request_id")

    def row(at, kind, until, price, request) -> tuple:
        number = lambda x, of: None if x is None or x != x else of(x)
        return int(at), int(kind), number(until, int), number(price, float), number(request, str)

    def place(r: tuple) -> tuple:
        # responses before requests of their time; of responses the one that lives longest last, then the larger price
        return r[0], r[1], r[2] is not None, r[2] or 0, r[3] is not None, r[3] or 0.0, r[4] or ""

    class TtlCache(StatefulProcessor):
        """Rows wait until the watermark has passed them, so they are taken in order of time, in whatever order they arrive:
        a response becomes the key's value, a request reads it. State is what waits, and a value until its expiry."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.value = handle.getValueState("value", "until bigint, price double")
            self.waiting = handle.getListState("waiting", "at bigint, kind int, until bigint, price double, request_id string")
            self.timer = handle.getValueState("timer", "ms bigint")

        def _wake(self, micros: int) -> None:
            """One timer a key: at the first moment that something is to be done."""
            ms = micros // 1000 + 1
            if self.timer.exists():
                if self.timer.get()[0] <= ms:
                    return
                self.handle.deleteTimer(self.timer.get()[0])
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            new = [row(*r) for batch in rows for r in batch[list(fields)].astype(object).itertuples(index=False)]
            self.waiting.appendList(new)
            self._wake(min(r[0] for r in new))
            yield told([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.timer.clear()
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            known = sorted((tuple(r) for r in self.waiting.get()), key=place)
            due, rest = [r for r in known if r[0] <= passed], [r for r in known if r[0] > passed]
            held = self.value.get() if self.value.exists() else None
            out = []
            for at, kind, until, price, request in due:
                if kind == 0:
                    held = (until, price)
                else:
                    hit = held is not None and at < held[0]
                    out.append((key[0], request, hit, held[1] if hit else None))
            if rest:
                self.waiting.put(rest)
                self._wake(rest[0][0])
            else:
                self.waiting.clear()
            if held is not None and held[0] > passed:
                self.value.update(held)
                self._wake(held[0])
            elif self.value.exists():
                self.value.clear()
            yield told(out)

        def close(self) -> None:
            pass

    def told(rows: list[tuple]) -> pd.DataFrame:
        columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[], [], [], []]
        kinds = (object, object, bool, "Float64")
        return pd.DataFrame({c: pd.Series(v, dtype=t) for c, v, t in zip(("cache_key", "request_id", "hit", "cached_price"), columns, kinds, strict=True)})

    return TtlCache()


def stream_cache(requests: DataFrame, responses: DataFrame, key: str = "cache_key", lateness: str = "1 hour") -> DataFrame:
    """Streaming form of joins.cache_lookup: cache_key, request_id (a string), hit, cached_price. Needs the RocksDB state
    store. A request is answered when the watermark has passed it; rows that come within the lateness give the batch form's
    rows in whatever order they arrive. Null ids and prices stay null; later rows are dropped."""
    done = responses.filter(F.upper("status") == "COMPLETED").withColumn("_until", expires_at(F.col("ts"), F.col("time_frame"))).filter(F.col("_until").isNotNull())
    none = lambda t: F.lit(None).cast(t)
    values = done.select(F.col(key).alias("cache_key"), "ts", F.lit(0).alias("kind"), F.unix_micros("ts").alias("at"), F.unix_micros("_until").alias("until"), F.col("forecast_price").cast("double").alias("price"), none("string").alias("request_id"))
    asked = requests.select(F.col(key).alias("cache_key"), "ts", F.lit(1).alias("kind"), F.unix_micros("ts").alias("at"), none("bigint").alias("until"), none("double").alias("price"), F.col("request_id").cast("string"))
    both = values.unionByName(asked).withWatermark("ts", lateness)
    return both.groupBy("cache_key").transformWithStateInPandas(ttl_cache(), outputStructType="cache_key string, request_id string, hit boolean, cached_price double", outputMode="Append", timeMode="EventTime")


def stream_publish(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """Responses with their request's telegram_id, by a join with the static history."""
    return joins.publish_messages(responses, requests)


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataStreamWriter:
    """Write work(batch) to a folder named by the batch's id: a batch that is run again replaces its own rows only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def split_sink(stream: DataFrame, schema: str, required: tuple[str, ...], work: Callable[[DataFrame], DataFrame], out: str, rejects: str, checkpoint: str) -> DataStreamWriter:
    """Parse a stream of messages and write both sides of each batch to folders named by its id: work(rows) to out, and the
    messages that are no rows to rejects. A batch that is run again replaces its own rows only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = topics.parse(batch, schema, required)
        work(good).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def forecast_worker(candles: DataFrame, max_rows: int | None = None, securities: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """Work for each_batch: one response for every request; a key is fitted once a batch."""
    return lambda batch: forecast.forecast_requests(batch.withColumn("interval", time_frame_interval(F.col("time_frame"))), candles, max_rows, securities)


#: Buckets of ids that the request table is kept in.
BUCKETS = 32


def start_table(rows: DataFrame, table: str) -> None:
    """Write the request table that history_updater keeps: version 0, in buckets of ids."""
    rows.withColumn("bucket", _bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{table}/version=0")


def _bucket():
    return F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")


def _paths(spark: SparkSession, table: str, version: int) -> dict[int, str]:
    """The newest folder of each bucket, of those up to the version."""
    found = spark.read.parquet(table).select("version", "bucket").filter(F.col("version") <= version).groupBy("bucket").agg(F.max("version").alias("v"))
    return {r.bucket: f"{table}/version={r.v}/bucket={r.bucket}" for r in found.collect()}  # at most BUCKETS rows


def read_table(spark: SparkSession, table: str, version: int = 1 << 30) -> DataFrame:
    """The request table at a version, the newest by default."""
    return spark.read.parquet(*sorted(_paths(spark, table, version).values()))


def history_updater(spark: SparkSession, table: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch work that keeps the request table of start_table: batch k reads version k and writes version k + 1, which
    holds only the buckets of ids that the batch touches, whole or not at all. A repeated batch gives the same version.
    What the version before made out of date is removed, as no batch can be repeated that would read it."""

    def update(batch: DataFrame, batch_id: int) -> None:
        now = _paths(spark, table, batch_id)
        touched = sorted(r[0] for r in batch.select(_bucket()).distinct().collect() if r[0] in now)  # at most BUCKETS rows
        if touched:
            old = spark.read.parquet(*(now[k] for k in touched))
            new = joins.apply_responses(old, batch).withColumn("bucket", _bucket()).repartition("bucket")
            new.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/version={batch_id + 1}")
        before = _paths(spark, table, batch_id - 1)
        for k, path in before.items():
            if path != now[k]:
                _remove(spark, path)

    return update


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
