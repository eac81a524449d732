"""Reading and writing candles, dividends, request history and service logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _S = T.DoubleType(), T.StringType()
CANDLES = T.StructType([T.StructField("begin", T.TimestampType()), T.StructField("name", _S), *(T.StructField(c, _D) for c in ("open", "close", "high", "low", "value", "volume"))])
HISTORY = T.StructType(
    [T.StructField(c, t) for c, t in (("id", _S), ("isin", _S), ("time_frame", _S), ("requested_plot", T.BooleanType()), ("model", _S), ("user_id", _S), ("telegram_id", T.LongType()), ("status", _S), ("error", _S), ("used_cache", T.BooleanType()), ("duration_s", _D), ("created_at", T.TimestampType()))]
)
LOGS = T.StructType([*(T.StructField(c, _S) for c in ("level", "message", "timestamp", "logger", "module", "function")), T.StructField("line", T.IntegerType()), *(T.StructField(c, _S) for c in ("thread_name", "exc_info", "stack_info"))])


def read_candles(spark: SparkSession, *paths: str, schema: T.StructType = CANDLES) -> DataFrame:
    """Candle history in `;`-separated files with a header; NaN becomes null."""
    df = spark.read.schema(schema).option("sep", ";").option("header", True).csv(list(paths))
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in schema if f.dataType == _D})


def write_csv(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "errorifexists") -> None:
    """A folder of `;`-separated files with headers."""
    writer = df.write.mode(mode).option("sep", ";").option("header", True)
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)


def read_dividends(spark: SparkSession, *paths: str) -> DataFrame:
    """date, name, isin, value, currencyid of `;`-separated files, by the names in each path's header: the exchange's
    (registryclosedate, secid) or these. Columns that a path lacks, and values that cannot be read, are null."""
    out = None
    for path in paths:
        df = spark.read.option("sep", ";").option("header", True).csv(path)
        have = {c.lower(): c for c in df.columns}
        pick = lambda *names: next((F.col(have[n]) for n in names if n in have), F.lit(None))  # noqa: E731, B023
        one = df.select(pick("date", "registryclosedate").try_cast("date").alias("date"), pick("name", "secid").cast("string").alias("name"), pick("isin").cast("string").alias("isin"), pick("value").try_cast("double").alias("value"), pick("currencyid").cast("string").alias("currencyid"))
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("no paths")
    return out


def original_isin(candles: DataFrame, requested: str | None) -> DataFrame:
    """Candles as a service answers with them: isin is the requested one, or empty if none was."""
    return candles.withColumn("isin", F.lit(requested or ""))


def stack(frames: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of several instruments, labelled with their name; missing columns are null."""
    out = None
    for name, df in frames.items():
        one = df.withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no instruments")
    return out


def enrich(candles: DataFrame, ticker: str, isin: str | None, interval: int = 24) -> DataFrame:
    """Raw candles with ticker, isin, interval and their end."""
    from ..functions.scalars import INTERVAL_SECONDS, interval_end

    if interval not in INTERVAL_SECONDS:
        raise ValueError(f"unknown interval {interval}")
    rows = candles.withColumns({"begin": F.col("begin").cast("timestamp"), "ticker": F.lit(ticker), "isin": F.lit(isin).cast("string"), "interval": F.lit(interval)})
    return rows.withColumn("end", interval_end(F.col("begin"), F.col("interval")))


#: Up to so many (interval, ticker) pairs, a table's partitions are chosen before the read; beyond, all are read.
CHOSEN = 5_000
#: Up to so many incoming rows, their keys are broadcast (about 100 bytes each).
BROADCAST_KEYS = 200_000


def touched_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The keys (interval, ticker, begin) of a table partitioned by interval and ticker that incoming rows may collide with.

    Only partitions that incoming rows have are listed and read, of these only row groups within the incoming range of
    begin, and of what is left, where few rows come in, only keys that these have.
    """
    key = ["interval", "ticker", "begin"]
    pairs = incoming.groupBy("interval", "ticker").agg(F.min("begin").alias("lo"), F.max("begin").alias("hi")).limit(CHOSEN + 1).collect()
    rows = existing.select(*key)
    if not pairs:
        return rows.limit(0)
    if len(pairs) <= CHOSEN:
        by_interval: dict[int, list[str]] = {}
        for r in pairs:
            by_interval.setdefault(r.interval, []).append(r.ticker)
        here = F.lit(False)
        for interval, tickers in by_interval.items():
            here = here | ((F.col("interval") == interval) & F.col("ticker").isin(tickers))
        times = [x for r in pairs for x in (r.lo, r.hi) if x is not None]
        rows = rows.filter(here)
        rows = rows.filter((F.col("begin") >= F.lit(min(times))) & (F.col("begin") <= F.lit(max(times)))) if times else rows.limit(0)
    keys = incoming.select(*key)
    return rows.join(F.broadcast(keys), key, "left_semi") if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else rows


def append_candles(spark: SparkSession, path: str, incoming: DataFrame, tie: Sequence[str]) -> None:
    """Add the incoming candles whose key (interval, ticker, begin) the table at path lacks, the first of each in the order of
    tie. The table is partitioned by interval and ticker, its files sorted by begin; rows with a null key are left out."""
    from ..operators.joins import new_candles

    key = ["interval", "ticker", "begin"]
    incoming = incoming.dropna(subset=key)
    kinds = T.StructType([f for f in incoming.schema if f.name not in tie])
    try:
        existing = spark.read.schema(kinds).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        existing = spark.createDataFrame([], kinds)
    new = new_candles(touched_rows(existing, incoming), incoming, tie, key).drop(*tie)
    new.repartition("interval", "ticker").sortWithinPartitions(*key).write.mode("append").partitionBy("interval", "ticker").parquet(path)


def load_history(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """The request history of any Spark source, as `jdbc` with url and dbtable, in the history's columns and types; columns
    that the source lacks are null."""
    df = spark.read.format(source).options(**options).load()
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in HISTORY))


def save_history(rows: DataFrame, sink: str, mode: str = "append", **options: str) -> None:
    """Append rows of the history's columns to any Spark sink; status in upper case."""
    out = rows.withColumn("status", F.upper("status")).select(*(F.col(f.name).cast(f.dataType) for f in HISTORY))
    out.write.format(sink).mode(mode).options(**options).save()


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(path)


def append_history(rows: DataFrame, path: str) -> None:
    save_history(rows, "parquet", path=path)


def clear_history(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], HISTORY).write.mode("overwrite").parquet(path)


def read_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """Service logs, one JSON object a line."""
    return spark.read.schema(LOGS).json(list(paths))
