"""Topics of JSON messages: read from and written to Kafka, or files of one `value` column for tests and backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

REQUEST = "request_id string, isin string, forecast_period int, time_frame string, provide_plot boolean, ts timestamp"
RESPONSE = "request_id string, isin string, forecast_period int, time_frame string, forecast_price double, forecast_confidence double, forecast_plot string, provide_plot boolean, model string, status string, error string, ts timestamp"
PUBLISH = ("isin", "forecast_period", "time_frame", "telegram_id", "forecast_price", "forecast_confidence", "forecast_plot")


def read_topic(spark: SparkSession, source: str, where: str, topic: str | None = None, per_trigger: int = 2) -> DataFrame:
    """A stream of `value` strings: source is `kafka` (where: bootstrap servers) or `files` (where: a folder of text files)."""
    if source == "kafka":
        raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", where).option("subscribe", topic).option("startingOffsets", "earliest").load()
        return raw.select(F.col("value").cast("string").alias("value"))
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", per_trigger).text(where)


def parse(messages: DataFrame, schema: str, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, rejected values): a message is rejected if it is no JSON object or lacks a required field."""
    rows = messages.withColumn("m", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    good = F.col("m").isNotNull()
    for c in required:
        good = good & F.col(f"m.{c}").isNotNull()
    return rows.filter(good).select("m.*"), rows.filter(~F.coalesce(good, F.lit(False))).select("value")


def to_messages(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def publish(rows: DataFrame) -> DataFrame:
    """Messages of the publishing topic: its fields, null where rows have no such column; other columns are not sent."""
    have = set(rows.columns)
    return to_messages(rows.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in PUBLISH)))


def write_topic(messages: DataFrame, sink: str, where: str, checkpoint: str, topic: str | None = None) -> DataStreamWriter:
    """Writer of a stream of `value` strings to Kafka or a folder of text files."""
    writer = messages.select("value").writeStream.option("checkpointLocation", checkpoint)
    if sink == "kafka":
        return writer.format("kafka").option("kafka.bootstrap.servers", where).option("topic", topic)
    return writer.format("text").option("path", where)
