"""Cleaning, encoding and splitting of panels of series. Every function runs per series (keys) in time order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import kept

KEYS, ORDER = ("name",), ("begin",)
#: Up to so many series, one task ranks them.
FEW_SERIES = 100_000


def series(keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def drop_duplicate_times(df: DataFrame, keys: Sequence[str] = KEYS, time: str = "begin", tie: Sequence[str] = ("seq",), by_time: bool = False) -> DataFrame:
    """The first row of each time of a series, in the order of tie (any of those that tie in it too). by_time: deal the rows
    by time as well, for long series; else by series, so that later windows of the series need no other exchange."""
    w = Window.partitionBy(*keys, time).orderBy(*tie)
    return (df if by_time else df.repartition(*keys)).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def fill_missing(df: DataFrame, columns: Sequence[str], method: str = "ffill", keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Fill nulls forward (`ffill`), backward (`bfill`) or, with any other method, with 0."""
    w = series(keys, order)
    if method == "ffill":
        back = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in columns})
    if method == "bfill":
        ahead = w.rowsBetween(0, Window.unboundedFollowing)
        return df.withColumns({c: F.first(c, ignorenulls=True).over(ahead) for c in columns})
    return df.fillna(0, list(columns))


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(columns))


def fit_encoder(df: DataFrame, key: str = "name", time: str = "begin", held: DataFrame | None = None) -> DataFrame:
    """(key, ticker_id): ids from 0 in order of first appearance, then of the key. A null key is a series too, and an empty
    input has none.

    held: a dictionary of an earlier fit. Its ids stay, and series that it lacks get the next ones, in the same order. The
    result holds both. Up to FEW_SERIES new series are ranked by one task, more by range: each part numbers its own, from
    the sum of the counts of the parts before.
    """
    seen = df.groupBy(key).agg(F.min(time).alias("_seen"))
    last = F.lit(0)
    if held is not None:
        old = held.select(F.col(key).alias("_held"))
        seen = seen.join(old, F.col(key).eqNullSafe(F.col("_held")), "left_anti")
        most = held.agg(F.max("ticker_id")).first()[0]
        last = F.lit(0 if most is None else most + 1)
    if seen.limit(FEW_SERIES + 1).count() <= FEW_SERIES:
        new = seen.select(key, (F.row_number().over(Window.orderBy("_seen", key)) - 1 + last).cast("int").alias("ticker_id"))
    else:
        rows = kept(seen.repartitionByRange("_seen", key).sortWithinPartitions("_seen", key).withColumn("_at", F.monotonically_increasing_id()), "names")
        rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_idx": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
        earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
        starts = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_idx").alias("_lo")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        new = rows.join(F.broadcast(starts), "_part").select(key, (F.col("_before") + F.col("_idx") - F.col("_lo") + last).cast("int").alias("ticker_id"))
    return new if held is None else held.select(key, "ticker_id").union(new)


def extend_encoder(df: DataFrame, path: str, key: str = "name", time: str = "begin") -> DataFrame:
    """The dictionary kept at path, after the series of df that it lacks are added to it; ids once given stay."""
    spark = df.sparkSession
    try:
        held = spark.read.schema(f"`{key}` {df.schema[key].dataType.simpleString()}, ticker_id int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = None
    if held is None:
        new = fit_encoder(df, key, time)
    else:
        # what is added is written apart from what is read
        new = fit_encoder(df, key, time, held).join(held.select(F.col(key).alias("_held")), F.col(key).eqNullSafe(F.col("_held")), "left_anti")
        new = kept(new, "new-names")
    new.write.mode("append").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def encode(df: DataFrame, encoder: DataFrame, key: str = "name") -> DataFrame:
    """Adds ticker_id; series that the encoder has not seen, and null keys, get null."""
    return df.join(encoder, key, "left")


def decode(df: DataFrame, encoder: DataFrame, key: str = "name") -> DataFrame:
    """Adds the series' key for its ticker_id; null for ids that the encoder has not given."""
    return df.join(encoder, "ticker_id", "left").select(*df.columns, key)


def position(keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> Column:
    return F.row_number().over(series(keys, order))


def size(keys: Sequence[str] = KEYS) -> Column:
    return F.count("*").over(Window.partitionBy(*keys))


def part_of(place: Column, n: Column, parts: Sequence[tuple[str, float]]) -> Column:
    """The part of the row with this place (from 1) of n: a part ends at floor(n x its cumulative share), the last takes the rest."""
    label, share = F.lit(parts[-1][0]), 0.0
    edges = []
    for name, ratio in parts[:-1]:
        share += ratio
        edges.append((name, share))
    for name, share in reversed(edges):
        label = F.when(place <= F.floor(n * F.lit(share)), F.lit(name)).otherwise(label)
    return label


def split(df: DataFrame, parts: Sequence[tuple[str, float]], keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds `split` by position, as part_of says."""
    df = df.withColumns({"_rn": position(keys, order), "_n": size(keys)})
    return df.withColumn("split", part_of(F.col("_rn"), F.col("_n"), parts)).drop("_rn", "_n")


def hold_out(df: DataFrame, k: int = 20, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds `split`: the last k rows of each series are `test`."""
    last = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("split", F.when(F.row_number().over(last) <= k, "test").otherwise("train"))


def trailing_range(df: DataFrame, days: int, name: str | None = None, key: str = "name", time: str = "begin") -> DataFrame:
    """Rows of the last `days` days of each series, or of one series."""
    df = df.filter(F.col(key) == name) if name is not None else df
    # a window, so that what made the rows is not computed twice
    last = F.max(time).over(Window.partitionBy(key))
    return df.withColumn("_last", last).filter(F.col(time) >= F.col("_last") - F.make_dt_interval(F.lit(days))).drop("_last")


def candle_range(candles: DataFrame, ticker: str, interval: int, start: str, end: str) -> DataFrame:
    """Candles of one ticker and interval that begin and end within the range, in order."""
    inside = (F.col("ticker") == ticker) & (F.col("interval") == interval) & (F.col("begin") >= F.lit(start).cast("timestamp")) & (F.col("end") <= F.lit(end).cast("timestamp"))
    return candles.filter(inside).orderBy("begin")


def scale(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, fit_split: str | None = None) -> DataFrame:
    """(x - mean) / (std + 1e-9) by series; statistics of all rows, or of one split only.

    The statistics are windows over the series, so what made the columns is not computed twice and no row moves again.
    """
    w = Window.partitionBy(*keys)
    fitted = lambda c: F.when(F.col("split") == fit_split, F.col(c)) if fit_split else F.col(c)
    return df.withColumns({c: (F.col(c) - F.avg(fitted(c)).over(w)) / (F.stddev_samp(fitted(c)).over(w) + F.lit(1e-9)) for c in columns})


def training_windows(df: DataFrame, features: Sequence[str], target: str, input_window: int = 100, horizon: int = 90, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, stride: int = 1) -> DataFrame:
    """feature_window (input_window rows before) and target_window (this row and those after, horizon in all).

    A series of n rows gives max(0, n - horizon - input_window) windows, every stride-th of them. Write the result at
    once: it holds each row input_window times.
    """
    w = series(keys, order)
    df = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": size(keys)})
    df = df.withColumns({"feature_window": F.collect_list(F.array(*(F.col(c).cast("double") for c in features))).over(w.rowsBetween(-input_window, -1)), "target_window": F.collect_list(F.col(target)).over(w.rowsBetween(0, horizon - 1))})
    keep = (F.col("_i") >= input_window) & (F.col("_i") < F.col("_n") - horizon) & ((F.col("_i") - input_window) % stride == 0)
    return df.filter(keep).select(*keys, *order, "feature_window", "target_window")
