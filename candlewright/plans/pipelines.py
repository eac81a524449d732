"""The training pipeline: clean, encode, add features, drop nulls, scale, cut windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks, clean, features
from ..session import kept

FEATURES = ("ticker_id", "open", "close", "high", "low", "volume", "return", "volatility", "rsi", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bb_width", "ma_20", "ema_20", "intraday", "overnight", "amplitude", "day_of_week", "month")
TARGET = "log_return"


PRICES = ("open", "close", "high", "low", "volume")


def featured(bars: DataFrame, tie: Sequence[str] = ("seq",), chunk_rows: int | None = None) -> DataFrame:
    """Clean bars with all features and without null rows, not scaled. Where a series has more than chunk_rows rows
    (chunks.CHUNK_ROWS), all are worked in chunks, and _chunk and _at give a row's place."""
    rows = chunk_rows or chunks.CHUNK_ROWS
    # one small row a series, of raw bars: cleaning changes neither its first time nor, but for repeats, its length
    seen = kept(bars.groupBy("name").agg(F.min("begin").alias("begin"), F.count("*").alias("n")), "series")
    if (seen.agg(F.max("n")).first()[0] or 0) > rows:
        df = chunks.chunked(clean.drop_duplicate_times(bars, tie=tie, by_time=True).drop(*tie), rows=rows)
        df = chunks.all_features(chunks.fill_missing(df, PRICES), rows=rows)
    else:
        df = clean.drop_duplicate_times(bars, tie=tie).drop(*tie)
        df = features.all_features(clean.fill_missing(df, PRICES))
    df = clean.encode(df, clean.fit_encoder(seen))
    return clean.drop_nulls(df, [*FEATURES, TARGET])


SPLITS = [("train", 0.7), ("val", 0.15), ("test", 0.15)]


def training_set(bars: DataFrame, tie: Sequence[str] = ("seq",), input_window: int = 100, horizon: int = 90, fit_split: str | None = None, stride: int = 1, chunk_rows: int | None = None) -> DataFrame:
    """Scaled training windows. Long series stay in chunks all the way; rows are numbered again without those that had nulls."""
    df = featured(bars, tie, chunk_rows)
    if chunks.CHUNK not in df.columns:
        df = clean.scale(clean.split(df, SPLITS), FEATURES, fit_split=fit_split)
        return clean.training_windows(df, FEATURES, TARGET, input_window, horizon, stride=stride)
    df = chunks.split(chunks.chunked(df.drop(chunks.CHUNK, "_at"), rows=chunk_rows), SPLITS, rows=chunk_rows)
    df = chunks.scale(df, FEATURES, fit_split=fit_split)
    return chunks.training_windows(df, FEATURES, TARGET, input_window, horizon, stride=stride, rows=chunk_rows)
