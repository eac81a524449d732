"""Column functions: intervals, time frames, keys, identifiers and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Interval codes and their lengths in seconds, time frames and their interval codes.
INTERVAL_SECONDS = {1: 60, 10: 600, 60: 3600, 24: 86400, 7: 604800, 31: 2678400, 4: 7862400}
TIME_FRAME_INTERVALS = {"1m": 1, "10m": 10, "1h": 60, "1d": 24, "1w": 7, "1mo": 31, "1q": 4}
CACHE_PREFIX = "postman:forecasts:"


def _lookup(value: Column, table: dict) -> Column:
    """The table's value, null for others; a chain of comparisons stays inside generated code."""
    out = F.lit(None).cast("int")
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def interval_seconds(code: Column) -> Column:
    """Length of an interval code; null for unknown codes."""
    return _lookup(code, INTERVAL_SECONDS)


def interval_end(begin: Column, code: Column) -> Column:
    """begin plus the interval's length."""
    return begin + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), interval_seconds(code).cast("decimal(18,6)"))


def time_frame_interval(time_frame: Column) -> Column:
    """Interval code of a time frame such as 1h; digits stand for themselves, others give null."""
    t = F.lower(F.trim(time_frame))
    return F.coalesce(_lookup(t, TIME_FRAME_INTERVALS), F.when(t.rlike("^[0-9]+$"), t.try_cast("int")))


def parse_time_frame(time_frame: Column) -> Column:
    """struct(interval, unit) of the first digits followed by word characters; null if there are none."""
    pattern = F.lit(r"(\d+)(\w+)")
    n = F.nullif(F.regexp_extract(time_frame, r"(\d+)(\w+)", 1), F.lit(""))
    return F.when(time_frame.rlike(r"\d+\w+") & pattern.isNotNull(), F.struct(n.try_cast("int").alias("interval"), F.regexp_extract(time_frame, r"(\d+)(\w+)", 2).alias("unit")))


def expires_at(ts: Column, time_frame: Column) -> Column:
    """ts plus the time frame; months and years follow the calendar with month-end clamping. Unknown units, and times beyond
    what a timestamp or an interval can hold, give null."""
    n, unit = parse_time_frame(time_frame)["interval"], parse_time_frame(time_frame)["unit"]
    part = lambda u: F.when(unit == u, n).otherwise(0)
    step = F.try_make_interval(part("y"), part("mo"), part("w"), part("d"), part("h"), part("m"), part("s").cast("decimal(18,6)"))
    # beyond year 9999 other readers of the table fail, and so does the session's own conversion to Python
    until = F.try_add(ts, step)
    return F.when(unit.isin("s", "m", "h", "d", "w", "mo", "y") & (until < F.lit("9999-12-31").cast("timestamp")), until)


def cache_key(isin: Column, time_frame: Column, period: Column, provide_plot: Column) -> Column:
    """Key under which a forecast is cached."""
    plain = F.concat_ws("#", isin, time_frame, period.cast("string"), F.initcap(provide_plot.cast("string")))
    return F.concat(F.lit(CACHE_PREFIX), F.sha2(plain, 256))


def canonical_isin(value: Column) -> Column:
    return F.upper(F.trim(value))


def parse_period(value: Column) -> Column:
    """Period of user input; null if it is not a whole number."""
    return F.trim(value).try_cast("int")


def validate_identifiers(requests: DataFrame, ticker: str = "ticker", isin: str = "isin") -> DataFrame:
    """Trimmed identifiers and `reject`: why a request is refused (exactly one identifier must be given), or null."""
    t, i = F.nullif(F.trim(ticker), F.lit("")), F.nullif(F.trim(isin), F.lit(""))
    out = requests.withColumns({ticker: t, isin: i})
    both, none = F.col(ticker).isNotNull() & F.col(isin).isNotNull(), F.col(ticker).isNull() & F.col(isin).isNull()
    return out.withColumn("reject", F.when(both, "both identifiers").when(none, "no identifier"))


def message_defaults(messages: DataFrame) -> DataFrame:
    """Missing fields of forecast requests: period 7, time frame 1d, no plot."""
    return messages.withColumns({"forecast_period": F.coalesce("forecast_period", F.lit(7)), "time_frame": F.coalesce("time_frame", F.lit("1d")), "provide_plot": F.coalesce("provide_plot", F.lit(False))})
