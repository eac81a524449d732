"""Price features of a panel, as window columns: all share one exchange by series and none leaves the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import KEYS, ORDER, series

OHLC = ("open", "high", "low", "close")


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def rolling(agg, column: str | Column, window: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> Column:
    """agg over the last `window` rows; null until they hold `window` values."""
    c, w = F.col(column) if isinstance(column, str) else column, series(keys, order).rowsBetween(1 - window, 0)
    return F.when(F.count(c).over(w) == window, agg(c).over(w))


class Features:
    """The features by name, for the price and time columns of a panel."""

    def __init__(self, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, price: str = "close"):
        self.keys, self.order, self.price = keys, order, price
        self.w = series(keys, order)

    def _lag(self, c: Column | str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w)

    def log_return(self) -> Column:
        return F.ln(self.price) - self._lag(F.ln(self.price))

    def simple_return(self) -> Column:
        return _div(F.col(self.price), self._lag(self.price)) - 1

    def intraday(self) -> Column:
        return _div(F.col("close"), F.col("open")) - 1

    def overnight(self) -> Column:
        return _div(F.col("open"), self._lag("close")) - 1

    def amplitude(self) -> Column:
        return _div(F.col("high") - F.col("low"), (F.col("high") + F.col("low")) / 2)

    def ohlc4(self) -> Column:
        return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4

    def median_price(self) -> Column:
        return (F.col("high") + F.col("low")) / 2

    def body_median(self) -> Column:
        return (F.col("open") + F.col("close")) / 2

    def moving_average(self, window: int = 20) -> Column:
        return rolling(F.avg, self.price, window, self.keys, self.order)

    def zscore(self, window: int = 20) -> Column:
        return _div(F.col(self.price) - self.moving_average(window), rolling(F.stddev_samp, self.price, window, self.keys, self.order))

    def bollinger(self, window: int = 20) -> dict[str, Column]:
        mid, std = self.moving_average(window), rolling(F.stddev_samp, self.price, window, self.keys, self.order)
        return {"bb_upper": mid + 2 * std, "bb_lower": mid - 2 * std, "bb_width": (mid + 2 * std) - (mid - 2 * std)}

    def time(self) -> dict[str, Column]:
        return {"day_of_week": F.weekday(self.order[0]), "month": F.month(self.order[0])}


def volatility(df: DataFrame, window: int = 14, log_return: str = "log_return", keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Sample deviation of the last log returns, on a year of 252 rows."""
    return df.withColumn("volatility", rolling(F.stddev_samp, log_return, window, keys, order) * F.lit(math.sqrt(252)))


def difference(df: DataFrame, column: str, n: int = 1, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, out: str = "diff") -> DataFrame:
    """n-th difference; the first n rows of each series go."""
    df = df.withColumn(out, F.col(column))
    for _ in range(n):
        df = df.withColumn(out, F.col(out) - F.lag(out).over(series(keys, order)))
    return df.filter(F.col(out).isNotNull())


def ewm(df: DataFrame, specs: dict[str, tuple[str, float]], keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Exponentially weighted means: specs maps an output column to (input column, alpha).

    y_0 = x_0 and y_t = (1 - alpha) y_{t-1} + alpha x_t from the first value of the series on; leading nulls stay null, and
    there may be none after it (fill forward first). Equal times come in any order; an empty input gives an empty result.

    y_t is a weighted sum over all earlier rows. Each series is cut in blocks, one length for all specs, so long that the
    slowest of them fades to e^-12 over a block: within a block the sum is a running sum of x / (1 - alpha)^position, and of
    earlier blocks only four matter in double precision. So all specs of a call together take two sorts of the series, in
    one exchange, whatever the series' length.
    """
    fades = {out: -math.log1p(-alpha) for out, (_, alpha) in specs.items() if alpha < 1}
    df = df.withColumns({out: F.col(column) for out, (column, alpha) in specs.items() if alpha >= 1})
    if not fades:
        return df
    # a fast mean's weights must stay finite over the block of the slowest one
    length = max(1, min(math.ceil(12 / min(fades.values())), math.floor(600 / max(fades.values()))))
    back = [math.ceil(48 / (fade * length)) for fade in fades.values()]
    w = series(keys, order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    columns = {specs[out][0] for out in fades}
    seen = {f"_n_{c}": F.count(c).over(so_far) for c in columns} | {f"_seed_{c}": F.first(c, ignorenulls=True).over(so_far) for c in columns}
    df = df.withColumns({"_row": F.row_number().over(w) - 1, **seen})
    df = df.withColumns({"_block": F.floor(F.col("_row") / length), "_in": F.col("_row") % length})
    part = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = lambda out: specs[out][1] * F.exp(-fades[out] * F.col("_in")) * F.coalesce(F.sum(F.col(specs[out][0]) * F.exp(fades[out] * F.col("_in"))).over(part), F.lit(0.0))
    df = df.withColumns({f"_local_{out}": local(out) for out in fades})
    by_block = Window.partitionBy(*keys).orderBy("_block")
    lasts = {f"_last_{out}_{j}": F.max_by(f"_local_{out}", "_in").over(by_block.rangeBetween(-j, -j)) for out, n in zip(fades, back, strict=True) for j in range(1, n + 1)}
    df = df.withColumns(lasts)
    values = {}
    for (out, fade), n in zip(fades.items(), back, strict=True):
        column = specs[out][0]
        carry = sum((F.coalesce(F.col(f"_last_{out}_{j}"), F.lit(0.0)) * math.exp(-fade * length * (j - 1)) for j in range(1, n + 1)), F.lit(0.0))
        value = F.col(f"_local_{out}") + F.exp(-fade * (F.col("_in") + 1)) * carry + F.exp(-fade * F.col(f"_n_{column}")) * F.col(f"_seed_{column}")
        values[out] = F.when(F.col(f"_n_{column}") > 0, value)
    return df.withColumns(values).drop("_row", "_block", "_in", *seen, *(f"_local_{out}" for out in fades), *lasts)


def ema(df: DataFrame, span: int = 20, column: str = "close", out: str = "ema_20", keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    return ewm(df, {out: (column, 2 / (span + 1))}, keys, order)


def _macd_of(df: DataFrame, signal: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """macd, macd_signal and macd_hist from _fast and _slow."""
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = ewm(df, {"macd_signal": ("macd", 2 / (signal + 1))}, keys, order)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close", keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """macd, macd_signal, macd_hist."""
    return _macd_of(ewm(df, {"_fast": (column, 2 / (fast + 1)), "_slow": (column, 2 / (slow + 1))}, keys, order), signal, keys, order)


def _moves(df: DataFrame, column: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """_up and _down: moves of the column, null for the first row."""
    df = df.withColumn("_move", F.col(column) - F.lag(column).over(series(keys, order)))
    # greatest() skips nulls, the first move must stay one
    part = lambda move: F.when(F.col("_move").isNotNull(), F.greatest(move, F.lit(0.0)))
    return df.withColumns({"_up": part(F.col("_move")), "_down": part(-F.col("_move"))}).drop("_move")


def _rsi_of(df: DataFrame) -> DataFrame:
    """rsi from _mean_up and _mean_down."""
    value = 100 - 100 / (1 + F.col("_mean_up") / (F.col("_mean_down") + F.lit(1e-9)))
    return df.withColumn("rsi", value).drop("_up", "_down", "_mean_up", "_mean_down")


def rsi(df: DataFrame, period: int = 14, column: str = "close", keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """rsi from means of up and down moves with alpha = 1 / period; the first row is null."""
    df = ewm(_moves(df, column, keys, order), {"_mean_up": ("_up", 1 / period), "_mean_down": ("_down", 1 / period)}, keys, order)
    return _rsi_of(df)


def all_features(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """The feature set of the training pipeline; df is clean and dealt by series."""
    return mean_features(bounded_features(df, keys, order), keys, order)


def bounded_features(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, times: Sequence[str] | None = None) -> DataFrame:
    """Those that look back a bounded number of rows, and the moves that the others start from. times: the time column, where
    rows are ordered by another one."""
    f = Features(keys, order)
    df = df.withColumns({"log_return": f.log_return(), "return": f.simple_return()})
    df = volatility(df, 14, "log_return", keys, order).withColumns(f.bollinger()).withColumn("ma_20", f.moving_average())
    df = df.withColumns({"intraday": f.intraday(), "overnight": f.overnight(), "amplitude": f.amplitude(), **Features(keys, times or order).time()})
    return _moves(df, "close", keys, order)


def mean_features(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, means: Callable[..., DataFrame] = ewm) -> DataFrame:
    """Those of exponential means; means: ewm, or another form of it."""
    # all means of prices in one call, only the signal needs another
    specs = {"_mean_up": ("_up", 1 / 14), "_mean_down": ("_down", 1 / 14), "_fast": ("close", 2 / 13), "_slow": ("close", 2 / 27), "ema_20": ("close", 2 / 21)}
    df = _rsi_of(means(df, specs, keys, order)).withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = means(df, {"macd_signal": ("macd", 2 / 10)}, keys, order)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
