"""Statistics of durations, forecasts and prices."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import KEYS, ORDER, series

METRICS = ("mean", "quantile 50%", "quantile 95%", "quantile 99%")
#: Values that the widest level of a quantile sketch holds.
SKETCH = 800


def mean_duration(column: str = "duration_s") -> Column:
    return F.avg(F.nullif(F.col(column), F.lit(0.0)))


def quantile_duration(q: float, column: str = "duration_s", approximate: bool = False) -> Column:
    """Quantile with linear interpolation; nulls and zeros are left out. Approximate for groups of very many values."""
    value = F.nullif(F.col(column), F.lit(0.0))
    return F.percentile_approx(value, q) if approximate else F.percentile(value, q)


def _quantile(metric: str) -> float | None:
    found = re.fullmatch(r"quantile (\d+(?:\.\d+)?)%", metric)
    return float(found[1]) / 100 if found and float(found[1]) <= 100 else None


def duration_stats(history: DataFrame, metrics: Sequence[str] = METRICS, keys: Sequence[str] = (), column: str = "duration_s", approximate: bool = False) -> DataFrame:
    """`stats`: a map of the metrics, null for unknown ones, of each group of keys. approximate: quantiles by percentile_approx."""
    pairs: list[Column] = []
    for m in metrics:
        q = _quantile(m)
        value = mean_duration(column) if m == "mean" else quantile_duration(q, column, approximate) if q is not None else F.lit(None).cast("double")
        pairs += [F.lit(m), value]
    return history.groupBy(*keys).agg(F.create_map(*pairs).alias("stats"))


def duration_sketches(history: DataFrame, keys: Sequence[str] = ("isin",), column: str = "duration_s", time: str = "created_at", size: int = SKETCH) -> DataFrame:
    """(day, keys, n, total, sketch): what sketch_stats needs of a history, one row for each day and group.

    A sketch (KLL) takes a bounded number of values however many it has seen. Nulls and zeros are left out; a group of
    nothing else has n = 0 and no sketch. Write it down, and add only new days' rows to it.
    """
    value = F.nullif(F.col(column), F.lit(0.0))
    rows = history.withColumns({"day": F.to_date(time), "_v": value}).groupBy("day", *keys)
    return rows.agg(F.count("_v").alias("n"), F.sum("_v").alias("total"), F.kll_sketch_agg_double("_v", size).alias("sketch"))


def sketch_stats(sketches: DataFrame, metrics: Sequence[str] = METRICS, keys: Sequence[str] = ()) -> DataFrame:
    """duration_stats from sketches, filtered by day or group before: `stats` of each group of keys, without raw rows.

    Means are exact. A quantile is a value of the history whose rank is off by at most about 1.7 / SKETCH of n, 99 times in 100.
    """
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum("total").alias("_total"), F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch"))).alias("_sketch"))
    pairs: list[Column] = []
    for m in metrics:
        q = _quantile(m)
        found = F.col("_total") / F.col("_n") if m == "mean" else F.kll_sketch_get_quantile_double("_sketch", F.lit(q)) if q is not None else F.lit(None).cast("double")
        pairs += [F.lit(m), F.when(F.col("_n") > 0, found)]
    return merged.select(*keys, F.create_map(*pairs).alias("stats"))


def rmse(aligned: DataFrame, keys: Sequence[str] = ("name", "model")) -> DataFrame:
    return aligned.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("yhat"), F.lit(2)))).alias("rmse"))


def best_model(fits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The fit with the smallest AIC, the first in the grid on ties; failed fits (null, NaN) don't count."""
    good = fits.filter(F.col("aic").isNotNull() & ~F.isnan("aic"))
    return good.groupBy(*keys).agg(F.min_by(F.struct("aic", "grid_index"), F.struct("aic", "grid_index")).alias("_b")).select(*keys, "_b.aic", "_b.grid_index")


def histogram(df: DataFrame, column: str = "close", bins: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts of equal-width bins from 1 to bins between each series' least and largest value."""
    ends = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    at = F.least(F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1, F.lit(bins))
    rows = df.filter(F.col(column).isNotNull()).join(ends, list(keys)).withColumn("bin", F.when(F.col("_hi") > F.col("_lo"), at).otherwise(F.lit(bins // 2 + 1)).cast("int"))
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("count"), F.first(F.col("_lo") + (F.col("_hi") - F.col("_lo")) / bins * (F.col("bin") - 1)).alias("left_edge"))


#: Powers of the distance from a bin's middle that kernel_density keeps, and bandwidths beyond which a kernel is 0: together
#: they move a density by less than 1e-13 of its series' highest.
MOMENTS, REACH = 16, 9
#: Bins of a bandwidth.
FINE = 2


def kernel_density(df: DataFrame, column: str = "close", points: int = 1000, keys: Sequence[str] = KEYS) -> DataFrame:
    """Gaussian density with Scott's bandwidth on a grid half a range beyond both ends; none for a single value.

    Values are first summed up in bins of half a bandwidth, as MOMENTS power sums around the bin's middle. A kernel is a
    series in these, with Hermite polynomials of the distance from the middle, and a grid point adds up the bins within
    REACH bandwidths. So the work is one pass over the values, and 2 x REACH x FINE bins a point, however many values.
    """
    ends = df.groupBy(*keys).agg(F.count(column).alias("_n"), F.stddev_samp(column).alias("_s"), F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    ends = ends.withColumn("_h", F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.col("_s")).filter(F.col("_h") > 0)
    place = (F.col(column) - F.col("_lo")) / F.col("_h") * FINE
    rows = df.filter(F.col(column).isNotNull()).join(ends, list(keys)).withColumn("_bin", F.floor(place))
    off = (place - F.col("_bin") - 0.5) / FINE  # in bandwidths
    sums = F.array(*(F.sum(F.pow(off, F.lit(k))) / math.factorial(k) for k in range(MOMENTS)))
    bins = rows.groupBy(*keys, "_bin").agg(sums.alias("_m"))
    start, end = F.col("_lo") - (F.col("_hi") - F.col("_lo")) / 2, F.col("_hi") + (F.col("_hi") - F.col("_lo")) / 2
    grid = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).withColumn("x", start + (end - start) * F.col("point") / (points - 1))
    grid = grid.withColumn("_at", (F.col("x") - F.col("_lo")) / F.col("_h") * FINE)
    near = F.sequence(F.floor(F.col("_at")) - REACH * FINE, F.floor(F.col("_at")) + REACH * FINE)
    met = grid.withColumn("_bin", F.explode(near)).join(bins, [*keys, "_bin"], "left")
    u = (F.col("_at") - F.col("_bin") - 0.5) / FINE
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(MOMENTS).alias("k"))
    # Clenshaw's recurrence, from the highest power down
    step = lambda s, c: F.struct((c + u * s.a - s.k * s.b).alias("a"), s.a.alias("b"), (s.k - 1).alias("k"))
    kernel = F.exp(-0.5 * u * u) * F.aggregate(F.reverse("_m"), zero, step, lambda s: s.a)
    total = F.coalesce(F.sum(kernel), F.lit(0.0)) / F.first(F.col("_n") * F.col("_h")) / math.sqrt(2 * math.pi)
    return met.groupBy(*keys, "point").agg(F.first("x").alias("x"), F.greatest(total, F.lit(0.0)).alias("density"))


def autocorrelation(df: DataFrame, column: str = "close", lags: int = 50, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Autocorrelation of lags 1 to `lags` with the denominator n: one lagged product a lag in one pass, no self join."""
    mean = F.avg(column).over(Window.partitionBy(*keys))
    rows = df.withColumn("_d", F.col(column) - mean)
    w = series(keys, order)
    rows = rows.select(*keys, "_d", *((F.col("_d") * F.lag("_d", k).over(w)).alias(f"_p{k}") for k in range(1, lags + 1)))
    sums = rows.groupBy(*keys).agg(F.sum(F.col("_d") * F.col("_d")).alias("_s"), *(F.sum(f"_p{k}").alias(f"_p{k}") for k in range(1, lags + 1)))
    listed = F.posexplode(F.array(*(F.try_divide(F.col(f"_p{k}"), F.col("_s")) for k in range(1, lags + 1)))).alias("_k", "acf")
    return sums.select(*keys, listed).select(*keys, (F.col("_k") + 1).alias("lag"), "acf").filter("acf IS NOT NULL")


def partial_autocorrelation(acf: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Durbin-Levinson on the few autocorrelations of each series."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].to_numpy()
        phi, out, left = np.zeros(0), [], 1.0
        for k in range(len(r)):
            a = (r[k] - phi @ r[:k][::-1]) / left if left > 1e-12 else np.nan
            phi = np.concatenate([phi - a * phi[::-1], [a]])
            left *= 1 - a * a
            out.append(a)
        return pdf[[*keys, "lag"]].assign(pacf=out)

    schema = ", ".join(f"`{c}` {acf.schema[c].dataType.simpleString()}" for c in keys) + ", lag int, pacf double"
    return acf.groupBy(*keys).applyInPandas(solve, schema)
