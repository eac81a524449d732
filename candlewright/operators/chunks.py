"""Long series over many tasks: chunks of equally many rows, with what they need of earlier ones.

Rows are range-partitioned by series and time and numbered once, so a series of any length is spread over all tasks. A
chunk is so many rows of it in a row. What looks back a bounded number of rows gets these as a halo of copied rows; what
looks back without a bound (fills, exponential means) is computed within each chunk, and what a chunk hands on is
scanned over one summary row a chunk. Results are those of the plain forms, in which a series is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import kept
from .clean import KEYS, ORDER, part_of

#: Rows of a chunk; a series of more is long.
CHUNK_ROWS = 200_000
#: Up to so many series, their totals are broadcast (50 numbers each at most).
BROADCAST_SERIES = 50_000
#: Rows of a halo: over the longest bounded frame of the features.
HALO = 64
CHUNK = "_chunk"


def is_long(df: DataFrame, keys: Sequence[str] = KEYS, rows: int = CHUNK_ROWS) -> bool:
    """Whether a series has so many rows that its tasks would keep others waiting."""
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return (longest or 0) > rows


def chunked(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, rows: int | None = None) -> DataFrame:
    """Adds _chunk and _at, a row's place in its chunk, both from 0. All chunks but a series' last have `rows` rows.

    order should leave no ties, for which any order will do. The rows are written down once, in order, so that later reads
    agree on it.
    """
    rows = rows or CHUNK_ROWS
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_mono", F.monotonically_increasing_id())
    numbered = kept(dealt, "chunks").withColumns({"_part": F.shiftright("_mono", 33), "_idx": F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))})
    # one row for each part and series in it
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_idx").alias("_lo")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    names = [f"_k{i}" for i in range(len(keys))]
    starts = starts.withColumnsRenamed(dict(zip(keys, names, strict=True))).withColumnRenamed("_part", "_of")
    same = F.col("_part") == F.col("_of")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    # a series has as many of these rows as parts hold it, and a part as many as it has series
    placed = numbered.join(starts, same).withColumn("_row", F.col("_before") + F.col("_idx") - F.col("_lo"))
    return placed.withColumns({CHUNK: F.floor(F.col("_row") / rows), "_at": F.col("_row") % rows}).drop("_mono", "_part", "_idx", "_of", "_lo", "_before", "_row", *names)


def with_halo(df: DataFrame, rows: int | None = None, halo: int = HALO) -> DataFrame:
    """A chunked frame with the last `halo` rows of each chunk once more in the next one, where _halo is true."""
    rows = rows or CHUNK_ROWS
    if halo > rows:
        raise ValueError("a halo is longer than a chunk")
    twice = F.when(F.col("_at") >= rows - halo, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    df = df.withColumn("_ahead", F.explode(twice))
    return df.withColumns({CHUNK: F.col(CHUNK) + F.col("_ahead"), "_halo": F.col("_ahead") == 1, "_at": F.col("_at") - rows * F.col("_ahead")}).drop("_ahead")


def without_halo(df: DataFrame) -> DataFrame:
    return df.filter("NOT _halo").drop("_halo")


def _carried(df: DataFrame, summary: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with its chunk's columns of summary. Both sides are dealt by series and chunk, as the windows around it are."""
    right = summary.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(CHUNK).alias("_c"), *columns)
    same = F.col(CHUNK) == F.col("_c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(right, same, "left").drop("_c", *(f"_k{i}" for i in range(len(keys))))


def fill_missing(df: DataFrame, columns: Sequence[str], method: str = "ffill", keys: Sequence[str] = KEYS) -> DataFrame:
    """clean.fill_missing of a chunked frame, forward or backward."""
    ahead = method == "bfill"
    if method not in ("ffill", "bfill"):
        return df.fillna(0, list(columns))
    own = Window.partitionBy(*keys, CHUNK).orderBy(F.col("_at").desc() if ahead else F.col("_at")).rowsBetween(Window.unboundedPreceding, 0)
    others = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc() if ahead else F.col(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    place = -F.col("_at") if ahead else F.col("_at")
    edge = df.groupBy(*keys, CHUNK).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_edge_{c}") for c in columns))
    edge = edge.select(*keys, CHUNK, *(F.last(f"_edge_{c}", ignorenulls=True).over(others).alias(f"_from_{c}") for c in columns))
    out = _carried(df, edge, keys, [f"_from_{c}" for c in columns])
    return out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(own), f"_from_{c}") for c in columns}).drop(*(f"_from_{c}" for c in columns))


def ewm(df: DataFrame, specs: dict[str, tuple[str, float]], keys: Sequence[str] = KEYS) -> DataFrame:
    """features.ewm of a chunked frame.

    Within a chunk the mean is begun anew from the chunk's first value, x. What was y before the chunk changes a value k rows
    after the chunk's first by (1 - alpha)^(k + 1) (y - x), so a chunk's end is d y + z, with d and z its own: pairs that
    compose, and are scanned over the chunks.
    """
    from .features import ewm as within

    out, alphas = list(specs), {o: a for o, (_, a) in specs.items()}
    local = within(df, {f"_y_{o}": spec for o, spec in specs.items()}, (*keys, CHUNK), ("_at",))
    seen = Window.partitionBy(*keys, CHUNK).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    sources = {c for c, _ in specs.values()}
    local = local.withColumns({f"_x_{c}": F.first(c, ignorenulls=True).over(seen) for c in sources} | {f"_k_{c}": F.count(c).over(seen) for c in sources})
    parts = {o: F.struct(F.max_by(f"_y_{o}", "_at").alias("y"), F.max_by(f"_x_{specs[o][0]}", "_at").alias("x"), F.max(f"_k_{specs[o][0]}").cast("double").alias("n")).alias(o) for o in out}
    ends = local.groupBy(*keys, CHUNK).agg(*parts.values())
    flat = ends.select(*keys, CHUNK, *(F.col(f"{o}.{f}").alias(f"_{f}_{i}") for i, o in enumerate(out) for f in "yxn"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        found = {}
        for i, o in enumerate(out):
            before, carries = None, []
            for y, x, n in zip(pdf[f"_y_{i}"], pdf[f"_x_{i}"], pdf[f"_n_{i}"], strict=True):
                carries.append(before)
                if n:
                    before = y if before is None else y + (1 - alphas[o]) ** n * (before - x)
            found[f"_from_{i}"] = pd.Series(carries, dtype="float64", index=pdf.index)
        return pdf[[*keys, CHUNK]].assign(**found)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.select(*keys, CHUNK).schema) + "".join(f", _from_{i} double" for i in range(len(out)))
    carries = flat.groupBy(*keys).applyInPandas(scan, kinds)  # one row a chunk
    carries = carries.withColumns({f"_from_{i}": F.when(~F.isnan(f"_from_{i}"), F.col(f"_from_{i}")) for i in range(len(out))})
    joined = _carried(local, carries, keys, [f"_from_{i}" for i in range(len(out))])

    def value(i: int, o: str) -> Column:
        column, alpha = specs[o]
        fade = F.pow(F.lit(1 - alpha), F.col(f"_k_{column}"))
        return F.when(F.col(f"_from_{i}").isNull(), F.col(f"_y_{o}")).otherwise(F.coalesce(F.col(f"_y_{o}") + fade * (F.col(f"_from_{i}") - F.col(f"_x_{column}")), F.col(f"_from_{i}")))

    helpers = [f"_y_{o}" for o in out] + [f"_{f}_{c}" for c in sources for f in "xk"] + [f"_from_{i}" for i in range(len(out))]
    return joined.withColumns({o: value(i, o) for i, o in enumerate(out)}).drop(*helpers)


def positions(df: DataFrame, rows: int | None = None) -> Column:
    """A row's place in its series, from 0."""
    return F.col(CHUNK) * (rows or CHUNK_ROWS) + F.col("_at")


def _by_series(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """df with aggregates over its series: one small row each, joined back."""
    names = [f"_k{i}" for i in range(len(keys))]
    found = df.groupBy(*keys).agg(*aggregates).withColumnsRenamed(dict(zip(keys, names, strict=True)))
    few = found.limit(BROADCAST_SERIES + 1).count() <= BROADCAST_SERIES
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return df.join(F.broadcast(found) if few else found, same).drop(*names)


def split(df: DataFrame, parts: Sequence[tuple[str, float]], keys: Sequence[str] = KEYS, rows: int | None = None) -> DataFrame:
    """clean.split of a chunked frame."""
    df = _by_series(df, keys, F.count("*").alias("_n"))
    return df.withColumn("split", part_of(positions(df, rows) + 1, F.col("_n"), parts)).drop("_n")


def scale(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, fit_split: str | None = None) -> DataFrame:
    """clean.scale of any frame, by one aggregation of the series and a join."""
    fitted = lambda c: F.when(F.col("split") == fit_split, F.col(c)) if fit_split else F.col(c)
    stats = [f(fitted(c)).alias(f"_{k}_{c}") for c in columns for k, f in (("avg", F.avg), ("std", F.stddev_samp))]
    df = _by_series(df, keys, *stats)
    return df.withColumns({c: (F.col(c) - F.col(f"_avg_{c}")) / (F.col(f"_std_{c}") + F.lit(1e-9)) for c in columns}).drop(*(f"_{k}_{c}" for c in columns for k in ("avg", "std")))


def training_windows(df: DataFrame, features: Sequence[str], target: str, input_window: int = 100, horizon: int = 90, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, stride: int = 1, rows: int | None = None) -> DataFrame:
    """clean.training_windows of a chunked frame: a window is made in the chunk of its last row, whose halo holds the rest."""
    df = _by_series(df, keys, F.count("*").alias("_n"))
    df = with_halo(df, rows, input_window + horizon - 1)
    w = Window.partitionBy(*keys, CHUNK).orderBy("_at")
    first = positions(df, rows) - horizon + 1
    values = F.array(*(F.col(c).cast("double") for c in features))
    df = df.withColumns({
        "_i": first, "feature_window": F.collect_list(values).over(w.rowsBetween(1 - input_window - horizon, -horizon)),
        "target_window": F.collect_list(F.col(target)).over(w.rowsBetween(1 - horizon, 0)), **{f"_first_{c}": F.lag(c, horizon - 1).over(w) for c in order},
    })
    keep = ~F.col("_halo") & (F.col("_i") >= input_window) & (F.col("_i") < F.col("_n") - horizon) & ((F.col("_i") - input_window) % stride == 0)
    return df.filter(keep).select(*keys, *(F.col(f"_first_{c}").alias(c) for c in order), "feature_window", "target_window")


def save_windows(df: DataFrame, path: str, features: Sequence[str], target: str, input_window: int = 100, horizon: int = 90, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, rows: int | None = None) -> None:
    """Write the training windows of a chunked frame as their rows, each once, and an index: (keys, chunk, first, length), the
    windows that end in a chunk as a stretch of places in the series. load_windows makes the windows of it."""
    rows = rows or CHUNK_ROWS
    df = _by_series(df, keys, F.count("*").alias("_n"))
    placed = df.withColumn("_row", positions(df, rows))
    ends = placed.groupBy(*keys, CHUNK).agg(F.min("_row").alias("_lo"), F.max("_row").alias("_hi"), F.first("_n").alias("_n"))
    first = F.greatest(F.col("_lo") - horizon + 1, F.lit(input_window))
    last = F.least(F.col("_hi") - horizon + 1, F.col("_n") - horizon - 1)
    index = ends.select(*keys, CHUNK, first.alias("first"), F.greatest(last - first + 1, F.lit(0)).alias("length"), F.lit(input_window).alias("input_window"), F.lit(horizon).alias("horizon"), F.lit(rows).alias("chunk_rows"))
    index.write.parquet(f"{path}/index")
    out = df.select(*keys, *order, CHUNK, "_at", F.array(*(F.col(c).cast("double") for c in features)).alias("features"), F.col(target).cast("double").alias("target"))
    out.repartition(*keys, CHUNK).sortWithinPartitions(*keys, CHUNK, "_at").write.parquet(f"{path}/rows")


def load_windows(spark: SparkSession, path: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, stride: int = 1, chosen: Column | None = None) -> DataFrame:
    """The windows of save_windows, every stride-th; chosen: a condition on the index's keys and chunks, whose rows alone are
    read. A window is made when it is read, from rows of its chunk and of the one before."""
    index = spark.read.parquet(f"{path}/index")
    one = index.select("input_window", "horizon", "chunk_rows").first()
    df = spark.read.parquet(f"{path}/rows")
    if one is None:
        return df.select(*keys, *order, F.array("features").alias("feature_window"), F.array("target").alias("target_window")).limit(0)
    index = (index if chosen is None else index.filter(chosen)).select(*keys, CHUNK, F.col("first").alias("_first"), F.col("length").alias("_length"))
    wide = with_halo(df, one.chunk_rows, one.input_window + one.horizon - 1)
    wide = _carried(wide, index, keys, ["_first", "_length"]).filter("_first IS NOT NULL")
    w = Window.partitionBy(*keys, CHUNK).orderBy("_at")
    wide = wide.withColumns({
        "_i": positions(wide, one.chunk_rows) - one.horizon + 1, "feature_window": F.collect_list("features").over(w.rowsBetween(1 - one.input_window - one.horizon, -one.horizon)),
        "target_window": F.collect_list("target").over(w.rowsBetween(1 - one.horizon, 0)), **{f"_first_{c}": F.lag(c, one.horizon - 1).over(w) for c in order},
    })
    keep = ~F.col("_halo") & F.col("_i").between(F.col("_first"), F.col("_first") + F.col("_length") - 1) & ((F.col("_i") - one.input_window) % stride == 0)
    return wide.filter(keep).select(*keys, *(F.col(f"_first_{c}").alias(c) for c in order), "feature_window", "target_window")


def all_features(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, rows: int | None = None) -> DataFrame:
    """features.all_features of a chunked frame: its columns and _chunk, _at."""
    from . import features

    def means(df: DataFrame, specs: dict[str, tuple[str, float]], *_) -> DataFrame:
        return ewm(df, specs, keys)

    wide = with_halo(df, rows)
    wide = features.bounded_features(wide, (*keys, CHUNK), ("_at",), times=order)
    return features.mean_features(without_halo(wide), keys, order, means)
