"""Queries of the price-series library, and the same in DuckDB's SQL.

Doubles are rounded on both sides, times compared as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import clean, forecast, joins, stationarity, stats
from .operators import features as feat
from .plans import adapters as A
from .plans import pipelines
from .session import shipped
from .sources import candles
from .streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def r(c: Column | str, n: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 0.5 * 10**-n, F.lit(0.0)).otherwise(F.round(c, n))


def rs(e: str, n: int = 6) -> str:
    return f"CASE WHEN abs({e}) < {0.5 * 10**-n:.12f} THEN 0.0::DOUBLE ELSE round({e}, {n}) END"


def tx(c: str = "begin") -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def txs(c: str = "begin") -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS \"{c.strip(chr(34))}\""


def add(name: str, query: Callable[[SparkSession, str], DataFrame], body: str | None = None, *ctes: str, recursive: bool = False) -> None:
    QUERIES[name] = shipped(query)
    if body:
        parts = ", ".join(A.SQL[c] for c in ctes)
        joined = f"{parts}, {body[5:]}" if body.startswith("WITH ") else f"{parts} {body}"
        ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{joined}" if parts else body


W = "OVER (PARTITION BY name ORDER BY begin)"
FRAME = "OVER (PARTITION BY name ORDER BY begin ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def guarded(agg: str, col: str, n: int) -> str:
    f = FRAME.format(n - 1)
    return f"CASE WHEN count({col}) {f} = {n} THEN {agg}({col}) {f} END"


# ---- sources ----
def panel() -> list:
    return ["name", tx(), "open", "close", "high", "low", "volume"]


def candles_union(spark, d):
    b = A.bars_from_events(spark, d)
    one = b.filter("name = 'click'").drop("name")
    two = b.filter("name = 'view'").drop("name", "volume")
    from .sources.candles import stack

    return stack({"click": one, "view": two}).select(*panel())


add("candles_union", candles_union,
    f"SELECT name, {txs()}, open, close, high, low, CASE WHEN name = 'click' THEN volume END AS volume FROM bars WHERE name IN ('click', 'view')", "bars")


def candle_upsert(spark, d):
    dup = A.dup_bars(spark, d).select(F.col("name").alias("ticker"), F.lit(60).alias("interval"), "begin", "close", "seq")
    return joins.new_candles(dup.filter((F.col("seq") == 0) & (F.day("begin") % 2 == 0)), dup, ["seq"]).select("ticker", "interval", tx(), "close")


add("candle_upsert", candle_upsert,
    f"""SELECT name AS ticker, 60 AS interval, {txs()}, close FROM (SELECT *, row_number() OVER (PARTITION BY name, begin ORDER BY seq) AS rn FROM dup)
WHERE rn = 1 AND day(begin) % 2 <> 0""", "bars", "dup")

# ---- scalars and filters ----
add("trailing_range", lambda s, d: clean.trailing_range(A.bars_from_events(s, d), 7).select(*panel()),
    f"""SELECT name, {txs()}, open, close, high, low, volume FROM (SELECT *, max(begin) OVER (PARTITION BY name) AS last FROM bars)
WHERE begin >= last - to_days(7)""", "bars")


def candle_range(spark, d):
    c = candles.original_isin(A.candles(spark, d), None)
    return clean.candle_range(c, "click", 60, "2024-01-03", "2024-01-20").select("ticker", "isin", "interval", tx(), tx("end"), "close")


add("candle_range", candle_range, f"""SELECT ticker, '' AS isin, interval, {txs()}, {txs(chr(34) + 'end' + chr(34))}, close FROM candles
WHERE ticker = 'click' AND begin >= '2024-01-03' AND \"end\" <= '2024-01-20'""", "bars", "candles")


def id_validation(spark, d):
    k = F.col("o_orderkey")
    o = A.table(spark, d, "orders").select(k, F.when(k % 3 == 0, "  SBER ").when(k % 3 == 1, " ").alias("ticker"), F.when(k % 2 == 0, F.concat(F.lit(" ru"), k.cast("string"), F.lit(" "))).alias("isin"), F.when(k % 5 == 0, "x7").otherwise(F.concat(F.lit(" "), (k % 9).cast("string"))).alias("period"))
    return S.validate_identifiers(o).select("o_orderkey", "ticker", S.canonical_isin(F.col("isin")).alias("isin"), "reject", S.parse_period(F.col("period")).alias("period"))


add("id_validation", id_validation,
    """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'SBER' END AS ticker, CASE WHEN o_orderkey % 2 = 0 THEN 'RU' || o_orderkey END AS isin,
CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 9)::INT END AS period FROM orders)
SELECT o_orderkey, ticker, isin, CASE WHEN ticker IS NOT NULL AND isin IS NOT NULL THEN 'both identifiers' WHEN ticker IS NULL AND isin IS NULL THEN
'no identifier' END AS reject, period FROM o""")


def time_frames(spark, d):
    h = A.history_rows(spark, d).withColumn("time_frame", F.when(F.col("id") % 10 != 0, F.concat(F.lit(" "), F.upper("time_frame"))))
    h = S.message_defaults(h.withColumns({"forecast_period": F.when(F.col("id") % 4 != 0, (F.col("id") % 5).cast("int")), "provide_plot": F.when(F.col("id") % 3 != 0, F.lit(True))}))
    p = S.parse_time_frame(F.lower("time_frame"))
    until = S.expires_at(F.col("created_at"), F.lower("time_frame"))
    return h.select("id", S.time_frame_interval(F.col("time_frame")).alias("interval"), S.interval_seconds(S.time_frame_interval(F.col("time_frame"))).alias("seconds"), p["interval"].alias("n"), p["unit"].alias("unit"), F.date_format(until, "yyyy-MM-dd HH:mm:ss").alias("until"), "forecast_period", "provide_plot")


add("time_frames", time_frames, """WITH h AS (SELECT *, coalesce(CASE WHEN id % 10 <> 0 THEN time_frame END, '1d') AS tf FROM hist),
p AS (SELECT *, regexp_extract(tf, '(\\d+)(\\w+)', 1)::INT AS n, regexp_extract(tf, '(\\d+)(\\w+)', 2) AS unit FROM h),
i AS (SELECT *, CASE tf WHEN '1m' THEN 1 WHEN '10m' THEN 10 WHEN '1h' THEN 60 WHEN '1d' THEN 24 WHEN '1w' THEN 7 WHEN '1mo' THEN 31 WHEN '1q' THEN 4
END AS interval FROM p)
SELECT id, interval, CASE interval WHEN 1 THEN 60 WHEN 10 THEN 600 WHEN 60 THEN 3600 WHEN 24 THEN 86400 WHEN 7 THEN 604800 WHEN 31 THEN 2678400 ELSE
7862400 END AS seconds, n, unit,
strftime(CASE unit WHEN 'm' THEN created_at + to_minutes(n) WHEN 'h' THEN created_at + to_hours(n) WHEN 'd' THEN created_at + to_days(n) WHEN 'w'
THEN created_at + to_days(7 * n) WHEN 'mo' THEN created_at + to_months(n) END, '%Y-%m-%d %H:%M:%S') AS until,
CASE WHEN id % 4 <> 0 THEN (id % 5)::INT ELSE 7 END AS forecast_period, id % 3 <> 0 AS provide_plot FROM i""", "hist")
add("cache_key",
    lambda s, d: A.history_rows(s, d).select("id", S.cache_key(F.col("isin"), F.col("time_frame"), F.lit(7), F.col("requested_plot")).alias("key"), F.sha2("isin", 256).alias("isin_hash")),
    """SELECT id, 'postman:forecasts:' || sha256(isin || '#' || time_frame || '#7#' || CASE WHEN requested_plot THEN 'True' ELSE 'False' END) AS key,
sha256(isin) AS isin_hash FROM hist""", "hist")  # fmt: skip
add("request_filter",
    lambda s, d: joins.request_filter(A.history_rows(s, d), "1995-01-01", "1996-12-31", isin="1-URGENT", used_cache=True, requested_plot=None).select("id", "time_frame", "status", r("duration_s").alias("duration_s")),
    f"""SELECT id, time_frame, status, {rs('duration_s')} AS duration_s FROM hist
WHERE isin = '1-URGENT' AND used_cache AND created_at BETWEEN '1995-01-01' AND '1996-12-31'""", "hist")  # fmt: skip


# ---- joins ----
def isin_resolve(spark, d):
    part = A.table(spark, d, "part")
    rows = part.select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand")).alias("isin"))
    return joins.resolve_tickers(rows, part.select(F.col("p_brand").alias("isin"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("secid"), F.col("p_partkey").alias("rank")))


add("isin_resolve", isin_resolve, """WITH f AS (SELECT p_brand AS isin, arg_min(p_name || ' ' || p_partkey, p_partkey) AS ticker FROM part
GROUP BY 1), q AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_brand || 'x' ELSE p_brand END AS isin FROM part)
SELECT p_partkey, isin, ticker FROM q LEFT JOIN f USING (isin)""")
add("request_update",
    lambda s, d: joins.apply_responses(A.history_rows(s, d), A.history_responses(s, d)).select("id", "status", "model", "error", r("duration_s").alias("duration_s")),
    f"""WITH f AS (SELECT id, upper(arg_max(status, ts)) AS status, arg_max(model, ts) FILTER (model IS NOT NULL) AS model, arg_max(error, ts) FILTER (error
IS NOT NULL) AS error, arg_max(duration_s, ts) FILTER (duration_s IS NOT NULL) AS duration_s FROM hresp GROUP BY id),
j AS (SELECT h.id, coalesce(f.status, h.status) AS status, coalesce(f.model, h.model) AS model, coalesce(f.error, h.error) AS error,
coalesce(f.duration_s, h.duration_s) AS duration_s FROM hist h LEFT JOIN f USING (id))
SELECT id, status, model, error, {rs('duration_s')} AS duration_s FROM j""", "hist", "hresp")  # fmt: skip
add("publish_enrich",
    lambda s, d: joins.publish_messages(A.response_messages(s, d), A.request_messages(s, d).filter("request_id % 3 <> 0").withColumn("telegram_id", F.col("user_id"))).select("request_id", "status", "telegram_id"),
    """SELECT request_id, status, CASE WHEN request_id % 3 <> 0 THEN user_id END AS telegram_id FROM resp JOIN (SELECT request_id, user_id
FROM req) USING (request_id)""", "req", "resp")  # fmt: skip
add("durations",
    lambda s, d: joins.durations(A.request_messages(s, d), A.response_messages(s, d)).select("request_id", "status", r("duration_s").alias("duration_s")),
    f"""WITH j AS (SELECT request_id, resp.status, CASE WHEN resp.ts >= req.ts AND resp.ts < req.ts + to_seconds(600) THEN (epoch_us(resp.ts) -
epoch_us(req.ts)) / 1000000.0 END::DOUBLE AS duration_s FROM resp
JOIN req USING (request_id)) SELECT request_id, status, {rs('duration_s')} AS duration_s FROM j""", "req", "resp")  # fmt: skip


def _with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("cache_key", S.cache_key(F.col("isin"), F.col("time_frame"), F.col("forecast_period"), F.lit(False)))


add("cache_asof",
    lambda s, d: joins.cache_lookup(_with_key(A.request_messages(s, d)), _with_key(A.cached_responses(s, d))).select("request_id", "hit", r("cached_price").alias("cached_price"), "used_cache", "status"),
    f"""WITH v AS (SELECT *, CASE time_frame WHEN '1m' THEN ts + to_minutes(1) WHEN '10m' THEN ts + to_minutes(10) WHEN '1h' THEN ts + to_hours(1) WHEN '1d'
THEN ts + to_days(1) WHEN '1w' THEN ts + to_days(7) WHEN '1mo' THEN ts + to_months(1) END AS until FROM cached WHERE status = 'completed'),
j AS (SELECT q.request_id, coalesce(q.ts < v.until, false) AS hit, v.forecast_price AS p FROM req q ASOF LEFT JOIN (SELECT * FROM v
WHERE until IS NOT NULL) v ON q.isin = v.isin AND q.time_frame = v.time_frame AND q.forecast_period = v.forecast_period AND q.ts >= v.ts)
SELECT request_id, hit, CASE WHEN hit THEN {rs('p')} END AS cached_price, hit AS used_cache, CASE WHEN hit THEN 'COMPLETED' ELSE 'PENDING' END AS
status FROM j""", "req", "cached")  # fmt: skip

# ---- statistics ----
add("duration_stats",
    lambda s, d: stats.duration_stats(A.history_rows(s, d), [*stats.METRICS, "quantile 99.9%", "median"], ["isin"]).select("isin", F.explode("stats").alias("metric", "v")).select("isin", "metric", r("v").alias("value")),
    f"""WITH x AS (SELECT isin, nullif(duration_s, 0) AS v FROM hist),
u AS (SELECT isin, unnest(['mean', 'quantile 50%', 'quantile 95%', 'quantile 99%', 'quantile 99.9%', 'median']) AS metric, unnest([avg(v),
quantile_cont(v, 0.5), quantile_cont(v, 0.95), quantile_cont(v, 0.99), quantile_cont(v, 0.999), NULL]) AS v FROM x GROUP BY isin)
SELECT isin, metric, {rs('v')} AS value FROM u""", "hist")  # fmt: skip


def sketch_stats(spark, d):
    """Flow C from sketches of a day and isin; how far quantiles are off in rank is looked up in the raw rows."""
    h = A.history_rows(spark, d)
    found = stats.sketch_stats(stats.duration_sketches(h).filter("day >= '1995-01-01'"), keys=["isin"]).select("isin", F.explode("stats").alias("metric", "v"))
    raw = h.filter("created_at >= '1995-01-01'").select(F.col("isin").alias("i"), F.nullif("duration_s", F.lit(0.0)).alias("x")).filter("x IS NOT NULL")
    met = found.join(raw, F.col("isin") == F.col("i")).groupBy("isin", "metric", "v").agg(F.avg((F.col("x") < F.col("v")).cast("int")).alias("below"), F.avg((F.col("x") <= F.col("v")).cast("int")).alias("upto"))
    q = F.regexp_extract("metric", "([0-9]+)%", 1).try_cast("double") / 100
    near = (F.col("below") - 0.01 <= q) & (q <= F.col("upto") + 0.01)
    return met.select("isin", "metric", F.when(F.col("metric") == "mean", r("v")).alias("mean"), near.alias("rank_within_1_percent"))


add("sketch_stats", sketch_stats,
    f"""WITH x AS (SELECT isin, avg(nullif(duration_s, 0)) AS v FROM hist WHERE created_at >= '1995-01-01' GROUP BY isin),
u AS (SELECT isin, v, unnest(['mean', 'quantile 50%', 'quantile 95%', 'quantile 99%']) AS metric FROM x)
SELECT isin, metric, CASE WHEN metric = 'mean' THEN {rs('v')} END AS mean, CASE WHEN metric <> 'mean' THEN true END AS rank_within_1_percent FROM u""", "hist")  # fmt: skip


def rmse_baseline(spark, d):
    b = clean.hold_out(A.bars_from_events(spark, d), 20)
    test = b.filter("split = 'test'").select("name", clean.position().alias("step"), F.col("close").alias("y"))
    base = forecast.baseline_forecast(b.filter("split = 'train'"), 7).select("name", F.lit("baseline").alias("model"), F.col("forecast_price").alias("yhat"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("step"))
    return stats.rmse(joins.align(base, test)).select("name", "model", r("rmse").alias("rmse"))


add("rmse_baseline", rmse_baseline,
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY begin DESC) AS k FROM bars), m AS (SELECT name, avg(close) AS yhat FROM n
WHERE k BETWEEN 21 AND 27 GROUP BY name),
e AS (SELECT name, sqrt(avg((close - yhat) * (close - yhat))) AS e FROM n JOIN m USING (name) WHERE k <= 20
GROUP BY name) SELECT name, 'baseline' AS model, {rs('e')} AS rmse FROM e""", "bars")
add("argmin_model",
    lambda s, d: stats.best_model(A.table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("grid_index")).agg(F.floor(F.avg("l_quantity")).alias("aic")).withColumn("aic", F.when(F.col("grid_index") != 3, F.col("aic").cast("double")))),
    """WITH f AS (SELECT l_returnflag AS name, l_linenumber AS grid_index, floor(avg(l_quantity))::DOUBLE AS aic FROM lineitem WHERE l_linenumber <> 3
GROUP BY ALL) SELECT name, arg_min(aic, aic * 1000 + grid_index) AS aic, arg_min(grid_index, aic * 1000 + grid_index) AS grid_index FROM f
GROUP BY name""")  # fmt: skip
add("histogram", lambda s, d: stats.histogram(A.bars_from_events(s, d)).select("name", "bin", "count", r("left_edge").alias("left_edge")),
    f"""WITH e AS (SELECT name, min(close) AS lo, max(close) AS hi FROM bars
GROUP BY name), b AS (SELECT name, lo, hi, CASE WHEN hi > lo THEN least(floor((close - lo) / (hi - lo) * 20) + 1, 20) ELSE 11 END::INT AS bin
FROM bars JOIN e USING (name)),
c AS (SELECT name, bin, count(*) AS count, any_value(lo + (hi - lo) / 20 * (bin - 1)) AS left_edge FROM b
GROUP BY name, bin) SELECT name, bin, count, {rs('left_edge')} AS left_edge FROM c""", "bars")  # fmt: skip
add("kde", lambda s, d: stats.kernel_density(A.bars_from_events(s, d)).select("name", "point", r("x", 4).alias("x"), r("density").alias("density")),
    f"""WITH e AS (SELECT name, count(close) AS n, stddev_samp(close) AS s, min(close) AS lo, max(close) AS hi FROM bars
GROUP BY name), g AS (SELECT *, unnest(range(1000))::INT AS point FROM e),
h AS (SELECT name, point, n, (lo - (hi - lo) / 2) + ((hi + (hi - lo) / 2) - (lo - (hi - lo) / 2)) * point / 999 AS x, pow(n, -0.2) * s AS h FROM g),
k AS (SELECT name, point, any_value(x) AS x, sum(exp(-0.5 * ((x - close) / h) * ((x - close) / h))) / any_value(n * h) / sqrt(2 * pi()) AS density
FROM h JOIN bars USING (name) GROUP BY name, point)
SELECT name, point, {rs('x', 4)} AS x, {rs('density')} AS density FROM k""", "bars")  # fmt: skip
add("acf", lambda s, d: stats.autocorrelation(A.bars_from_events(s, d), lags=50).select("name", "lag", r("acf").alias("acf")),
    f"""WITH m AS (SELECT name, row_number() {W} AS rn, close - avg(close) OVER (PARTITION BY name) AS dv FROM bars), t AS (SELECT name, sum(dv * dv) AS s
FROM m GROUP BY name), l AS (SELECT unnest(range(1, 51))::INT AS lag),
p AS (SELECT a.name, lag, sum(a.dv * b.dv) AS p FROM m a CROSS JOIN l JOIN m b ON b.name = a.name AND b.rn = a.rn - lag
GROUP BY ALL), q AS (SELECT name, lag, p / s AS acf FROM p JOIN t USING (name)) SELECT name, lag, {rs('acf')} AS acf FROM q""", "bars")  # fmt: skip
# Durbin-Levinson as a recursion over the lags: phi holds the coefficients, v what is left of the variance.
PACF = f"""WITH m AS (SELECT name, row_number() {W} AS rn, close - avg(close) OVER (PARTITION BY name) AS dv FROM bars),
t AS (SELECT name, sum(dv * dv) AS s FROM m GROUP BY name), l AS (SELECT unnest(range(1, 51))::INT AS lag),
p AS (SELECT a.name, lag, sum(a.dv * b.dv) AS p FROM m a CROSS JOIN l JOIN m b ON b.name = a.name AND b.rn = a.rn - lag GROUP BY ALL),
q AS (SELECT name, list(p / s ORDER BY lag) AS r FROM p JOIN t USING (name) GROUP BY name),
e AS (
  SELECT name, r, 1 AS lag, r[1] AS a, [r[1]] AS phi, 1 - r[1] * r[1] AS v FROM q
  UNION ALL
  SELECT name, r, lag + 1, na, list_append(list_transform(phi, lambda x, i: x - na * phi[lag + 1 - i]), na), v * (1 - na * na)
  FROM (SELECT *, (r[lag + 1] - list_sum(list_transform(phi, lambda x, i: x * r[lag + 1 - i]))) / v AS na FROM e WHERE lag < len(r)))
SELECT name, lag::INT AS lag, {rs('a')} AS pacf FROM e"""
add("pacf",
    lambda s, d: stats.partial_autocorrelation(stats.autocorrelation(A.bars_from_events(s, d), lags=50)).select("name", "lag", r("pacf").alias("pacf")), PACF, "bars", recursive=True)

# ---- cleaning ----
add("dedup", lambda s, d: clean.drop_duplicate_times(A.dup_bars(s, d)).select("name", tx(), "close", "seq"),
    f"SELECT name, {txs()}, close, seq FROM dup WHERE seq = 0", "bars", "dup")
_fill = lambda m: lambda s, d: clean.fill_missing(A.gappy_bars(s, d), ["open", "close"], m).select("name", tx(), "open", "close")
_fills = lambda f: f"SELECT name, {txs()}, {f('open')} AS open, {f('close')} AS close FROM gappy"
add("ffill", _fill("ffill"), _fills(lambda c: f"last_value({c} IGNORE NULLS) {FRAME.format('UNBOUNDED')}"), "bars", "gappy")
add("bfill", _fill("bfill"), _fills(lambda c: f"first_value({c} IGNORE NULLS) OVER (PARTITION BY name ORDER BY begin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"), "bars", "gappy")
add("fill_zero", _fill("zero"), _fills(lambda c: f"coalesce({c}, 0)"), "bars", "gappy")
add("drop_null", lambda s, d: clean.drop_nulls(A.gappy_bars(s, d), ["open", "close"]).select("name", tx(), "open", "close"),
    f"SELECT name, {txs()}, open, close FROM gappy WHERE open IS NOT NULL AND close IS NOT NULL", "bars", "gappy")


def ticker_encode(spark, d):
    b = A.bars_from_lineitem(spark, d)
    return clean.encode(b, clean.fit_encoder(b)).groupBy("name", "ticker_id").agg(F.count("*").alias("n"))


add("ticker_encode", ticker_encode,
    """WITH b AS (SELECT DISTINCT l_suppkey::VARCHAR AS name, l_shipdate AS begin FROM lineitem), f AS (SELECT name, min(begin) AS f, count(*) AS n FROM b
GROUP BY name)
SELECT name, (row_number() OVER (ORDER BY f, name) - 1)::INT AS ticker_id, n FROM f""")
add("scale",
    lambda s, d: clean.scale(A.bars_from_events(s, d), ["close", "volume"]).select("name", tx(), r("close").alias("close"), r("volume").alias("volume")),
    f"""WITH m AS (SELECT name, begin, (close - avg(close) OVER (PARTITION BY name)) / (stddev_samp(close) OVER (PARTITION BY name) + 1e-9) AS c, (volume -
avg(volume) OVER (PARTITION BY name)) / (stddev_samp(volume) OVER (PARTITION BY name) + 1e-9) AS v
FROM bars) SELECT name, {txs()}, {rs('c')} AS close, {rs('v')} AS volume FROM m""", "bars")  # fmt: skip
_count = lambda df: df.groupBy("name", "split").agg(F.count("*").alias("n"), F.min(F.date_format("begin", "yyyy-MM-dd HH:mm:ss")).alias("first"))
_splits = lambda label: f"""WITH k AS (SELECT *, row_number() {W} AS rn, count(*) OVER (PARTITION BY name) AS n FROM bars), l AS (SELECT name, begin, {label} AS split
FROM k) SELECT name, split, count(*) AS n, strftime(min(begin), '%Y-%m-%d %H:%M:%S') AS first FROM l GROUP BY name, split"""  # noqa: E731
add("split3", lambda s, d: _count(clean.split(A.bars_from_events(s, d), [("train", 0.7), ("val", 0.15), ("test", 0.15)])),
    _splits("CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END"), "bars")
add("split2", lambda s, d: _count(clean.split(A.bars_from_events(s, d), [("train", 0.7), ("test", 0.3)])),
    _splits("CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END"), "bars")
add("holdout", lambda s, d: _count(clean.hold_out(A.bars_from_events(s, d))), _splits("CASE WHEN rn > n - 20 THEN 'test' ELSE 'train' END"), "bars")


def train_windows(spark, d):
    w = clean.training_windows(A.bars_from_events(spark, d), ["close", "volume"], "close", 5, 3)
    x = w.select("name", tx(), F.posexplode("feature_window").alias("k", "f"), F.col("target_window")[2].alias("y_last"))
    return x.select("name", "begin", "k", F.col("f")[0].alias("x_close"), F.col("f")[1].alias("x_volume"), "y_last")


add("train_windows", train_windows, f"""WITH k AS (SELECT *, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM bars)
SELECT a.name, strftime(a.begin, '%Y-%m-%d %H:%M:%S') AS begin, (b.i - a.i + 5)::INT AS k, b.close AS x_close, b.volume AS x_volume, c.close AS y_last
FROM k a JOIN k b ON a.name = b.name AND b.i BETWEEN a.i - 5 AND a.i - 1 JOIN k c ON c.name = a.name AND c.i = a.i + 2
WHERE a.i >= 5 AND a.i < a.n - 3""", "bars")

# ---- features ----
LAG = f"lag(close) {W}"
MA, SD = guarded("avg", "close", 20), guarded("stddev_samp", "close", 20)


def _price_features() -> None:
    for name, method, sql in (
        ("log_return", "log_return", f"ln(close) - ln({LAG})"),
        ("simple_return", "simple_return", f"close / {LAG} - 1"),
        ("zscore", "zscore", f"(close - ({MA})) / nullif(({SD}), 0)"),
        ("intraday", "intraday", "close / open - 1"),
        ("overnight", "overnight", f"open / {LAG} - 1"),
        ("amplitude", "amplitude", "(high - low) / ((high + low) / 2)"),
        ("ohlc4", "ohlc4", "(open + high + low + close) / 4"),
        ("median_price", "median_price", "(high + low) / 2"),
        ("body_median", "body_median", "(open + close) / 2"),
        ("moving_average", "moving_average", MA),
    ):
        make = lambda s, d, m=method: A.bars_from_events(s, d).withColumn("v", getattr(feat.Features(), m)()).select("name", tx(), r("v").alias("v"))
        add(f"feature_{name}", make, f"WITH f AS (SELECT name, begin, {sql} AS v FROM bars) SELECT name, {txs()}, {rs('v')} AS v FROM f", "bars")


_price_features()



def _select(df: DataFrame, *columns: str, n: int = 6) -> DataFrame:
    return df.select("name", tx(), *(r(c, n).alias(c) for c in columns))


LOGS = f"l AS (SELECT *, ln(close) - ln({LAG}) AS log_return FROM bars)"
add("feature_volatility",
    lambda s, d: _select(feat.volatility(A.bars_from_events(s, d).withColumn("log_return", feat.Features().log_return())), "volatility"),
    f"""WITH {LOGS}, v AS (SELECT name, begin, ({guarded('stddev_samp', 'log_return', 14)}) * sqrt(252) AS volatility
FROM l) SELECT name, {txs()}, {rs('volatility')} AS volatility FROM v""", "bars")  # fmt: skip
add("feature_bollinger", lambda s, d: _select(A.bars_from_events(s, d).withColumns(feat.Features().bollinger()), "bb_upper", "bb_lower", "bb_width"),
    f"""WITH m AS (SELECT name, begin, {MA} AS m, {SD} AS s
FROM bars) SELECT name, {txs()}, {rs('m + 2 * s')} AS bb_upper, {rs('m - 2 * s')} AS bb_lower, {rs('(m + 2 * s) - (m - 2 * s)')} AS bb_width FROM m""", "bars")  # fmt: skip
add("feature_time", lambda s, d: A.bars_from_events(s, d).withColumns(feat.Features().time()).select("name", tx(), "day_of_week", "month"),
    f"SELECT name, {txs()}, (isodow(begin) - 1)::INT AS day_of_week, month(begin)::INT AS month FROM bars", "bars")
add("feature_diff1", lambda s, d: _select(feat.difference(A.bars_from_events(s, d), "close", 1), "diff"),
    f"WITH v AS (SELECT name, begin, close - {LAG} AS v FROM bars) SELECT name, {txs()}, {rs('v')} AS diff FROM v WHERE v IS NOT NULL", "bars")
add("feature_diff2", lambda s, d: _select(feat.difference(A.bars_from_events(s, d), "close", 2), "diff"),
    f"""WITH v AS (SELECT name, begin, (close - {LAG}) - ({LAG} - lag(close, 2) {W}) AS v FROM bars) SELECT name, {txs()}, {rs('v')} AS diff FROM v
WHERE v IS NOT NULL""", "bars")  # fmt: skip

# Exponential means in SQL: a recursion along the rows of each series.
ROWS = f"k AS (SELECT *, row_number() {W} AS rn, close - {LAG} AS mv FROM bars)"
EWM = """e AS (
  SELECT name, rn, close AS f, close AS s, close AS e20, NULL::DOUBLE AS up, NULL::DOUBLE AS dn FROM k WHERE rn = 1
  UNION ALL
  SELECT k.name, k.rn, e.f + 2.0::DOUBLE / 13 * (k.close - e.f), e.s + 2.0::DOUBLE / 27 * (k.close - e.s), e.e20 + 2.0::DOUBLE / 21 * (k.close -
e.e20),
         CASE WHEN e.up IS NULL THEN greatest(k.mv, 0) ELSE e.up + (greatest(k.mv, 0) - e.up) / 14.0::DOUBLE END, CASE WHEN e.dn IS NULL THEN
greatest(-k.mv, 0) ELSE e.dn + (greatest(-k.mv, 0) - e.dn) / 14.0::DOUBLE END
  FROM e JOIN k ON k.name = e.name AND k.rn = e.rn + 1),
g AS (SELECT name, rn, f - s AS g FROM e WHERE rn = 1 UNION ALL SELECT e.name, e.rn, g.g + 2.0::DOUBLE / 10 * ((e.f - e.s) - g.g) FROM g
JOIN e ON e.name = g.name AND e.rn = g.rn + 1),
x AS (SELECT k.*, e.e20 AS ema_20, e.f - e.s AS macd, g.g AS macd_signal, (e.f - e.s) - g.g AS macd_hist, 100 - 100 / (1 + e.up / (e.dn + 1e-9)) AS
rsi FROM k JOIN e USING (name, rn) JOIN g USING (name, rn))"""
add("feature_rsi", lambda s, d: _select(feat.rsi(A.bars_from_events(s, d)), "rsi", n=4),
    f"WITH {ROWS}, {EWM} SELECT name, {txs()}, {rs('rsi', 4)} AS rsi FROM x", "bars", recursive=True)
add("feature_macd", lambda s, d: _select(feat.macd(A.bars_from_events(s, d)), "macd", "macd_signal", "macd_hist", n=4),
    f"WITH {ROWS}, {EWM} SELECT name, {txs()}, {rs('macd', 4)} AS macd, {rs('macd_signal', 4)} AS macd_signal, {rs('macd_hist', 4)} AS macd_hist FROM x", "bars", recursive=True)
add("feature_ema", lambda s, d: _select(feat.ema(A.bars_from_events(s, d)), "ema_20", n=4),
    f"WITH {ROWS}, {EWM} SELECT name, {txs()}, {rs('ema_20', 4)} AS ema_20 FROM x", "bars", recursive=True)

# ---- pipeline ----
CHECKED = ("log_return", "volatility", "rsi", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bb_width", "ma_20", "ema_20", "intraday", "overnight", "amplitude")
FULL = f"""WITH {ROWS}, {EWM}, t AS (SELECT name, row_number() OVER (ORDER BY min(begin), name) - 1 AS ticker_id FROM bars GROUP BY name),
l AS (SELECT x.*, ln(close) - ln({LAG}) AS log_return FROM x),
y AS (SELECT l.*, close / {LAG} - 1 AS ret, ({guarded('stddev_samp', 'log_return', 14)}) * sqrt(252) AS volatility, {MA} AS ma_20, {SD} AS sd, close
/ open - 1 AS intraday, open / {LAG} - 1 AS overnight, (high - low) / ((high + low) / 2) AS amplitude FROM l),
z AS (SELECT *, ma_20 + 2 * sd AS bb_upper, ma_20 - 2 * sd AS bb_lower, (ma_20 + 2 * sd) - (ma_20 - 2 * sd) AS bb_width FROM y JOIN t USING (name)
WHERE volatility IS NOT NULL AND sd IS NOT NULL)"""
add("features_full",
    lambda s, d: pipelines.featured(A.dup_bars(s, d)).select("name", tx(), "ticker_id", "day_of_week", "month", r("return").alias("return"), *(r(c, 4).alias(c) for c in CHECKED)),
    f"""{FULL} SELECT name, {txs()}, ticker_id::INT AS ticker_id, (isodow(begin) - 1)::INT AS day_of_week, month(begin)::INT AS month, {rs('ret')} AS
\"return\", {', '.join(f'{rs(c, 4)} AS {c}' for c in CHECKED)} FROM z""", "bars", recursive=True)  # fmt: skip


def pipeline_windows(spark, d):
    w = pipelines.training_set(A.dup_bars(spark, d), input_window=100, horizon=90)
    last = F.element_at("feature_window", -1)
    return w.select("name", tx(), F.size("feature_window").alias("n_in"), F.size("target_window").alias("n_out"), r(last[1], 4).alias("x_open"), r(last[8], 3).alias("x_rsi"), r(F.element_at("target_window", -1)).alias("y_last"))


_Z = "({c} - avg({c}) OVER (PARTITION BY name)) / (stddev_samp({c}) OVER (PARTITION BY name) + 1e-9)"
add("pipeline_windows", pipeline_windows, f"""{FULL}, s AS (SELECT name, begin, {_Z.format(c='open')} AS o, {_Z.format(c='rsi')} AS q, log_return, row_number() {W} - 1 AS i, count(*) OVER
(PARTITION BY name) AS n FROM z),
v AS (SELECT name, begin, lag(o) {W} AS o, lag(q) {W} AS q, lead(log_return, 89) {W} AS y, i, n FROM s)
SELECT name, {txs()}, 100 AS n_in, 90 AS n_out, {rs('o', 4)} AS x_open, {rs('q', 3)} AS x_rsi, {rs('y')} AS y_last FROM v
WHERE i >= 100 AND i < n - 90""", "bars", recursive=True)

# ---- forecasts ----
add("price_choice",
    lambda s, d: forecast.prices(A.gappy_bars(s, d).withColumn("close", F.when(F.col("name") != "click", F.col("close")))).select("name", tx(), "price"),
    f"""SELECT name, {txs()}, CASE WHEN name = 'click' THEN open ELSE close END AS price FROM gappy
WHERE CASE WHEN name = 'click' THEN open ELSE close END IS NOT NULL""", "bars", "gappy")  # fmt: skip
add("baseline_forecast", lambda s, d: forecast.baseline_forecast(A.gappy_bars(s, d), 7).select("name", r("forecast_price").alias("forecast_price")),
    f"""WITH n AS (SELECT name, close, row_number() OVER (PARTITION BY name ORDER BY begin DESC) AS k FROM gappy
WHERE close IS NOT NULL), m AS (SELECT name, avg(close) AS p FROM n WHERE k <= 7 GROUP BY name) SELECT name, {rs('p')} AS forecast_price FROM m""", "bars", "gappy")  # fmt: skip


def _prices(s, d):
    return forecast.prices(A.bars_from_events(s, d))


#: The orders that the stepwise search chooses from.
STEPWISE = [(p, q) for p in range(11) for q in range(11) if p + q]
#: The tests on whole lists: columns, their products, and one column after the other swept in.
_SWEPT = """list_transform(range(1, len(m) + 1), lambda a: list_transform(range(1, len(m) + 1), lambda b: CASE WHEN a = j + 1 AND b = j + 1 THEN 1 / m[j + 1][j + 1]
WHEN a = j + 1 THEN m[a][b] / m[a][a] WHEN b = j + 1 THEN -m[a][b] / m[b][b] ELSE m[a][b] - m[a][j + 1] * m[j + 1][b] / m[j + 1][j + 1] END))"""
_TESTS = f"""WITH RECURSIVE {{bars}},
v0 AS (SELECT name, list(close ORDER BY begin, close) AS v FROM bars WHERE close IS NOT NULL GROUP BY name),
v1 AS (SELECT name, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) AS v FROM v0),
v2 AS (SELECT name, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) AS v FROM v1),
t AS (SELECT *, len(v)::INT AS n, list_avg(v) AS mean FROM (SELECT name, 0 AS d, v FROM v0 UNION ALL SELECT name, 1, v FROM v1 UNION ALL SELECT name, 2, v FROM v2)),
u AS (SELECT name, d, n, list_transform(v, lambda x: x - mean) AS l, list_transform(range(1, n), lambda i: v[i + 1] - v[i]) AS g,
least(ceil(12 * pow(n / 100.0, 0.25))::INT, n // 2 - 2) AS k0, floor(cbrt(n - 1) + 1e-9)::INT AS kt FROM t),
c AS (SELECT name, d, n, k0 AS k, false AS trend, [list_transform(range(k0 + 1, n), lambda i: 1.0::DOUBLE)] || [l[k0 + 1:n - 1]]
|| list_transform(range(1, k0 + 1), lambda i: g[k0 + 1 - i:n - 1 - i]) || [g[k0 + 1:n - 1]] AS cols FROM u
UNION ALL SELECT name, d, n, kt, true, [list_transform(range(kt + 1, n), lambda i: 1.0::DOUBLE)] || [list_transform(range(kt + 1, n), lambda i: (i - n / 2)::DOUBLE)]
|| [l[kt + 1:n - 1]] || list_transform(range(1, kt + 1), lambda i: g[kt + 1 - i:n - 1 - i]) || [g[kt + 1:n - 1]] FROM u),
w AS (SELECT name, d, n, k, trend, 0 AS j, list_transform(cols, lambda a: list_transform(cols, lambda b: list_dot_product(a, b))) AS m FROM c
UNION ALL SELECT name, d, n, k, trend, j + 1, {_SWEPT} FROM w WHERE j + 1 < len(m)),
best AS (SELECT name, d, arg_min(j - 2, (n - 1 - k) * ln(m[-1][-1] / (n - 1 - k)) + 2 * j) AS k FROM w WHERE NOT trend AND j >= 2 GROUP BY name, d),
c2 AS (SELECT name, d, n, k, [list_transform(range(k + 1, n), lambda i: 1.0::DOUBLE)] || [l[k + 1:n - 1]]
|| list_transform(range(1, k + 1), lambda i: g[k + 1 - i:n - 1 - i]) || [g[k + 1:n - 1]] AS cols FROM u JOIN best USING (name, d)),
w2 AS (SELECT name, d, n, k, 0 AS j, list_transform(cols, lambda a: list_transform(cols, lambda b: list_dot_product(a, b))) AS m FROM c2
UNION ALL SELECT name, d, n, k, j + 1, {_SWEPT} FROM w2 WHERE j + 1 < len(m)),
a AS (SELECT name, d, n, m[2][-1] / sqrt(m[-1][-1] / (n - 1 - k - j) * m[2][2]) AS t FROM w2 WHERE j + 1 = len(m)),
z AS (SELECT *, CASE WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t END AS z FROM a),
p AS (SELECT name, d, n, t, CASE WHEN t > 2.74 THEN 1 WHEN t < -18.83 THEN 0 ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(200),
lambda i: exp((2 * i + 1) * ln(abs(z)) - (i + 1) * ln(2) - lgamma(i + 1.5) + ln(pi()) / 2))) END AS p FROM z),
tr AS (SELECT name, d, NOT m[3][-1] / sqrt(m[-1][-1] / (n - 1 - k - j) * m[3][3]) >= CASE WHEN n - 1 <= 25 THEN -3.6 WHEN n - 1 <= 50 THEN -3.6 + (n - 26) * 0.1 / 25
WHEN n - 1 <= 100 THEN -3.5 + (n - 51) * 0.05 / 50 WHEN n - 1 <= 250 THEN -3.45 + (n - 101) * 0.02 / 150 WHEN n - 1 <= 500 THEN -3.43 + (n - 251) * 0.01 / 250
WHEN n - 1 <= 100000 THEN -3.42 + (n - 501) * 0.01 / 99500 ELSE -3.41 END AS ok FROM w WHERE trend AND j + 1 = len(m)),
ke AS (SELECT name, d, n, l, least(floor(3 * sqrt(n) / 13)::INT, n - 1) AS q FROM u),
kp AS (SELECT name, d, list_sum(list_transform(range(1, n + 1), lambda i: pow(list_sum(l[1:i]), 2))) / n / n
/ (list_dot_product(l, l) / n + 2.0 / n * coalesce(list_sum(list_transform(range(1, q + 1), lambda h: (1 - h / (q + 1)) * list_dot_product(l[h + 1:n], l[1:n - h]))), 0)) AS k FROM ke)"""


def _tests_sql(body: str) -> str:
    return f"{_TESTS.format(bars=A.SQL['bars'])} {body}"


add("adf_report", lambda s, d: stationarity.stationarity(_prices(s, d)).select("name", *(r(c).alias(c) for c in ("adf", "p_value", "critical_1", "critical_5", "critical_10"))),
    _tests_sql(f"""SELECT name, {rs('t')} AS adf, {rs('p')} AS p_value, {rs('(-3.43035 - 6.5393 / (n - 1))')} AS critical_1, {rs('(-2.86154 - 2.8903 / (n - 1))')} AS critical_5,
{rs('(-2.56677 - 1.5384 / (n - 1))')} AS critical_10 FROM p WHERE d = 1"""))  # fmt: skip
add("diff_order", lambda s, d: stationarity.stationarity(_prices(s, d)).select("name", "d", "ndiffs"),
    _tests_sql("""SELECT name, coalesce(min(p.d) FILTER (p < 0.05), 3)::INT AS d,
greatest(coalesce(min(p.d) FILTER (ok AND p.d < 2), 2), coalesce(min(p.d) FILTER (k <= 0.463 AND p.d < 2), 2))::INT AS ndiffs
FROM p JOIN tr USING (name, d) JOIN kp USING (name, d) GROUP BY name"""))  # fmt: skip
add("arima_grid", lambda s, d: forecast.auto_forecast(A.bars_from_events(s, d), 7))
add("arima_stepwise_bound", lambda s, d: forecast.auto_forecast(A.bars_from_events(s, d), 7, grid=STEPWISE, differences=forecast.ndiffs))
add("sarima_grid",
    lambda s, d: forecast.auto_forecast(A.bars_from_events(s, d), 30, grid=forecast.SEASONAL, model=forecast.sarima).select("name", "model", "order", F.posexplode("path").alias("step", "yhat")))
add("walk_forward", lambda s, d: forecast.walk_forward(_prices(s, d)))


def forecast_requests(spark, d):
    q = A.request_messages(spark, d).withColumn("interval", S.time_frame_interval(F.when(F.col("request_id") % 13 != 0, F.col("time_frame")).otherwise(F.lit("2x"))))
    named = q.withColumn("isin", F.get(F.array(*map(F.lit, ("click", "view", "purchase", "none"))), (F.col("request_id") % 4).cast("int")))
    return forecast.forecast_requests(named, A.bars_by_interval(spark, d))


add("forecast_requests", forecast_requests)

# ---- streams ----
for _name, _query in jobs.QUERIES.items():
    add(_name, _query, *jobs.ORACLES.get(_name, (None,)))
