"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, ship

#: Words of every operator that counts white-space separated words.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A key with more than 1 / SPREAD of all rows is spread over several tasks: fewer than SPREAD keys are.
SPREAD = 2000
#: Keys with so few rows need no spreading.
LEAST_HOT = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Put the package on the executors, and let a session that says nothing else pass whole texts to Python a thousand
    rows at a time: a batch is held as a whole on both sides."""
    ship(spark)
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def prepared(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """query(spark, ...), in a prepared session."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        prepare(spark)
        return query(spark, *args)

    return run


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it from there: lineage ends, and lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def host_of(url: Column) -> Column:
    """Host of a URL, lower-cased; empty for null or without ://."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def own_prefix(*frames: DataFrame) -> str:
    """What no column of the frames begins with, for columns that an operator adds for itself."""
    taken, prefix = [c.lower() for df in frames for c in df.columns], "_"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def named(name: str) -> Column:
    """The column of just this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_results(df: DataFrame, own: str, results: Mapping[str, Column]) -> DataFrame:
    """df without the operator's own columns, and with results in place of columns of their names in whatever case."""
    new = {c.lower() for c in results}
    return df.select(*(named(c) for c in df.columns if not c.startswith(own) and c.lower() not in new), *(v.alias(c) for c, v in results.items()))


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of text, or one longer row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, parts): the keys with more than 1 / SPREAD of all rows, of which there are fewer than SPREAD, and over how many
    tasks each is to be dealt. rows are read twice."""
    share = F.col("count") * SPREAD / max(rows.count(), 1)
    return materialize(rows.groupBy(key).count().filter((share > 1) & (F.col("count") > LEAST_HOT)).select(key, F.ceil(share).cast("int").alias("parts")).coalesce(1), "hot-keys")


def dealt(rows: DataFrame, hot: DataFrame, key: str, by: str, salt: str) -> DataFrame:
    """Adds salt: which of its key's tasks the row goes to, by a hash of `by`."""
    rows = rows.join(F.broadcast(hot), key, "left")
    return rows.withColumn(salt, F.pmod(F.xxhash64(F.lit(5), by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def copied(side: DataFrame, hot: DataFrame, key: str, salt: str) -> DataFrame:
    """Adds salt: a copy of the row for each of its key's tasks."""
    side = side.join(F.broadcast(hot), key, "left")
    return side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def join_spread(rows: DataFrame, side: DataFrame, key: str, by: str, few: int, how: str = "inner") -> DataFrame:
    """rows joined with side, which has one row a key. Up to `few` rows, side is broadcast; else both are shuffled, a key
    with many rows is dealt to several tasks by a hash of `by`, and its row of side goes to each of them."""
    if side.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(side), key, how)
    own = own_prefix(rows, side)
    salt, parts = f"{own}salt", f"{own}parts"
    hot = hot_keys(rows.select(key), key).withColumnRenamed("parts", parts)
    n = F.coalesce(parts, F.lit(1))
    rows = rows.join(F.broadcast(hot), key, "left").withColumn(salt, F.pmod(F.xxhash64(F.lit(5), by), n).cast("int")).drop(parts)
    side = side.join(F.broadcast(hot), key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), n - 1))).drop(parts)
    return rows.join(side, [key, salt], how).drop(salt)


def global_rank(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "rank", rank: str = "_rank") -> DataFrame:
    """Add `rank`, the 0-based position by `order` within `group`; group columns are the leading, non-null ones of order.

    Rows are range-partitioned by the whole order, so a hot group is spread over many tasks; only one count for each
    partition and group is summed up. The ranked rows are written once, so all later reads agree.
    """
    own = own_prefix(df)
    at, part, idx, lo, n, before = (f"{own}{c}" for c in ("at", "part", "idx", "lo", "n", "before"))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    rows = materialize(dealt, name).withColumns({part: F.shiftright(at, 33), idx: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))})
    keys = [*group, part]
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(F.count("*").alias(n), F.min(idx).alias(lo)).withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    return rows.join(starts, keys).withColumn(rank, F.col(before) + F.col(idx) - F.col(lo)).drop(at, part, idx, lo, before)
