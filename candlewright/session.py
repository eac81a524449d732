"""What a session needs to run this package's Python helpers on executors."""

from __future__ import annotations

import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context; needless where it is installed on them, but harmless."""
    sc = spark.sparkContext
    if not getattr(sc, "_candlewright_shipped", False):
        root = Path(__file__).resolve().parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/candlewright", "zip", root.parent, root.name))
        sc._candlewright_shipped = True


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """query(spark, ...), after the package is on the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        ship(spark)
        return query(spark, *args)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a local run gets a new one
    and a cluster is refused: its executors would write to disks that nobody else sees."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
