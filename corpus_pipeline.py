"""From documents to shards: quality, near-duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet below the shared
folder and reads it again, so a stage starts from files and lost executors never reach back beyond them.

Every stage takes docs with at least the columns of documents and returns just these (the last one with shard); other
columns, whatever their names, are not carried on. Each gives an empty result for an empty table, reads very long texts
whole, and treats the rest as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewright.llm.common import materialize, prepare, read
from candlewright.llm.decontamination import decontaminate
from candlewright.llm.minmax_dedup import deduplicate
from candlewright.llm.mixing import mixed
from candlewright.llm.quality_classifier import classify
from candlewright.llm.sharding import assign_shards

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier selects; rejected ones go, and with them null texts and those without words. Repeated
    rows and equal texts get equal ratings, so they stay or go together; null ids, languages and sources don't matter."""
    prepare(spark)
    return classify(docs, read(spark, sf_dir, "labels")).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; null ids come last, and of rows equal in id
    and text one stays. Texts without words, null ones among them, all stay."""
    prepare(spark)
    return deduplicate(docs).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Repeated rows stay or go together; null texts hold no passage."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, 0 to 3 times. Rows without a source are a source by themselves;
    ties in size go by id, repeated rows are rows like any other, and a null text has size 0."""
    return mixed(docs).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard of 8. Equal texts share one unless their group fits in none; null texts are a group."""
    prepare(spark)
    return assign_shards(docs, 8).select(*COLUMNS, "shard")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("mixing", mixing), ("sharding", sharding)]

#: The classifier's fit and the min-max links are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
