"""Queries of the training-data operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import host_of, prepared, read
from .decontamination import LEAKS_SQL, find_leaks
from .html_template import extract
from .license_scan import scan_licenses
from .line_dedup import LINES_SQL, drop_site_lines, html_lines
from .minmax_dedup import NEAR_SQL, near_duplicates
from .mixing import MIX_SQL, mix_report
from .periodic_runs import periodic_runs
from .quality_classifier import classify
from .quality_rules import RULES_SQL, judge
from .sharding import shard_manifest
from .token_alignment import align_documents, read_models
from .token_codes import token_table
from .url_filters import URLS_SQL, judge_urls, tracked_keys


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_tokenizer() -> str:
    return tokenizer_path("byte_bpe_50k.json")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_manifest(read(spark, sf_dir, "documents"), 8)


def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(read(spark, sf_dir, "documents"), default_tokenizer(), end_id=2)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("_m", "items")


def op7_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, read(spark, sf_dir, "labels")).drop("text")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, tracked_keys(pages))


def op1_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return drop_site_lines(pages, html_lines(F.col("html")), host_of(F.col("url"))).select("page_id", "host", "text", "n_lines", "n_dropped")



def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = read_models(default_tokenizer(), tokenizer_path("piece_bpe_32k.model"))
    found = align_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), *models)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def planted_loops(ids: list, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where and with which period this query's documents repeat themselves; those without an id don't."""
    h = np.array([1 if i is None else zlib.crc32(str(i).encode()) for i in ids], np.int64)
    g = h // 10
    start = g % np.maximum(n_words, 1)
    return start, np.where((h % 10 == 0) & (n_words > 0), 1 + (n_words - start) // (3 + g % 8), 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(read(spark, sf_dir, "documents").select("doc_id", "text"), loops=planted_loops)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    rows = found.withColumns({"best": best, "lines": lines}).withColumns({"start": -F.col("best.before"), "length": F.col("best.length"), "period": -F.col("best.short")})
    exponent = F.expr("1000 * length div period").alias("exponent_milli")
    return rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "start", "length", "period", exponent, F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: prepared(f) for f in (op1_html_template, op3_line_dedup, op2_quality_classifier, op4_url_filters, op8_quality_rules, op7_minmax_dedup, op5_shards, op6_token_codes, op9_mix, op10_decontamination, op11_token_alignment, op12_periodic_runs, op13_license_scan)}
ORACLES: dict[str, str] = {"op7_minmax_dedup": NEAR_SQL, "op3_line_dedup": LINES_SQL, "op4_url_filters": URLS_SQL, "op8_quality_rules": RULES_SQL, "op10_decontamination": LEAKS_SQL, "op9_mix": MIX_SQL}
