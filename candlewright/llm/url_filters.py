"""URL filters: path rules, and a Bloom filter cascade for the listed keys that no rule covers.

The cascade is built over all keys of the corpus: level 0 encodes the listed keys, level 1 the other keys that level 0
lets through, level 2 the listed keys that level 1 lets through, and so on until nothing is let through. A key of the
corpus is listed exactly if the first level that rejects it is an odd one. Keys are dealt to parts by hash, each with a
cascade of its own; together they take a few bits a listed key. Where all parts fit in BROADCAST_BYTES every task has
them and rows stay where they are; beyond that, rows are dealt to the parts' tasks. No row is joined by its key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, named

PART_KEYS = 100_000
BROADCAST_BYTES = 16 << 20
#: Up to so many parts, their numbers of tasks are broadcast (12 bytes each).
BROADCAST_PARTS = 1_000_000
#: Rows that one task of the second form holds.
TASK_ROWS = 50_000
#: (verdict, host and path) of the production rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LEVELS = "part long, level int, n_hashes int, bits binary"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    return ascii_lower(host), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _at(h1: np.ndarray, h2: np.ndarray, level: int, n_hashes: int, n_bits: int) -> np.ndarray:
    """Bit positions of each key, of shape (keys, n_hashes)."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    a, b = (h1 ^ salt) * np.uint64(0xFF51AFD7ED558CCD), (h2 + salt) * np.uint64(0xC4CEB9FE1A85EC53)
    a, b = a ^ (a >> np.uint64(32)), (b ^ (b >> np.uint64(29))) | np.uint64(1)
    return (a[:, None] + np.arange(n_hashes, dtype=np.uint64) * b[:, None]) % np.uint64(n_bits)


def _passes(h1: np.ndarray, h2: np.ndarray, level: int, n_hashes: int, bits: np.ndarray) -> np.ndarray:
    at = _at(h1, h2, level, n_hashes, len(bits) * 8)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def build_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Levels (number of hashes, bits) for keys given as two 64-bit hashes; none if nothing is listed."""
    levels: list[tuple[int, np.ndarray]] = []
    members, others = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(members):
        rate = min(0.5, len(members) / (math.sqrt(2) * max(len(others), 1))) if not levels else 0.5
        n_hashes = max(1, round(-math.log2(rate)))
        bits = np.zeros(8 * math.ceil((len(members) * n_hashes * 1.4427 + 1) / 64), np.uint8)
        at = _at(h1[members], h2[members], len(levels), n_hashes, len(bits) * 8).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        passed = others[_passes(h1[others], h2[others], len(levels), n_hashes, bits)]
        levels.append((n_hashes, bits))
        if len(levels) > 200:
            raise ValueError("two different keys have equal hashes")
        members, others = passed, members
    return levels


def is_listed(h1: np.ndarray, h2: np.ndarray, levels: Sequence[tuple[int, np.ndarray]]) -> np.ndarray:
    """Membership of keys of the universe the levels were built over."""
    out, alive = np.full(len(h1), len(levels) % 2 == 1), np.ones(len(h1), bool)
    for k, (n_hashes, bits) in enumerate(levels):
        passed = _passes(h1, h2, k, n_hashes, bits)
        out[alive & ~passed] = k % 2 == 1
        alive &= passed
    return out


def _hashed(df: DataFrame, key: Column, parts: int) -> DataFrame:
    return df.withColumns({"_h1": F.xxhash64(key), "_h2": F.xxhash64(F.lit(7), key), "_part": F.pmod(F.xxhash64(F.lit(11), key), F.lit(parts)).cast("long")})


def cascade(keys: DataFrame) -> tuple[DataFrame, int]:
    """(levels of all parts, number of parts) for keys: one row (key, listed) for each key of the universe."""
    keys = materialize(keys, "url-keys")
    parts = max(1, math.ceil(keys.count() / PART_KEYS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = build_cascade(pdf["_h1"].to_numpy().view(np.uint64), pdf["_h2"].to_numpy().view(np.uint64), pdf["listed"].to_numpy(bool))
        return pd.DataFrame({"part": pdf["_part"].iloc[0], "level": range(len(levels)), "n_hashes": [n for n, _ in levels], "bits": [b.tobytes() for _, b in levels]})

    made = _hashed(keys, F.col("key"), parts).select("_part", "_h1", "_h2", "listed").repartition(parts, "_part").groupBy("_part").applyInPandas(build, LEVELS)
    return materialize(made, "url-cascade"), parts


def _read_levels(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray]]:
    pdf = pdf.sort_values("level")
    return [(int(n), np.frombuffer(bytes(b), np.uint8)) for n, b in zip(pdf["n_hashes"], pdf["bits"], strict=True)]


def probe(rows: DataFrame, key: Column, levels: DataFrame, parts: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows with `listed`, for keys of the cascade's universe."""
    spark, columns = rows.sparkSession, rows.columns
    rows = _hashed(rows, key, parts)
    size = levels.agg(F.sum(F.length("bits"))).first()[0] or 0
    if size <= broadcast_bytes:
        got = levels.toPandas()
        held = spark.sparkContext.broadcast({int(p): _read_levels(g) for p, g in got.groupby("part")})

        @F.pandas_udf("boolean")
        def listed(part: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.Series:
            out = np.zeros(len(part), bool)
            p, a, b = part.to_numpy(), h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)
            for k in np.unique(p):
                here = p == k
                out[here] = is_listed(a[here], b[here], held.value.get(int(k), []))
            return pd.Series(out)

        return rows.withColumn("listed", listed("_part", "_h1", "_h2")).select(*columns, "listed")
    # each part's rows go to as many tasks as they need, and its levels to all of those
    counts = materialize(rows.groupBy("_part").agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("_tasks")), "url-parts")
    # by a hash of the whole row, so that a task that is run again deals alike
    row = F.xxhash64(*(named(f.name) for f in rows.schema if "map<" not in f.dataType.simpleString()))
    rows = rows.join(F.broadcast(counts) if parts <= BROADCAST_PARTS else counts, "_part").withColumn("_task", F.pmod(row, F.col("_tasks")).cast("int")).drop("_tasks")
    copies = levels.join(counts.withColumnRenamed("_part", "part"), "part").withColumn("_task", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)))
    schema = rows.select(*columns).schema.add("listed", "boolean")

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = is_listed(left["_h1"].to_numpy().view(np.uint64), left["_h2"].to_numpy().view(np.uint64), _read_levels(right))
        return left[columns].assign(listed=found)

    return rows.groupBy("_part", "_task").cogroup(copies.select(F.col("part").alias("_part"), "_task", "level", "n_hashes", "bits").groupBy("_part", "_task")).applyInPandas(match, schema)


def tracked_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The corpus's keys (host and path) with listed = some URL of the key carries a campaign parameter (`utm_...`)."""
    host, path = host_and_path(F.col(url_col))
    listed = F.coalesce(F.col(url_col).rlike(r"[?&]utm_"), F.lit(False))
    return pages.select(F.concat(host, path).alias("key"), listed.alias("listed")).groupBy("key").agg(F.max("listed").alias("listed"))


def judge_urls(pages: DataFrame, keys: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each of pages: id, host, path, rule, verdict, listed.

    keys (key, listed) must hold every host + path of pages once, listed not null. The longest rule that fits decides;
    else listed keys are blocked and others allowed. URLs that are null or have no :// have empty host and path, which no
    rule fits. Equal rows get equal results, ids are not read, and an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    levels, parts = cascade(keys)
    rows = probe(rows, F.concat("host", "path"), levels, parts, broadcast_bytes)
    r = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(r["verdict"], F.when(F.col("listed"), "block").otherwise("allow"))
    return rows.select(id_col, "host", "path", r["rule"].alias("rule"), verdict.alias("verdict"), "listed")


#: The same in DuckDB, for the rules above and the keys of tracked_keys.
URLS_SQL = r"""
WITH u AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT page_id, url, translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
k AS (SELECT *, bool_or(coalesce(regexp_matches(url, '[?&]utm_'), false)) OVER (PARTITION BY host || path) AS listed FROM h),
r AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
                     WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
                     WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
                     WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
                     WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM k)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""
