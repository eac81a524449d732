"""Mixing sources to target weights by systematic sampling.

Every row of a source has the same expected number of copies, target / source size. Within a source the rows are laid
out by size; with one random offset for the source, a row is emitted once for each integer boundary that the running sum
of expected copies crosses. As neighbours have nearly equal sizes, the words taken come within about one long document
of the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import global_rank, named, own_prefix, with_results, words


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Targets of sources: sizes has (null, src, source_size); adds target and offset. One task sees one row a source.

    Sources in code point order (null last) weigh `weights`, repeating, and share the sum of all sizes. No target passes
    cap x source_size; what is above is shared by weight among the others until none is above. That limit is the level L
    with sum(min(cap x size, L x weight)) = total: with sources by rising cap x size / weight, it is the first at which
    the next source stays below its cap.
    """
    by_name = Window.orderBy("null", "src")
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    w = sizes.withColumn("_w", weight).withColumns({"_room": F.col("source_size") * F.lit(float(cap))})
    up = Window.orderBy(F.col("_room") / F.col("_w"), "null", "src")
    w = w.withColumns(
        {
            "_total": F.sum("source_size").over(Window.partitionBy(F.lit(0))),
            "_full": F.coalesce(F.sum("_room").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_rest": F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = (F.col("_total") - F.col("_full")) / F.col("_rest")
    w = w.withColumn("_level", F.first(F.when(level * F.col("_w") <= F.col("_room"), level), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_room"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_room")))
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("mix"), F.col("null").cast("string"), F.col("src"))), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    return w.select("null", "src", "source_size", target.alias("target"), offset.alias("offset"))


def mix(docs: DataFrame, size: Column, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with `size`, `copies` (how often the mix emits the row), `source_size` and `target`.

    A null source is a source of its own; null ids, ties and repeated rows are rows like any other (ordered by size, then
    id). A null size, as of a null text, counts as 0; very long texts are one row each and come at most 3 times. A source
    without words has target 0 and no copies. An empty table gives an empty result. Reruns agree: the order is total up to
    equal rows and the offsets hash the source's name. Columns of the four names, in whatever case, are replaced; all
    others stay, whatever their names.
    """
    own = own_prefix(docs)
    null, src, words_of, rank, offset, total, target = (f"{own}{c}" for c in ("null", "src", "size", "rank", "offset", "total", "target"))
    keyed = docs.withColumns({null: F.col(source_col).isNull().cast("int"), src: F.coalesce(F.col(source_col), F.lit("")), words_of: F.coalesce(size, F.lit(0)).cast("long")})
    ranked = global_rank(keyed, [null, src, words_of, id_col], [null, src], "mix", rank)
    sizes = ranked.groupBy(F.col(null).alias("null"), F.col(src).alias("src")).agg(F.sum(words_of).alias("source_size"))
    targets = source_targets(sizes, weights, cap).withColumnsRenamed({"null": null, "src": src, "source_size": total, "target": target, "offset": offset})
    each = F.when(F.col(total) > 0, F.col(target) / F.col(total)).otherwise(F.lit(0.0))
    edge = lambda k: F.floor(F.col(offset) + (F.col(rank) + k) * each)
    out = ranked.join(F.broadcast(targets) if targets_are_few(sizes) else targets, [null, src])
    return with_results(out, own, {"size": F.col(words_of), "copies": edge(1) - edge(0), "source_size": F.col(total), "target": F.col(target)})


def targets_are_few(sizes: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of sources may be broadcast; beyond that many sources it is joined by shuffle."""
    return sizes.limit(most + 1).count() <= most


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: rows of docs, each as often as it is emitted, with the columns of docs. Sizes are words of the whole
    text; edge cases as in mix (a null or empty text has no words and, by its source's rate, stays or goes like others)."""
    box, text = own_prefix(docs), F.col(text_col)
    boxed = docs.select(F.struct(*map(named, docs.columns)).alias(box), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words(text)).alias("words"))
    out = mix(boxed, F.col("words"), weights, cap, "id", "source").filter("copies > 0")
    return out.select(box, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(f"{box}.*")


def mix_report(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies for every row of docs."""
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).alias("words"))
    return mix(sized, F.col("words"), weights, cap).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


#: The same in DuckDB.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, (source IS NULL)::INT AS nl, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY nl, src ORDER BY size, doc_id NULLS FIRST) - 1 AS rk FROM d),
s AS (SELECT nl, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY nl, src) - 1) % 3 + 1] AS w,
             source_size * 3.0::DOUBLE AS room FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(room) OVER (ORDER BY room / w, nl, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
0.0))
             / sum(w) OVER (ORDER BY room / w, nl, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
m AS (SELECT *, first_value(CASE WHEN lev * w <= room THEN lev END IGNORE NULLS) OVER (ORDER BY room / w, nl, src ROWS BETWEEN UNBOUNDED PRECEDING
AND UNBOUNDED FOLLOWING) AS level FROM l),
t AS (SELECT nl, src, source_size, least(room, coalesce(level * w, room)) AS target,
             ('0x' || substr(md5('mix:' || nl || ':' || src), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u FROM m),
c AS (SELECT r.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e FROM r JOIN t USING (nl, src))
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       ((floor(u + (rk + 1) * e) - floor(u + rk * e))::BIGINT * size)::BIGINT AS taken, source,
       (floor(u + (rk + 1) * e) - floor(u + rk * e))::BIGINT AS copies
FROM c
"""
