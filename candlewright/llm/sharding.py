"""Shards balanced in bytes, tokens and rows together, by vector bin packing.

Items are groups of equal texts. Heavy groups, of which there can be no more than a fixed number, are packed first and
whole, larger ones before smaller ones. Only a group that fits in no shard any more, so that placing it whole would break
the balance, is cut into pieces by a hash of the row's id, which are packed next. The many light groups are packed in
independent parts, each of which owns its share of the room that is left. Every item goes where the dot product of its
demand with the residual capacity is highest, among the shards in which it fits.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_rank, materialize, own_prefix, with_results, words

DIMS = ("bytes", "tokens", "n_rows")
#: Pieces of a cut group hold at most 1 / (shards x PIECES) of the total; groups of less are never cut.
PIECES = 64
#: An item above 1 / (shards x HEAVY) of the total is heavy: at most 3 x shards x HEAVY exist.
HEAVY = 512
#: Light items a part packs.
PART_ITEMS = 20_000
ITEM = "g string, piece int, shard int"


class Bins:
    """Shards with what is left of their capacity in each dimension."""

    def __init__(self, capacity: list[list[float]]):
        self.left = capacity
        self.scale = [max(sum(max(c[d], 0.0) for c in capacity), 1e-9) for d in range(len(capacity[0]))]

    def need(self, item: tuple) -> list[float]:
        """The item's demand as shares of the whole capacity."""
        return [x / s for x, s in zip(item, self.scale, strict=True)]

    def place(self, item: tuple, only_if_it_fits: bool = False) -> int | None:
        """The shard with the highest dot product of demand and residual capacity, among those in which the item fits, else
        among those with room for its bytes, else among all; its capacity is used up. None if the item has to fit and does
        not."""
        need = self.need(item)
        best, best_rank = 0, (False, False, -math.inf)
        for j, room in enumerate(self.left):
            fits = all(x <= c for x, c in zip(item, room, strict=True))
            rank = (fits, item[0] <= room[0], sum(a * c / s for a, c, s in zip(need, room, self.scale, strict=True)))
            if rank > best_rank:
                best, best_rank = j, rank
        if only_if_it_fits and not best_rank[0]:
            return None
        self.left[best] = [c - x for c, x in zip(self.left[best], item, strict=True)]
        return best


def pack(items: list[tuple], capacity: list[list[float]], may_cut: list[bool] | None = None) -> list[int | None]:
    """Shard of each item (its demand in each dimension); capacity[shard][dim] is used up. Larger items choose first. None for
    an item that fits nowhere and may be cut."""
    bins = Bins(capacity)
    out: list[int | None] = [None] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -max(bins.need(items[i]))):
        out[i] = bins.place(items[i], bool(may_cut and may_cut[i]))
    return out


def _sized(docs: DataFrame, id_col: str, text_col: str, own: str) -> DataFrame:
    """Adds g (the group of equal texts; null is one group), bytes, tokens and h (a hash of the row), behind the prefix."""
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    return docs.withColumns({f"{own}g": F.coalesce(F.md5(text), F.lit("")), f"{own}bytes": size, f"{own}tokens": F.size(words(text)).cast("long"), f"{own}h": F.xxhash64(F.col(id_col), text)})


def _sums() -> list:
    return [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows")]


def plan(rows: DataFrame, n_shards: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cut groups with their number of pieces, shards of heavy (g, piece), shards of light ones) for rows (g, bytes, tokens, h)."""
    spark = rows.sparkSession
    groups = materialize(rows.groupBy("g").agg(*_sums()), "shard-groups")
    t = groups.agg(*(F.sum(d).alias(d) for d in DIMS)).first()
    total = [float(t[d] or 0) for d in DIMS]
    share = F.greatest(*(F.col(d) / max(x, 1.0) for d, x in zip(DIMS, total, strict=True)))
    heavy_if = share > 1 / (n_shards * HEAVY)
    heavy = sorted(map(tuple, groups.filter(heavy_if).select("g", *DIMS).collect()))
    capacity = [[x / n_shards for x in total] for _ in range(n_shards)]
    part = lambda x: max(v / max(all_, 1.0) for v, all_ in zip(x[1:], total, strict=True))
    placed = pack([x[1:] for x in heavy], capacity, [x[3] > 1 and part(x) > 1 / (n_shards * PIECES) for x in heavy])
    done = [(x[0], 0, j) for x, j in zip(heavy, placed, strict=True) if j is not None]
    # at most 3 x shards x PIECES groups hold so much of a dimension
    cut = [(x[0], math.ceil(part(x) * 2 * n_shards * PIECES)) for x, j in zip(heavy, placed, strict=True) if j is None]
    hot = spark.createDataFrame(cut, "g string, pieces int")
    if cut:
        pieces = with_piece(rows.join(F.broadcast(hot.select("g")), "g", "left_semi"), hot).groupBy("g", "piece").agg(*_sums())
        got = sorted(map(tuple, pieces.select("g", "piece", *DIMS).collect()))
        done += [(x[0], x[1], j) for x, j in zip(got, pack([x[2:] for x in got], capacity), strict=True)]
    light = groups.filter(~heavy_if)
    parts = max(1, math.ceil(light.count() / PART_ITEMS))
    rest = [max(sum(max(c[d], 0.0) for c in capacity), 1e-9) for d in range(len(DIMS))]

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g")
        need = list(zip(*(pdf[d].astype(float) for d in DIMS), strict=True))
        own = [sum(x[d] for x in need) / rest[d] for d in range(len(DIMS))]
        room = [[c * p for c, p in zip(shard, own, strict=True)] for shard in capacity]
        return pdf[["g"]].assign(piece=0, shard=pack(need, room))

    dealt = light.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts))).repartition(parts, "part")
    return hot, spark.createDataFrame(done, ITEM), dealt.groupBy("part").applyInPandas(place, ITEM)


def with_piece(rows: DataFrame, hot: DataFrame, own: str = "") -> DataFrame:
    """Adds piece; hot has at most 3 x shards x PIECES rows, so it is broadcast."""
    g, h, piece, pieces = (f"{own}{c}" for c in ("g", "h", "piece", "pieces"))
    hot = hot.withColumnsRenamed({"g": g, "pieces": pieces})
    return rows.join(F.broadcast(hot), g, "left").withColumn(piece, F.coalesce(F.pmod(h, pieces).cast("int"), F.lit(0))).drop(pieces)


def with_shard(rows: DataFrame, hot: DataFrame, heavy: DataFrame, light: DataFrame, own: str = "") -> DataFrame:
    """Adds shard. Heavy items, at most 3 x shards x (HEAVY + 2 x PIECES), are broadcast, so only rows of light ones are joined
    by their group; the others are dealt out by their own hash meanwhile."""
    g, h, piece, shard, first, key = (f"{own}{c}" for c in ("g", "h", "piece", "shard", "first", "key"))
    heavy = heavy.withColumnsRenamed({"g": g, "piece": piece, "shard": first})
    rows = with_piece(rows, hot, own).join(F.broadcast(heavy), [g, piece], "left")
    rows = rows.withColumn(key, F.when(F.col(first).isNull(), F.col(g)).otherwise(F.concat(F.lit("#"), F.col(h).cast("string"))))
    light = light.select(F.col("g").alias(key), F.col("shard").alias(shard))
    return rows.join(light, key, "left").withColumn(shard, F.coalesce(first, shard)).drop(first, key)


def assign_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a `shard` column (int, 0 to n_shards - 1).

    Null text has no bytes and no tokens and forms one group with no other text; each row weighs its UTF-8 bytes plus 1.
    Equal texts lie in one shard, unless their group fits in none; then rows equal in id and text still do. A very long
    text is one item that is never cut. An empty table gives an empty result. A column named shard, in whatever case, is
    replaced; all others are carried along, whatever their names.
    """
    own = own_prefix(docs)
    sized = _sized(docs, id_col, text_col, own)
    rows = sized.select(*(F.col(f"{own}{c}").alias(c) for c in ("g", "bytes", "tokens", "h")))
    out = with_shard(sized, *plan(materialize(rows, "shard-sizes"), n_shards), own)
    return with_results(out, own, {"shard": F.col(f"{own}shard")})


def shard_manifest(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs without its text: id, size, text_crc32, law, shard, slot, grown_shard, n_tokens.

    slot counts up from 0 within the shard. The law is `bytes`: the sums of size are nearly equal. Edge cases as in
    assign_shards; columns other than id and text are not read.
    """
    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sized = _sized(bare, "id", "text", "").select("id", "g", "bytes", "tokens", "h", F.coalesce(F.crc32("text"), F.lit(0)).alias("crc"))
    rows = materialize(sized, "shard-sizes")
    placed = with_shard(rows, *plan(rows, n_shards)).select("id", "bytes", "tokens", "crc", "shard", "h")
    ranked = global_rank(placed, ["shard", "h", "crc"], ["shard"], "shard-slots", "slot")
    return ranked.select(
        F.col("id").alias(id_col),
        F.col("bytes").alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("tokens").alias("n_tokens"),
    )
