"""Benchmark decontamination by a prefix-filtered containment join.

The sets are windows of benchmark items (10 consecutive words, or a shorter item as a whole), the tokens are their word
shingles in order of rarity over all documents. A window is contained only if all its tokens are there, so a prefix of
one token, the rarest, is necessary and enough to find every candidate; windows with a token that no document holds
cannot occur. The joined candidates are bounded by position (the window must begin and end inside the document) and by
length, and the words themselves are compared. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_spread, let, materialize, own_prefix

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words of a shingle; windows with fewer words are one shingle.
SHINGLE = 3
#: Positions are sifted by a bitmap of the tokens' hashes, of at most 16 MB, before they become rows.
MOST_BITS = 1 << 27
#: Up to so many windows, they are broadcast (about 200 bytes each); beyond, they are joined by shuffle.
BROADCAST_WINDOWS = 100_000
#: And of so many bytes, their items' ids included.
BROADCAST_BYTES = 16 << 20


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _shingle(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(words, at + j) for j in range(k)))


def _shingles(words: Column, k: int) -> Column:
    """Hashes of all k-word shingles, in order."""
    return F.when(F.size(words) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: _shingle(words, i, k)))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: `win` (words), `n` (their number), `items` (ids, as strings, of the items that hold it)."""
    cut = let(
        item_words(F.col(text_col)),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<array<string>>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (window - 1), F.lit(1))), lambda s: F.slice(w, s, F.lit(window)))
        ),
    )
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.explode(cut).alias("win"))
    return rows.groupBy("win").agg(F.collect_set("item").alias("items")).withColumn("n", F.size("win"))


def _bitmap(tokens: DataFrame, most_bits: int = MOST_BITS) -> tuple[Column, Callable[[Column], Column]]:
    """(a bitmap of the hashes h of tokens, as a scalar subquery; the test whether a hash's bit is set).

    It has 32 bits or more a token, up to most_bits: 4 MB for a million tokens, never over 16 MB. What passes by chance is
    sorted out by the joins that follow.
    """
    bits = 1 << max(10, min(most_bits.bit_length() - 1, (32 * tokens.count()).bit_length()))
    slot = lambda h: h.bitwiseAND(F.lit(bits - 1)).cast("int")
    words = tokens.select(slot(F.col("h")).alias("s")).groupBy(F.shiftright("s", 6).alias("k")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("s").bitwiseAND(F.lit(63)))).alias("w"))
    # the words of the bitmap lie in order in one row: gaps are filled with zeros
    every = tokens.sparkSession.range(bits >> 6).select(F.col("id").cast("int").alias("k"))
    row = every.join(words, "k", "left").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("w", F.lit(0).cast("bigint")).alias("w")))).alias("b")).select(F.col("b.w").alias("b"))
    row = materialize(row, "leak-bitmap")

    def test(map_: Column, h: Column) -> Column:
        at = slot(h)
        return F.getbit(F.get(map_, F.shiftright(at, 6)), at.bitwiseAND(F.lit(63))) == 1

    return row.scalar(), test


def _anchors(docs: DataFrame, windows: DataFrame, text_col: str, sizes: list[int]) -> DataFrame:
    """Windows that may occur, each with the hash `h` of its rarest shingle over all documents and its offset `off`."""
    parts = windows.withColumn("text", F.array_join("win", " ")).withColumn("k", F.least("n", F.lit(SHINGLE)))
    tokens = None
    for k in sizes:
        one = parts.filter(F.col("k") == k).select("text", "n", "items", F.posexplode(_shingles(F.col("win"), k)).alias("off", "h"))
        tokens = one if tokens is None else tokens.union(one)
    tokens = materialize(tokens, "leak-tokens")
    wanted = materialize(tokens.select("h").distinct(), "leak-wanted")
    bitmap, test = _bitmap(wanted)
    sifted = lambda w, m: F.concat(*(F.filter(_shingles(w, k), lambda h: test(m, h)) for k in sizes))
    found = let(item_words(F.col(text_col)), lambda w: let(F.col("bitmap"), lambda m: sifted(w, m)))
    seen = docs.withColumn("bitmap", bitmap).select(F.explode(found).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    ranked = tokens.join(seen, "h", "left").groupBy("text", "n", "items").agg(F.min(F.coalesce("df", F.lit(0))).alias("least"), F.min_by(F.struct("h", "off"), F.struct(F.coalesce("df", F.lit(0)), "off")).alias("a"))
    return materialize(ranked.filter("least > 0").select("a.h", "a.off", "text", "n", "items"), "leak-anchors")


HIT = "array<struct<h:bigint,pos:int,from:int,ctx:array<string>>>"


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """For each row of docs: id, _m (md5 of its text), n_words, n_hit, n_items, items_sha256, contaminated, items.

    Null and empty texts have no words, and items without words have no windows. Very long texts are searched whole. Equal
    rows give equal rows, as often as they come. Ids may be null (an item's null id counts as the empty string); other
    columns are not read, whatever their names. An empty table of documents gives an empty result, an empty table of items
    leaves all documents clean.
    """
    windows = materialize(item_windows(items, item_id_col, item_text_col, window), "leak-windows")
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect())  # 1 to SHINGLE
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    own = F.array(F.struct(F.xxhash64("_id", "text").alias("h"), F.lit(-1).alias("pos"), F.lit(0).alias("from"), F.array().cast("array<string>").alias("ctx"))).cast(HIT)
    anchors = _anchors(docs, windows, "text", sizes) if sizes else None
    if anchors is not None:
        size = anchors.agg(F.count("*").alias("n"), F.sum(F.length("text") + F.size("items") * 40).alias("b")).first()
        few = size["n"] <= BROADCAST_WINDOWS and (size["b"] or 0) <= BROADCAST_BYTES
        bitmap, test = _bitmap(materialize(anchors.select("h").distinct(), "leak-prefixes"))

    def candidates(w: Column, m: Column) -> Column:
        found = []
        for k in sizes:
            at = F.filter(F.transform(_shingles(w, k), lambda h, i: F.struct(h.alias("h"), i.alias("pos"))), lambda x: test(m, x.h))
            lo = lambda x: F.greatest(x.pos - (window - 1), F.lit(0))
            found.append(F.transform(at, lambda x: F.struct(x.h.alias("h"), x.pos.alias("pos"), lo(x).alias("from"), F.slice(w, lo(x) + 1, x.pos - lo(x) + window).alias("ctx"))))
        return F.concat(own, *(x.cast(HIT) for x in found))

    hits = (lambda w: let(F.col("bitmap"), lambda m: candidates(w, m))) if sizes else (lambda w: own)
    cut = let(item_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), hits(w).alias("rows")))
    md5 = F.md5(F.coalesce("text", F.lit(""))).alias("_m")
    rows = docs.withColumn("bitmap", bitmap) if sizes else docs
    rows = rows.select("_id", md5, cut.alias("c")).select("_id", "_m", F.col("c.n_words").alias("n_words"), F.explode("c.rows").alias("r")).select("_id", "_m", "n_words", "r.*")
    if anchors is not None:
        key = lambda h, at: F.struct(F.col(h).alias("h"), at.alias("at"))
        a = anchors.select(key("h", F.lit(True)).alias("k"), "off", "text", "n", F.col("items").alias("a_items"))
        rows = rows.withColumns({"k": key("h", F.col("pos") >= 0), "spread": F.xxhash64("_id", "_m", "pos")})
        if few:
            rows = rows.join(F.broadcast(a), "k", "left")
        else:  # a passage may be anywhere: positions of a hot prefix are dealt to several tasks
            rows = join_spread(materialize(rows, "leak-positions"), a, "k", "spread", -1, "left")
        start = F.col("pos") - F.col("off")
        inside = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
        same = F.array_join(F.slice("ctx", F.greatest(start - F.col("from") + 1, F.lit(1)), F.col("n")), " ") == F.col("text")
        rows = rows.withColumn("ok", F.coalesce((F.col("pos") >= 0) & inside & same, F.lit(False))).filter("pos < 0 OR ok")
        rows = rows.select("_id", "_m", "n_words", "pos", F.when(F.col("ok"), F.struct(start.alias("s"), (start + F.col("n")).alias("e"))).alias("span"), F.when(F.col("ok"), F.col("a_items")).alias("its"))
    else:
        rows = rows.select("_id", "_m", "n_words", "pos", F.lit(None).cast("struct<s:int,e:int>").alias("span"), F.lit(None).cast("array<string>").alias("its"))
    found = rows.groupBy("_id", "_m").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(F.col("pos") < 0).alias("copies"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("its")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("edge")),
        lambda a, x: F.struct((a.hit + F.greatest(x.e - F.greatest(x.s, a.edge), F.lit(0))).alias("hit"), F.greatest(a.edge, x.e).alias("edge")),
        lambda a: a.hit,
    )
    found = found.withColumns({"n_hit": covered, "_copy": F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))})
    return found.select(
        F.col("_id").alias(id_col),
        "_m",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "items",
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a window of an item; columns as before, whatever their names. Edge cases as in
    find_leaks."""
    own = own_prefix(docs)
    bad = find_leaks(docs, items, id_col, text_col, window=window).filter("contaminated").select(F.col(id_col).alias(f"{own}id"), F.col("_m").alias(f"{own}m")).distinct()
    same = F.col(id_col).eqNullSafe(F.col(f"{own}id")) & (F.md5(F.coalesce(F.col(text_col), F.lit(""))) == F.col(f"{own}m"))
    return docs.join(bad, same, "left_anti")


#: The same in DuckDB: all windows of the documents, joined with those of the items.
LEAKS_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS n FROM p),
k AS (SELECT DISTINCT n FROM v),
q AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN k ON len(w) >= n),
x AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM q),
h AS (SELECT r, s, x.n AS n, item FROM x JOIN v ON x.win = v.win AND x.n = v.n),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS its FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
