"""Near-duplicate groups by min-max hashing, with every link confirmed on whole shingle sets.

Each of PERMUTATIONS hashes of a document's shingles gives two signature values, its minimum and its maximum; bands of
ROWS values from different permutations are the buckets in which candidates meet. With 30 bands of 4, two sets of
similarity 0.75 meet in no bucket with probability 1e-5.

Equal sets collapse to one representative first, so copies never meet each other. Small buckets compare all members.
In a large bucket every member is compared with the bucket's hub; members that are then still in another component are
compared with all of them that share one of their rarest shingles, the prefixes that sets of that similarity must share.
Members of one component need no more links, so the work on a group of copies stays in proportion to its size, and no
bucket is capped. Hubs and shingles of many documents are spread over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, copied, dealt, hot_keys, materialize, own_prefix, small_batches

WORD_RE = re.compile(WORD)

SHINGLE = 5
SIMILAR = 75
PERMUTATIONS, ROWS = 60, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Buckets of up to so many distinct sets compare all members.
SMALL = 8
#: Members of one token's group that a task compares with as many others.
CELL = 2_000
#: Up to so many tokens with more members than that, their grids are broadcast (about 30 bytes each).
BROADCAST_TOKENS = 200_000
LOWER_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_M = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


_SEEDS = _mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Shingler:
    """Hashes of a text's distinct shingles; words are hashed once for many texts."""

    #: Words kept.
    MOST = 200_000

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes; fewer words than the size make one shingle, no words none."""
        words = WORD_RE.findall((text or "").translate(LOWER_AZ))
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.MOST:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        size = min(self.size, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for j in range(size):
            out = _mix(out) + h[j : j + len(out)]
        return np.unique(_mix(out))


def fingerprint(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


_SIGN = _mix(_SEEDS) | np.uint64(1)


def min_max(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the hashes under each permutation; both unbiased for Jaccard similarity."""
    lo = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    hi = np.zeros(PERMUTATIONS, np.uint64)
    for a in range(0, len(hashes), 2048):
        x = (hashes[a : a + 2048, None] ^ _SEEDS) * _SIGN
        x ^= x >> np.uint64(29)
        x *= _SIGN
        lo, hi = np.minimum(lo, x.min(axis=0)), np.maximum(hi, x.max(axis=0))
    return lo, hi


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: half of its values are minima, half maxima, all of different permutations."""
    lo, hi = min_max(hashes)
    half = ROWS // 2
    hi = np.roll(hi, PERMUTATIONS // 2).reshape(BANDS, half)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in (lo.reshape(BANDS, half), hi):
        for j in range(half):
            key = _mix(key) + part[:, j]
    return _mix(key).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the text), n (shingles), fp (128-bit fingerprint of the whole set; null if empty) and band keys of
    every whole text."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in small_batches(batches, "t"):
            n, fp, bands = [], [], []
            for text in batch.column("t"):
                h = shingle(text.as_py())  # one set at a time
                n.append(len(h))
                fp.append(fingerprint(h) if len(h) else None)
                bands.append(band_keys(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, schema.field("bands").type)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(sign, "id bigint, th bigint, n bigint, fp binary, bands array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, few: int = 200_000) -> DataFrame:
    """(fp, set) of the representatives in nodes (fp, rep), from their whole texts."""
    schema = pa.schema([("fp", pa.binary()), ("set", pa.list_(pa.int64()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in small_batches(batches, "t"):
            sets = [shingle(text.as_py()) for text in batch.column("t")]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(h) for h in sets], pa.binary()), pa.array([h.view(np.int64) for h in sets], schema.field("set").type)], schema=schema)

    wanted = nodes.select(F.col("rep.id").alias("want"), F.col("rep.th").alias("want_th")).distinct()
    wanted = F.broadcast(wanted) if wanted.limit(few + 1).count() <= few else wanted
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("t"))
    rows = rows.join(wanted, F.col("id").eqNullSafe(F.col("want")) & (F.col("th") == F.col("want_th")), "left_semi")
    # rows that are equal give equal sets
    return rows.select("t").mapInArrow(make, "fp binary, set array<bigint>").dropDuplicates(["fp"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. A hub's pairs are dealt to many tasks, its set to each."""
    hot_a, hot_b = hot_keys(pairs, "a"), hot_keys(pairs, "b")
    pairs = dealt(dealt(pairs, hot_a, "a", "b", "at_a"), hot_b, "b", "a", "at_b")
    a, b = sets.select(F.col("fp").alias("a"), F.col("set").alias("sa")), sets.select(F.col("fp").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(copied(a, hot_a, "a", "at_a"), ["a", "at_a"]).join(copied(b, hot_b, "b", "at_b"), ["b", "at_b"])
    common = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("o", common).filter(100 * F.col("o") >= SIMILAR * (F.size("sa") + F.size("sb") - F.col("o"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for every node of the edges (a, b); comp is the same for all nodes of a component.

    Each round every node joins its smallest neighbour and the graph between the joined nodes remains. Node keys are
    hashes, so a round leaves a fraction of the nodes whatever the graph's shape.
    """
    left = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels = None
    while True:
        near = left.union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
        hop = materialize(near.select(F.col("a").alias("v"), F.least("a", "m").alias("m")), "hops")
        if labels is None:
            labels = hop.select("v", F.col("m").alias("comp"))
        else:
            labels = labels.join(hop.select(F.col("v").alias("comp"), "m"), "comp", "left").select("v", F.coalesce("m", "comp").alias("comp"))
        labels = materialize(labels, "labels")
        a, b = hop.select(F.col("v").alias("a"), F.col("m").alias("ma")), hop.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        moved = left.join(a, "a").join(b, "b").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).filter("a <> b").distinct()
        left = materialize(moved, "edges")
        if left.isEmpty():
            return labels


def _small_pairs(members: DataFrame) -> DataFrame:
    """All pairs of buckets with up to SMALL members."""
    listed = members.filter(F.col("c") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("fp", "n"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.lit(SMALL)), lambda y: F.struct(x.fp.alias("a"), y.fp.alias("b"), x.n.alias("na"), y.n.alias("nb")))))
    return listed.select(F.explode(pairs).alias("p")).select("p.*")


def _star_pairs(large: DataFrame) -> DataFrame:
    """Every member of a large bucket with the bucket's hub: the member that meets the most others in all its buckets."""
    met = large.groupBy("fp").agg(F.sum("c").alias("met"))
    hubs = materialize(large.join(met, "fp").groupBy("key").agg(F.max_by(F.struct("fp", "n"), F.struct("met", "fp")).alias("hub")), "hubs")
    pairs = large.join(hubs, "key").filter(F.col("fp") != F.col("hub.fp"))
    return pairs.select(F.col("fp").alias("a"), F.col("hub.fp").alias("b"), F.col("n").alias("na"), F.col("hub.n").alias("nb"))


def _rest_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of nodes (fp, comp) in different components that can still be similar: exact prefix and position bounds.

    With tokens in order of rarity, let x be a set and y one that is no larger. If they are similar, the first token that
    they share is one of the first n - ceil(0.75 n) + 1 of x and one of the first m - ceil(6/7 m) + 1 of y, and from there
    enough must be left: 1 + min(n - i, m - j) >= 3/7 (n + m). So texts that share a passage but hold as much of their own
    never meet in it. In each token's group, members of the largest component are not compared with each other, being
    linked already; a large group is dealt to a grid of tasks, each of which compares some of its members with some others.
    """
    rows = materialize(nodes.join(sets, "fp").select("fp", "comp", F.size("set").alias("n"), "set"), "rest")
    df = rows.select(F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    tokens = rows.select("fp", F.explode("set").alias("h")).join(df, "h").groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    ordered = rows.select("fp", "comp", "n").join(tokens, "fp")
    # tokens of no other set come first; they fill the positions before those in s
    alone = F.col("n") - F.size("s")
    long = F.col("n") - F.ceil(F.col("n") * SIMILAR / 100).cast("int") + 1
    short = F.col("n") - F.ceil(F.col("n") * 2 * SIMILAR / (100 + SIMILAR)).cast("int") + 1
    ordered = ordered.withColumns({"alone": alone, "short": short, "s": F.slice("s", F.lit(1), F.greatest(long - alone, F.lit(0)))})
    p = ordered.select("fp", "comp", "n", "alone", "short", F.posexplode("s").alias("k", "t"))
    p = p.select("fp", "comp", "n", (F.col("k") + F.col("alone") + 1).alias("i"), F.col("t.h").alias("h"), (F.col("k") + F.col("alone") < F.col("short")).alias("short"))
    p = materialize(p, "prefixes")
    by_comp = p.groupBy("h", "comp").agg(F.count("*").alias("k"))
    top = by_comp.groupBy("h").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("k").alias("k"), F.max("k").alias("in_top")).filter("comps > 1")
    cells = lambda n: F.ceil(n / F.lit(CELL)).cast("int")
    top = materialize(top.select("h", "top", cells(F.col("k") - F.col("in_top")).alias("rows"), cells(F.col("k")).alias("columns")), "tokens")
    shared = materialize(p.join(top.select("h", "top"), "h"), "shared-prefixes")
    grid = top.filter("columns > 1").drop("top")  # each has more than CELL members
    few = grid.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    shared = shared.join(F.broadcast(grid) if few else grid, "h", "left").withColumns({"rows": F.coalesce("rows", F.lit(1)), "columns": F.coalesce("columns", F.lit(1))})
    one = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "fp"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c: (F.col("fp").alias(c), F.col("comp").alias(f"c{c}"), F.col("n").alias(f"n{c}"), F.col("i").alias(f"i{c}"), F.col("short").alias(f"s{c}"))
    a = shared.filter("comp <> top").select("h", "top", one(1, "rows").alias("row"), each("columns").alias("column"), *own("a"))
    b = shared.select("h", each("rows").alias("row"), one(2, "columns").alias("column"), *own("b"))
    once = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("top")) | (F.col("a") < F.col("b")))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    early = (smaller & F.col("sa")) | (~smaller & F.col("sb"))
    close = 100 * F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb")
    enough = (1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))) * (100 + SIMILAR) >= SIMILAR * (F.col("na") + F.col("nb"))
    return a.join(b, ["h", "row", "column"]).filter(once & early & close & enough).select("a", "b", "na", "nb")


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    close = 100 * F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb")
    return pairs.filter(close & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows, (fp, component_id, rep) of every distinct set): rep is the row of the component that stays."""
    t = materialize(signatures(docs, id_col, text_col), "signatures")
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
    classes = materialize(t.filter("n > 0").groupBy("fp").agg(F.min("id").alias("id"), F.min(row).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    placed = classes.select("fp", "n", F.explode("bands").alias("key"))
    # what is counted by key is written before it is joined, so that Spark can split the tasks of large buckets
    shared = materialize(placed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "buckets")
    members = materialize(placed.join(shared, "key"), "members")
    large = members.filter(F.col("c") > SMALL)
    pairs = materialize(_distinct_pairs(_small_pairs(members).union(_star_pairs(large))), "pairs")
    ids = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).union(large.select("fp")).distinct()
    sets = materialize(_sets(docs, classes.select("fp", "rep").join(ids, "fp"), id_col, text_col), "sets")
    edges = materialize(_verified(pairs, sets), "links")
    labels = components(edges)
    named = large.select("key", "fp").join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    named = materialize(named, "named")
    open_keys = materialize(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key"), "open-buckets")
    rest = materialize(named.join(open_keys, "key", "left_semi").select("fp", "comp").distinct(), "open")
    if not rest.isEmpty():
        more = materialize(_verified(materialize(_distinct_pairs(_rest_pairs(rest, sets)), "pairs"), sets), "links")
        if not more.isEmpty():
            labels = components(edges.union(more))
    classes = classes.select("fp", "id", "rep").join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    classes = materialize(classes, "classes")
    least = classes.groupBy("comp").agg(F.min("id").alias("component_id"), F.min("rep").alias("rep"))
    return t, classes.select("fp", "comp").join(least, "comp").select("fp", "component_id", "rep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id, n_shingles, component_id, kept.

    Two texts are linked if their sets of 5-word shingles (A-Z lower-cased) have a Jaccard similarity of 0.75 or more; a
    component's id is its smallest document id, and that document is kept. Texts with fewer than five words have one
    shingle, texts without words (null, empty) none and no links; very long texts are compared whole, one at a time. Equal
    rows get equal results, and where an id comes with several texts, each of its rows is linked by its own; a null id gets
    the component's smallest id (null if there is none) and kept = false unless its text has no words or no other id. An
    empty table gives an empty result. Columns other than id and text are not read, whatever their names.
    """
    t, found = _labelled(docs, id_col, text_col)
    out = t.select("id", "n", "fp").join(found.select("fp", "component_id"), "fp", "left")
    comp = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = 500_000) -> DataFrame:
    """docs with one row of each component, that with the smallest id (of several texts of that id the one with the smallest
    hash; a null id only where the component has no other); columns as before.

    Texts without words all stay, as they are linked with nothing. Of rows equal in id and text, one stays.
    """
    t, found = _labelled(docs, id_col, text_col)
    rows = t.filter("n > 0").groupBy("id", "th", "fp").agg(F.count("*").alias("rows")).join(found, "fp")
    rows = materialize(rows.select("id", "th", "rows", (F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("th") == F.col("rep.th"))).alias("stays")), "kept")
    own = own_prefix(docs)
    keyed = docs.withColumns({f"{own}id": F.col(id_col).cast("long"), f"{own}th": F.xxhash64(text_col)})

    def same(some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col("id").alias(f"{own}a"), F.col("th").alias(f"{own}b"))
        some = F.broadcast(some) if some.limit(few + 1).count() <= few else some
        return keyed.join(some, F.col(f"{own}id").eqNullSafe(F.col(f"{own}a")) & (F.col(f"{own}th") == F.col(f"{own}b")), how)

    again = rows.filter("stays AND rows > 1")
    if again.isEmpty():
        return same(rows.filter("NOT stays"), "left_anti").drop(f"{own}id", f"{own}th")
    once = same(again, "left_semi").dropDuplicates([f"{own}id", f"{own}th"])
    return same(rows.filter("NOT stays OR rows > 1"), "left_anti").union(once).drop(f"{own}id", f"{own}th")


#: The links by brute force in DuckDB: all pairs of texts that share a shingle, and what can be reached over those in limits.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
'[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM documents JOIN m ON v = doc_id LEFT
JOIN n USING (doc_id)
"""
