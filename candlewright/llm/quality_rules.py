"""Quality rules on whole texts: a few counts, and how far a text's distributions are from those of its language.

The references are the character classes and the common words of all documents of a language, counted over the whole
table. A text is compared with them by Jensen-Shannon distance (base 2, 0 to 1), each comparison only from a least length
on. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, join_spread, let, materialize, own_prefix, with_results, words

CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"\p{Nd}+", r"[#*$%&|<>]+", r"""[.,;:!?"'()-]+""")
SYMBOLS = "#*$%&|<>"
#: A word is common in a language if it makes up so much of its words: at most 500 words are.
COMMON = 0.002
#: A language's references are drawn towards those of all languages as if it had so many words of these.
PRIOR_WORDS = 2_000
#: Up to so many languages, their references are broadcast (500 words or 15 KB each at most); beyond, they are joined by
#: shuffle, large languages dealt to many tasks.
BROADCAST_LANGUAGES = 1_000
#: Up to so many common words in all languages, texts are sifted by one hash set of them.
VOCABULARY = 5_000
#: Largest squared distances, and the least code points and words from which they count.
MAX_CLASS, MAX_WORD = 0.30**2, 0.45**2
LEAST_CHARS, LEAST_WORDS = 200, 50


def _classes(solid: Column) -> Column:
    """Code points of each class in a text without white space; the last count is of all others."""
    # the classes share no character, so each is counted in what the ones before have left
    def step(left: Column, rest: tuple[str, ...], counts: tuple[Column, ...]) -> Column:
        if not rest:
            return F.array(*counts, F.length(left))
        return let(F.regexp_replace(left, rest[0], ""), lambda kept: step(kept, rest[1:], (*counts, F.length(left) - F.length(kept))))

    return step(solid, CLASSES, ())


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def language(lang: Column) -> Column:
    """The key of a language; null is one that no other has."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(ref, classes, words, shares) of each language: shares of the character classes, and its common words with theirs.

    A language with n words gets n / (n + PRIOR_WORDS) of its own shares and the rest of those of all documents, so the
    fewer words it has, the more it is judged like the mix.
    """
    lang = language(F.col(lang_col)).alias("ref")
    zero = lambda: F.lit(0).cast("bigint")
    of = range(len(CLASSES) + 1)
    sums = docs.select(lang, let(_bare(F.col(text_col)), _classes).alias("c"), F.size(words(F.col(text_col))).alias("n"))
    sums = materialize(sums.groupBy("ref").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("c")[i]) for i in of)).alias("c")), "language-sums")
    counts = docs.select(lang, F.explode(words(F.col(text_col))).alias("word")).groupBy("ref", "word").agg(F.count("*").alias("k"))
    counts = materialize(counts, "language-words")
    total = sums.agg(F.sum("n")).first()[0] or 0
    share = lambda c: F.transform(c, lambda x: x / F.greatest(F.aggregate(c, zero(), lambda a, v: a + v), F.lit(1)))
    mix = materialize(counts.groupBy("word").agg((F.sum("k") / F.lit(max(total, 1))).alias("mix")), "word-shares")
    common = [r[0] for r in mix.filter(F.col("mix") >= COMMON).select("word").collect()]  # 1 / COMMON at most
    # a word is common in a language only if its own words or all documents say so: 1000 candidates a language at most
    own = join_spread(counts, sums.select("ref", "n"), "ref", "word", BROADCAST_LANGUAGES).filter(F.col("k") >= COMMON * F.col("n"))
    fixed = F.lit(common) if common else F.array().cast("array<string>")
    pairs = own.select("ref", "word").union(sums.select("ref", F.explode(fixed).alias("word"))).distinct()
    known = pairs.join(counts, ["ref", "word"], "left").join(mix, "word").join(sums.select("ref", "n"), "ref")
    weight = F.col("n") / (F.col("n") + PRIOR_WORDS)
    q = weight * F.coalesce("k", zero()) / F.greatest("n", F.lit(1)) + (1 - weight) * F.col("mix")
    listed = known.withColumn("q", q).filter(F.col("q") >= COMMON).groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("word", "q"))).alias("w"))
    every = sums.agg(*(F.sum(F.col("c")[i]) for i in of)).first()
    every = F.lit([float(x or 0) / max(sum(y or 0 for y in every), 1) for x in every])
    drawn = F.zip_with(share(F.col("c")), every, lambda a, b: weight * a + (1 - weight) * b)
    none = F.array().cast("array<struct<word:string,q:double>>")
    rows = sums.select("ref", drawn.alias("classes")).join(listed, "ref", "left").withColumn("w", F.coalesce("w", none))
    return materialize(rows.select("ref", "classes", F.col("w.word").alias("words"), F.col("w.q").alias("shares")), "references")


def _half(p: Column, q: Column) -> Column:
    """What a bin with shares p and q adds to the squared distance."""
    one = lambda a: F.when(a > 0, a * F.log2(2 * a / (p + q))).otherwise(F.lit(0.0))
    return (one(p) + one(q)) / 2


def class_divergence(counts: Column, n: Column, shares: Column) -> Column:
    """Squared Jensen-Shannon distance between class counts (of n code points) and a reference's shares."""
    return F.aggregate(F.zip_with(counts, shares, lambda c, q: _half(c / F.greatest(n, F.lit(1)), q)), F.lit(0.0), lambda a, x: a + x)


def word_divergence(w: Column, ref_words: Column, shares: Column, vocabulary: list[str] | None = None) -> Column:
    """The same for the words w: one bin for each common word, one for all others.

    vocabulary: words of all references, to sift w by a hash set first; without it each word is looked up in ref_words.
    Counting by removal was measured against sorting the sifted words and counting runs: it is faster for references of some
    40 words, as prose has.
    """
    n = F.greatest(F.size(w), F.lit(1))
    found = let(
        F.filter(w, lambda x: x.isin(vocabulary) if vocabulary else F.array_contains(ref_words, x)),
        lambda common: F.transform(ref_words, lambda r: (F.size(common) - F.size(F.array_remove(common, r))) / n),
    )
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rest = lambda a: F.greatest(1 - total(a), F.lit(0.0))
    return let(found, lambda p: total(F.zip_with(p, shares, _half)) + let(rest(p), lambda a: let(rest(shares), lambda b: _half(a, b))))


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more."""
    grams = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def covered(g: Column) -> Column:
        # windows sorted by hash: those next to an equal one repeat; their positions, in order, are summed up as intervals
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda x, y: F.coalesce(x.h == y.h, F.lit(False))
        repeated = let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))), lambda x: x.i)))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("edge"))
        return F.aggregate(repeated, start, lambda a, i: F.struct((a.n + i + 3 - F.greatest(i, a.edge)).alias("n"), (i + 3).alias("edge")), lambda a: a.n)

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(covered(g)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    Null texts have no words and fail; a null language is a language by itself, apart from the empty one too. Very long texts are counted whole. Equal
    rows get equal results and ids are not read. An empty table gives an empty result. Columns of these names, in whatever
    case, are replaced; all others stay, whatever their names. Ties do not arise.
    """
    refs = references(docs, text_col, lang_col)
    listed = [r[0] for r in refs.select(F.explode("words")).distinct().limit(VOCABULARY + 1).collect()]
    vocabulary = sorted(listed) if len(listed) <= VOCABULARY else None
    own = own_prefix(docs)
    lang, spread, own_classes, own_words, own_shares, w, c = (f"{own}{x}" for x in ("lang", "spread", "classes", "words", "shares", "w", "c"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    refs = refs.select(F.col("ref").alias(lang), F.col("classes").alias(own_classes), F.col("words").alias(own_words), F.col("shares").alias(own_shares))
    rows = docs.withColumns({lang: language(F.col(lang_col)), spread: F.xxhash64(F.col(id_col), F.col(text_col))})
    rows = join_spread(rows, refs, lang, spread, BROADCAST_LANGUAGES, "left")
    by_words = let(
        words(text),
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n"),
            repeat_words(x).alias("repeat"),
            F.when(F.size(x) >= LEAST_WORDS, word_divergence(x, F.col(own_words), F.col(own_shares), vocabulary)).otherwise(F.lit(0.0)).alias("far"),
        ),
    )
    by_chars = let(
        _bare(text),
        lambda s: F.struct(
            F.length(s).cast("bigint").alias("n"),
            F.when(F.length(s) >= LEAST_CHARS, class_divergence(_classes(s), F.length(s), F.col(own_classes))).otherwise(F.lit(0.0)).alias("far"),
        ),
    )
    dup_lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    rows = rows.withColumns({w: by_words, c: by_chars})
    failed = (F.col(f"{w}.n") < 50) | (100 * F.col(f"{w}.repeat") > 50 * F.col(f"{w}.n"))
    near = (F.col(f"{w}.far") <= MAX_WORD) & (F.col(f"{c}.far") <= MAX_CLASS)
    results = {"n_words": F.col(f"{w}.n"), "word_chars": F.col(f"{c}.n"), "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"), "n_dup_lines": dup_lines.cast("bigint")}
    return with_results(rows, own, results | {"n_repeat_words": F.col(f"{w}.repeat"), "base_failed": failed, "kept": ~failed & near})


#: The same in DuckDB.
RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS lg, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS s FROM d),
b AS (SELECT r, doc_id, lg, t, w, len(w) AS n, length(s) AS m,
        length(s) - length(regexp_replace(s, '\p{Ll}+', '', 'g')) AS c0, length(s) - length(regexp_replace(s, '\p{Lu}+', '', 'g')) AS c1,
        length(s) - length(regexp_replace(s, '\p{Nd}+', '', 'g')) AS c2, length(s) - length(regexp_replace(s, '[#*$%&|<>]+', '', 'g')) AS c3,
        length(s) - length(regexp_replace(s, '[.,;:!?"''()-]+', '', 'g')) AS c4 FROM w),
cl AS (SELECT *, unnest([c0, c1, c2, c3, c4, m - c0 - c1 - c2 - c3 - c4]) AS c, unnest(range(6)) AS k FROM b),
tot AS (SELECT lg, sum(n) AS n FROM b GROUP BY lg),
ca AS (SELECT k, sum(c) / greatest(sum(sum(c)) OVER (), 1) AS q FROM cl GROUP BY k),
co AS (SELECT lg, k, sum(c) / greatest(sum(sum(c)) OVER (PARTITION BY lg), 1) AS q FROM cl GROUP BY lg, k),
rc AS (SELECT lg, k, n / (n + 2000) * co.q + (1 - n / (n + 2000)) * ca.q AS q FROM co JOIN ca USING (k) JOIN tot USING (lg)),
wd AS (SELECT r, lg, unnest(w) AS word FROM b),
wk AS (SELECT lg, word, count(*) AS k FROM wd GROUP BY lg, word),
wm AS (SELECT word, sum(k) / (SELECT greatest(sum(n), 1) FROM tot) AS m FROM wk GROUP BY word),
rw AS (SELECT lg, word, n / (n + 2000) * coalesce(k, 0) / greatest(n, 1) + (1 - n / (n + 2000)) * m AS q
       FROM (SELECT lg, word, n, m FROM tot, wm) LEFT JOIN wk USING (lg, word) WHERE q >= 0.002),
x AS (SELECT r, n, m, lg AS ref FROM b),
cd AS (SELECT x.r, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)
AS far
       FROM (SELECT r, k, c / greatest(m, 1) AS p FROM cl) y JOIN x USING (r) JOIN rc ON rc.lg = x.ref AND rc.k = y.k GROUP BY x.r),
wc AS (SELECT r, word, count(*) AS k FROM wd GROUP BY r, word),
wb AS (SELECT x.r, rw.word, coalesce(wc.k, 0) / greatest(x.n, 1) AS p, q FROM x JOIN rw ON rw.lg = x.ref LEFT
JOIN wc ON wc.r = x.r AND wc.word = rw.word),
wa AS (SELECT r, p, q FROM wb UNION ALL SELECT r, greatest(1 - sum(p), 0), greatest(1 - sum(q), 0) FROM wb GROUP BY r),
ws AS (SELECT r, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS
far FROM wa GROUP BY r),
g AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, n - 1)) AS i FROM b)),
rep AS (SELECT r, count(DISTINCT pos) AS k FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k
FROM g) WHERE k > 1) GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT line) AS k FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM b)
WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
o AS (SELECT b.*, coalesce(rep.k, 0) AS n_rep, coalesce(ln.k, 0) AS n_dup, coalesce(cd.far, 0) AS cfar, coalesce(ws.far, 0) AS wfar
      FROM b LEFT JOIN rep USING (r) LEFT JOIN ln USING (r) LEFT JOIN cd USING (r) LEFT JOIN ws USING (r))
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, n_dup::BIGINT
AS n_dup_lines,
       n_rep::BIGINT AS n_repeat_words, (n < 50 OR 100 * n_rep > 50 * n) AS base_failed,
       NOT (n < 50 OR 100 * n_rep > 50 * n) AND (m < 200 OR cfar <= 0.3 * 0.3) AND (n < 50 OR wfar <= 0.45 * 0.45) AS kept
FROM o
"""
