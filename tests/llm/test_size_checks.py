"""Beyond every size check, the other way gives the same rows."""

from conftest import SMALL
from pyspark.sql import functions as F

from candlewright.llm import common, decontamination, html_template, line_dedup, minmax_dedup, mixing, quality_rules


def same(a, b):
    a, b = a.toPandas(), b.toPandas()
    key = lambda d: sorted(map(repr, d.astype(str).itertuples(index=False, name=None)))
    assert len(a) and key(a) == key(b)


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def test_decontamination(spark, monkeypatch):
    find = lambda: decontamination.find_leaks(table(spark, "documents").limit(60), table(spark, "benchmark")).drop("items")
    want = find()
    assert want.filter("contaminated").count() > 0
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontamination._bitmap, "__defaults__", (1024,))  # many positions pass by chance
    same(want, find())


def test_many_prefix_tokens_are_sifted_before_they_become_rows(spark):
    words = [f"w{i}" for i in range(21_010)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(f"v{i}" for i in range(50_000))), (3, " ".join(words[7:40]))], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(words))], "item_id string, text string")
    anchors = decontamination._anchors(docs, decontamination.item_windows(items), "text", [3])
    assert anchors.select("h").distinct().count() > 20_000
    leaks = decontamination.find_leaks(docs, items)
    assert {r.doc_id: (r.n_words, r.n_hit) for r in leaks.collect()} == {1: (21_010, 21_010), 2: (50_000, 0), 3: (33, 33)}
    bitmap, test = decontamination._bitmap(anchors.select("h").distinct())
    positions = docs.withColumn("bitmap", bitmap).select("doc_id", decontamination.let(decontamination.item_words(F.col("text")), lambda w: F.size(F.filter(decontamination._shingles(w, 3), lambda h: decontamination.let(F.col("bitmap"), lambda m: test(m, h))))).alias("n"))
    got = {r.doc_id: r.n for r in positions.collect()}
    assert got[1] >= 20_000 and got[2] < 50_000 * 0.06  # of positions without a token, few become rows


def test_quality_rules(spark, monkeypatch):
    docs = table(spark, "documents")
    want = quality_rules.judge(docs)
    monkeypatch.setattr(quality_rules, "VOCABULARY", 0)
    monkeypatch.setattr(quality_rules, "BROADCAST_LANGUAGES", 0)
    monkeypatch.setattr(common, "LEAST_HOT", 1)
    same(want.drop("text"), quality_rules.judge(docs).drop("text"))


def test_a_small_language_is_judged_alike_whatever_else_there_is(spark):
    docs = table(spark, "documents").select("doc_id", "text", "lang")
    more = docs.filter("lang <> 'fr' OR lang IS NULL")
    many = docs.unionByName(more).unionByName(more).unionByName(more)
    monkey = lambda d: d.filter("lang = 'fr'").distinct().drop("text")
    same(monkey(quality_rules.judge(docs)), monkey(quality_rules.judge(many)))


def test_near_duplicates(spark, monkeypatch):
    docs = table(spark, "documents")
    want = minmax_dedup.near_duplicates(docs)
    # every bucket counts as large, and sets are joined by shuffle
    monkeypatch.setattr(minmax_dedup, "SMALL", 1)
    monkeypatch.setattr(minmax_dedup._sets, "__defaults__", (0,))
    monkeypatch.setattr(minmax_dedup, "CELL", 2)
    monkeypatch.setattr(minmax_dedup, "BROADCAST_TOKENS", 0)
    monkeypatch.setattr(common, "LEAST_HOT", 0)
    same(want, minmax_dedup.near_duplicates(docs))


def test_pages(spark, monkeypatch):
    pages = table(spark, "pages")
    lines = lambda: line_dedup.drop_site_lines(pages, line_dedup.html_lines(F.col("html")), F.lit("one"), ratio=0.01).drop("html")
    a, b = lines(), html_template.extract(pages).drop("html")
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    monkeypatch.setattr(html_template, "BROADCAST_TOKENS", -1)
    monkeypatch.setattr(line_dedup, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(html_template, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(common, "LEAST_HOT", 0)
    same(a, lines())
    same(b, html_template.extract(pages).drop("html"))


def test_mixing(spark, monkeypatch):
    docs = table(spark, "documents").withColumn("w", F.size(mixing.words(F.col("text")))).drop("text")
    want = mixing.mix(docs, F.col("w"))
    monkeypatch.setattr(mixing, "targets_are_few", lambda sizes: False)
    same(want, mixing.mix(docs, F.col("w")))
