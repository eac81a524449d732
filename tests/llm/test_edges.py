"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import collections

import pytest
from pyspark.sql import functions as F

from candlewright.llm import decontamination, html_template, line_dedup, minmax_dedup, mixing, quality_classifier, quality_rules, sharding, token_codes, url_filters
from candlewright.llm.common import host_of
from candlewright.llm.registry import default_tokenizer

LONG = " ".join(f"Wort{i % 997}" for i in range(30_000))
DOCS = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "null id text", "de", "b"), (4, LONG, "de", "b"), (5, " \n\t ", "fr", "b"), (6, "ONE two three four five six", "en", None)]


CLASHES = ("rank", "Shard", "n_words", "kept", "id", "a", "size", "copies", "fp", "_h", "_g", "_bytes", "_size", "_w", "_words", "_r", "_c", "_ref", "_null", "_src", "_bad_id", "__h", "_rank", "odd.name", "g", "h", "null", "words")


def untouched(df, *replaced):
    """Whether the user's columns are still there, with their values."""
    mine = [c for c in CLASHES if c.lower() not in replaced]
    assert [c for c in df.columns if c in mine] == mine and len({c.lower() for c in df.columns}) == len(df.columns)
    assert df.filter(" OR ".join(f"`{c}` <> 'own {c}'" for c in mine)).count() == 0


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    # names that operators use or return
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def rows(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_shards(docs):
    out = sharding.assign_shards(docs)
    assert {c.lower() for c in out.columns} == {c.lower() for c in docs.columns} and out.count() == len(DOCS)
    untouched(out, "shard")
    assert sharding.assign_shards(docs.limit(0)).count() == 0 == sharding.shard_manifest(docs.limit(0)).count()
    m = sharding.shard_manifest(docs).toPandas()
    assert len(m) == len(DOCS) and sorted(m["size"])[0] == 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in m.groupby("shard"))


def test_one_group_of_half_the_rows_is_cut(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    sums = sharding.shard_manifest(df).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.sum("n_tokens").alias("t")).toPandas()
    for c in ("b", "n", "t"):
        assert sums[c].max() - sums[c].min() < 0.03 * sums[c].mean()


def test_mixing(spark, docs):
    n_words = F.size(mixing.words(F.col("text")))
    untouched(mixing.mix(docs, n_words), "size", "copies")
    untouched(mixing.mixed(docs))
    out = mixing.mix(docs, n_words).toPandas()
    assert len(out) == len(DOCS) and out["copies"].between(0, 3).all()
    got = out.drop_duplicates(["source"]).set_index("source")["target"].to_dict()
    assert sum(v for v in got.values()) == pytest.approx(30_000 + 12 + 3 + 6)
    assert mixing.mix(docs.limit(0), F.lit(1)).count() == 0 == mixing.mixed(docs.limit(0)).count()
    assert mixing.mixed(docs).columns == docs.columns


def test_targets_share_the_excess(spark):
    s = spark.createDataFrame([(0, "a", 10), (0, "b", 1000), (0, "c", 1000), (1, "", 5)], "null int, src string, source_size long")
    got = {(r.null, r.src): r.target for r in mixing.source_targets(s).collect()}
    # a and null stop at 3 x their size; b and c share the rest by 2 : 1
    assert got == {(0, "a"): 30.0, (1, ""): 15.0, (0, "b"): pytest.approx(1970 * 2 / 3), (0, "c"): pytest.approx(1970 / 3)}


def test_token_codes(spark, docs):
    got = token_codes.token_table(docs, default_tokenizer()).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 6] and got[3].n_tokens == 1 == got[4].n_tokens
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert token_codes.token_table(docs.limit(0), default_tokenizer()).count() == 0


def test_near_duplicates(docs):
    got = rows(minmax_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got[(1, 2, 1, True)] == 2 and got[(6, 2, 1, False)] == 1 and got[(2, 0, 2, True)] == 1 and got[(3, 0, 3, True)] == 1 and got[(None, 1, None, True)] == 1
    out = minmax_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    untouched(out)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([1, 2, 3, None, 4, 5], key=str)
    assert minmax_dedup.near_duplicates(docs.limit(0)).count() == 0 == minmax_dedup.deduplicate(docs.limit(0)).count()


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "Two, three"), (2, None), (None, "absent words here"), (3, "three FOUR"), (3, "three FOUR"), (4, " ".join(f"wort{i}" for i in range(5, 20)))], "item_id int, text string")
    got = rows(decontamination.find_leaks(docs, items), "doc_id", "n_words", "n_hit", "n_items", "contaminated")
    assert got[(1, 6, 3, 2, True)] == 2 and got[(2, 0, 0, 0, False)] == 1 and got[(6, 6, 3, 2, True)] == 1
    assert got[(4, 30_000, 15 * 30 + 15 if 30_000 % 997 >= 20 else 15 * 30, 1, True)] == 1
    kept = decontamination.decontaminate(docs, items)
    untouched(kept)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 3, None, 5], key=str)
    assert decontamination.find_leaks(docs.limit(0), items).count() == 0
    assert decontamination.find_leaks(docs, items.limit(0)).filter("contaminated").count() == 0 and decontamination.find_leaks(docs, items.limit(0)).count() == len(DOCS)


def test_quality_rules(docs):
    out = quality_rules.judge(docs)
    assert out.count() == len(DOCS) and out.filter("doc_id = 2").select("n_words", "base_failed", "kept").first() == (0, True, False)
    untouched(out, "n_words", "kept")
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 1, None), (None, 1, 1), (9, None, 1)], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(docs, labels)
    assert out.count() == len(DOCS) and out.filter("doc_id = 2").first().kept is False
    untouched(out, "kept")
    bare = quality_classifier.classify(docs, labels.limit(0))
    assert sorted(r.kept for r in bare.collect()) == [False] * 3 + [True] * 5
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0
    assert {r.doc_id: r.grade for r in quality_classifier.graded(labels).collect()} == {1: 0, 4: 2}


PAGES = [(1, "http://A.org/x", "<p>same</p><p>one</p>"), (1, "http://A.org/x", "<p>same</p><p>one</p>"), (2, None, None), (3, "no scheme", ""), (4, "ftp://a.org?q", "<p>same<p>" + "long " * 20_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id int, url string, html string").withColumns({"Host": F.lit(1), "text": F.lit(2), "listed": F.lit("l"), "path": F.lit(3), "_host": F.lit("mine"), "_template": F.lit("mine"), "_lines": F.lit("mine"), "_bad": F.lit("mine"), "_stay": F.lit("mine")})


def kept_own(df):
    assert df.filter("_host <> 'mine' OR _template <> 'mine' OR _lines <> 'mine' OR _bad <> 'mine' OR _stay <> 'mine'").count() == 0 and len({c.lower() for c in df.columns}) == len(df.columns)


def test_html(pages):
    out = html_template.extract(pages)
    kept_own(out)
    assert out.count() == len(PAGES) and out.filter("page_id = 2").first().text == "" and html_template.extract(pages.limit(0)).count() == 0


def test_lines(pages):
    drop = lambda p: line_dedup.drop_site_lines(p, line_dedup.html_lines(F.col("html")), host_of(F.col("url")), ratio=0.8, least_pages=3)
    kept_own(drop(pages))
    got = {r.page_id: (r.host, r.text[:8], r.n_lines, r.n_dropped) for r in drop(pages).collect()}
    assert got == {1: ("a.org", "one", 2, 1), 2: ("", "", 0, 0), 3: ("", "", 0, 0), 4: ("a.org", "long lon", 2, 1)}
    assert drop(pages.limit(0)).count() == 0


def test_urls(spark, pages):
    got = rows(url_filters.judge_urls(pages, url_filters.tracked_keys(pages)), "page_id", "host", "path", "rule", "verdict")
    assert got[(1, "a.org", "/x", "org/", "allow")] == 2 and got[(2, "", "", None, "allow")] == 1 and got[(4, "a.org", "", None, "allow")] == 1
    assert url_filters.judge_urls(pages.limit(0), url_filters.tracked_keys(pages.limit(0))).count() == 0
    urls = ["https://x.example.org/es/1", "https://example.org/en/19", "http://notexample.org/es/", "http://a.com/de/?x", "http://a.com/en/?utm_source=f", "http://a.com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    assert [r.verdict for r in url_filters.judge_urls(df, url_filters.tracked_keys(df)).orderBy("page_id").collect()] == ["block", "block", "allow", "block", "block", "block"]


def test_an_id_with_several_texts_keeps_each_that_is_linked_with_nothing(spark):
    long = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, long("a")), (1, long("b")), (2, long("b")), (3, long("c")), (3, long("c") + " more"), (3, None), (3, None), (None, long("c"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = collections.Counter((r.doc_id, (r.text or "")[:2]) for r in minmax_dedup.deduplicate(df).collect())
    assert out == {(1, "a0"): 1, (1, "b0"): 1, (3, "c0"): 1, (3, ""): 2}
    assert sorted(minmax_dedup.deduplicate(df, few=-1).collect(), key=str) == sorted(minmax_dedup.deduplicate(df).collect(), key=str)


def test_stages_of_the_pipeline(spark, docs):
    import corpus_pipeline

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = ["doc_id", "text", "lang", "source", "n_chars"]
    assert labels.count()
    for name, stage in corpus_pipeline.STAGES:
        columns = [*want, "shard"] if name == "sharding" else want
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == columns and out.count() <= len(DOCS) * 3
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace as N

    from candlewright.llm.common import shared_dir

    session = N(conf=N(get=lambda *a: None, set=lambda *a: None), sparkContext=N(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session)
