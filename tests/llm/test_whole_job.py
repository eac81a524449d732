"""Operators do their whole job on small tables as on large ones."""

import duckdb
import numpy as np
from conftest import SMALL

from candlewright.llm import html_template, quality_classifier, registry


def labelled(sf):
    d = f"/root/testdata/{sf}"
    rows = duckdb.sql(f"SELECT text, quality, toxic FROM '{d}/documents.parquet' JOIN '{d}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    return [quality_classifier.features(t) for t, _, _ in rows], np.array([0 if q == 0 else 1 if t else 2 for _, q, t in rows])


def test_few_labels_still_separate_grades(spark, duck):
    kept = {r.doc_id for r in registry.QUERIES["op2_quality_classifier"](spark, SMALL).filter("kept").collect()}
    grades = {i: 0 if q == 0 else 1 if t else 2 for i, q, t in duck.sql("SELECT doc_id, quality, toxic FROM labels").fetchall()}
    share = lambda *g: np.mean([i in kept for i, x in grades.items() if x in g])
    assert share(2) > 0.9 and share(0, 1) < 0.1


def test_held_out_rows_of_lower_grades_are_dropped():
    for sf, poor, toxic, good in (("sf0.01", 0.1, 0.5, 0.95), ("sf0.1", 0.02, 0.25, 0.98)):
        x, y = labelled(sf)
        fold, kept = np.random.default_rng(0).permutation(len(x)) % 4, np.zeros(len(x), bool)
        for f in range(4):
            own, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            model = quality_classifier.fit([x[i] for i in own], y[own])
            kept[out] = model.predict([x[i] for i in out])[1] >= min(quality_classifier.LEAST_TAIL, (1 - quality_classifier.SLACK) * model.base)
        got = [kept[y == g].mean() for g in range(3)]
        assert got[0] < poor and got[1] < toxic and got[2] > good, (sf, got)


def test_every_stage_of_the_pipeline_keeps_and_drops_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), f"whole-{name}")
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0, sizes


def test_the_template_decides_within_articles(spark):
    row = lambda i: (i, f"http://h.org/{i}", f"<body><article><p>Share this story</p><p>Story {i} is long</p></article><article><p>Second part {i}</p><p>Reprints on request</p></article></body>")
    pages = spark.createDataFrame([row(i) for i in range(6)], "page_id int, url string, html string")
    assert {r.page_id: r.text for r in html_template.extract(pages).collect()} == {i: f"Story {i} is long Second part {i}" for i in range(6)}


def test_a_bare_less_than_sign_swallows_no_text():
    text = lambda page: html_template.main_text(html_template.parse(page), {})
    assert text("<script>for(i=0;i<n;i++){f(i)}</script><article><p>One</p></article><script>g()</SCRIPT ><p>Two") == "One"
    assert text("<style>a<b{}</style><p>if x<y always</p><p>then <a@b.org> a<b> c</p>") == "if x<y always then <a@b.org> a c"
    assert text("<p>One</p><p title='a<b>c' class=it's>Two</p><script>lost") == "One Two"


def test_the_template_decides_on_the_table(spark, monkeypatch):
    """Without the template, other text comes out: what a site repeats on its pages, within the article too."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    share = "<p>Please share this with your friends</p></article>"
    pages = pages.withColumn("html", F.regexp_replace("html", "</article>", share))
    got = {r.page_id: r.text for r in html_template.extract(pages).collect()}
    bare = {r.page_id: html_template.main_text(html_template.parse(r.html), {}) for r in pages.collect()}
    hosts = {r.page_id: r.host for r in pages.select("page_id", html_template.host_of(F.col("url")).alias("host")).collect()}
    large = [h for h in set(hosts.values()) if sum(x == h for x in hosts.values()) >= 5]
    checked = [i for i in got if hosts[i] in large and bare[i].endswith("with your friends")]
    assert checked and all(not got[i].endswith("with your friends") and got[i] != bare[i] for i in checked)
