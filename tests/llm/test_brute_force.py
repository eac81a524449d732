"""Operators that SQL cannot express, against plain restatements."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from candlewright.llm import html_template, minmax_dedup, quality_classifier, registry, sharding, token_codes, url_filters

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(sets):
    """Smallest key reachable over pairs with 100 |a & b| >= 75 |a | b|."""
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    at = collections.defaultdict(list)
    for i, s in sorted(sets.items()):
        for j, o in collections.Counter(j for g in s for j in at[g]).items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            at[g].append(i)
    return {i: root(i) for i in sets}


def check_components(rows, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    want = components(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(sets[i]), want[i], want[i] == i) for i in texts}


def test_near_duplicates_of_the_table(spark, duck):
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    check_components(registry.QUERIES["op7_minmax_dedup"](spark, SMALL).collect(), texts)


def test_near_duplicates_in_a_large_graded_group(spark):
    # copies of one text with 0 to 60 changed words: many pairs lie near the limit, buckets are large, links form chains
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(160):
        w = list(base)
        for k in rng.choice(150, rng.integers(0, 13), replace=False):
            w[k] = f"x{i}_{k}"
        texts[i] = " ".join(w)
    texts |= {200 + i: "common words of a passage that many share " * 3 + " ".join(f"y{i}_{k}" for k in range(20)) for i in range(40)}
    texts |= {300: None, 301: "", 302: "one two", 303: "One TWO", 304: "one two three"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_components(minmax_dedup.near_duplicates(df).collect(), texts)


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[1000:]
    (la, ha), (lb, hb) = minmax_dedup.min_max(a), minmax_dedup.min_max(b)
    assert abs(np.mean(np.concatenate([la == lb, ha == hb])) - 1 / 3) < 0.15


def test_token_codes_round_trip(spark, duck):
    from tokenizers import Tokenizer

    tok, start, want = Tokenizer.from_file(registry.default_tokenizer()), 0, []
    for i, text in duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = registry.QUERIES["op6_token_codes"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_cached_encoder_equals_the_library():
    model = open(registry.default_tokenizer(), encoding="utf-8").read()
    enc = token_codes.CachedEncoder(model)
    texts = ["", " a", "a ", "a  b", "x \n y", "é.\nB,c d, e.f. g.\n", "I'm. they've, 12. 3,4, x.", "a\n\nb", "a\tb", "A.. b,, c.", "a\xa0b c", "<|endoftext|> x", "日本 語, 𝒳 ñandú.", "ok\x1fgo on", "İ ß. ŉ"] * 2
    for got, e in zip(enc.encode(texts), enc.tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == e.ids


def test_cached_encoder_on_random_texts():
    model = open(registry.default_tokenizer(), encoding="utf-8").read()
    enc, rng = token_codes.CachedEncoder(model), np.random.default_rng(4)
    enc.MOST = 400  # caches are dropped on the way
    parts = list("aeztTÉß0 19 \n\n'.,;#*-_\u4e2d\u0301\x00\t\xa0") + ["'s", "'LL", " word", "\nword", "...", "\U0001f600", "<|endoftext|>", "ªº", "\u02b0"]
    for _ in range(20):
        texts = ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 25))) for _ in range(300)] + [None]
        for got, e in zip(enc.encode(texts), enc.tok.encode_batch([x or "" for x in texts], add_special_tokens=False), strict=True):
            assert got.tolist() == e.ids


@pytest.mark.parametrize("top", [1, 200, 50_000, 2**32 - 1])
def test_random_access(top):
    rng = np.random.default_rng(top % 97)
    ids = rng.integers(0, top, 3000, dtype=np.uint64).astype(np.uint32)
    seg = token_codes.Segment(token_codes.encode_segment(ids, np.array([0, 10, 10, 3000])))
    assert (seg.all_tokens() == ids).all() and (seg.document(2) == ids[10:]).all() and len(seg.document(1)) == 0
    assert [seg.token(i) for i in range(0, 3000, 37)] == ids[::37].tolist()
    with pytest.raises(IndexError):
        seg.token(3000)


def test_cascade_is_exact():
    rng = np.random.default_rng(1)
    for n, share in ((0, 0), (1, 1.0), (500, 0.0), (5000, 0.02), (5000, 0.6), (2000, 1.0)):
        h1, h2 = rng.integers(0, 2**63, (2, n), dtype=np.uint64)
        listed = rng.random(n) < share
        levels = url_filters.build_cascade(h1, h2, listed)
        assert (url_filters.is_listed(h1, h2, levels) == listed).all()


def test_both_probes_agree(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    one = url_filters.judge_urls(pages, url_filters.tracked_keys(pages))
    two = url_filters.judge_urls(pages, url_filters.tracked_keys(pages), broadcast_bytes=-1)
    assert one.exceptAll(two).count() == 0 and one.count() == two.count()


def test_classifier_on_held_out_rows(spark, duck):
    rows = duck.sql("SELECT text, quality, toxic FROM read_parquet('/root/testdata/sf0.1/documents.parquet') d JOIN read_parquet('/root/testdata/sf0.1/labels.parquet') l USING (doc_id) ORDER BY doc_id").fetchall()
    x = [quality_classifier.features(t) for t, _, _ in rows]
    y = np.array([0 if q == 0 else 1 if t else 2 for _, q, t in rows])
    half = np.arange(len(x)) % 2 == 0
    model = quality_classifier.fit([x[i] for i in np.flatnonzero(half)], y[half])
    assert model.thresholds[0] < model.thresholds[1]
    expected, tail = model.predict(x)
    keep = (tail >= quality_classifier.LEAST_TAIL)[~half]
    assert keep[y[~half] == 2].mean() > 0.95 and keep[y[~half] == 0].mean() < 0.1
    assert expected[y == 0].mean() < 0.5 < expected[y == 2].mean()


def test_main_text():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article class=post><h1>Head &amp; line</h1><p>One<br>two <b>bo</b>ld&nbsp;x<p>Three<script>var a='</p>'</script><!-- no --><form>f</form></p><div id=comments><article>reader</article></div></article><aside>side</aside><footer>foot</footer>"
    assert html_template.main_text(html_template.parse(page), {}) == "Head & line One two bold x Three"
    assert html_template.main_text(html_template.parse(None), {}) == "" == html_template.main_text(html_template.parse(""), {})


def test_template_text_of_a_site_without_articles(spark):
    row = lambda i: (i, f"http://h.org/{i}", f"<div><p>Welcome to our site</p><p>Story {i} is about {i * 7} things</p><p>All rights reserved</p></div>")
    pages = spark.createDataFrame([row(i) for i in range(6)] + [row(0), (9, "http://x.org/1", "<p>Welcome to our site</p>"), (10, None, None)], "page_id int, url string, html string")
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html_template.extract(pages).collect())
    story = lambda i: f"Story {i} is about {i * 7} things"
    want = [(i, story(i), len(story(i))) for i in [*range(6), 0]] + [(9, "Welcome to our site", 19), (10, "", 0)]
    assert got == collections.Counter(want)


def test_pages_of_the_table(spark, duck):
    import html

    want = {}
    for i, page in duck.sql("SELECT page_id, html FROM pages").fetchall():
        body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
        want[i] = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>|</?p>|</?h1>", " ", body))).split())
    assert {r.page_id: r.text for r in registry.QUERIES["op1_html_template"](spark, SMALL).collect()} == want


def test_shards(spark, duck):
    rows = registry.QUERIES["op5_shards"](spark, SMALL).toPandas()
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert sorted(rows.doc_id) == sorted(texts)
    for r in rows.itertuples():
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "bytes")
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sums = rows.groupby("shard")["size"].sum()
    assert set(sums.index) == set(range(8)) and sums.max() - sums.min() <= 0.05 * sums.mean()


def test_equal_texts_share_a_shard(spark):
    rows = registry.QUERIES["op5_shards"](spark, "/root/testdata/sf0.01").toPandas()
    groups = rows.groupby(["text_crc32", "size"])["shard"]
    assert (groups.size() > 1).sum() > 50 and groups.nunique().max() == 1
    sums = rows.groupby("shard").agg(b=("size", "sum"), t=("n_tokens", "sum"), n=("size", "size"))
    assert (sums["b"].max() - sums["b"].min()) < 0.02 * sums["b"].mean() and ((sums.max() - sums.min()) < 0.05 * sums.mean()).all()


def greedy(items, n, dims):
    """Each item, larger ones first, where it fits and its dot product with the residual capacity is highest."""
    total = [sum(x[d] for x in items) for d in range(dims)]
    left = [[1 / n] * dims for _ in range(n)]
    share = [[x[d] / total[d] for d in range(dims)] for x in items]
    out = {}
    for i in sorted(range(len(items)), key=lambda i: -max(share[i])):
        rank = lambda j, i=i: (all(a <= b + 1e-12 for a, b in zip(share[i], left[j])), share[i][0] <= left[j][0] + 1e-12, sum(a * b for a, b in zip(share[i], left[j])))  # noqa: B905, E731
        out[i] = max(range(n), key=rank)
        left[out[i]] = [b - a for a, b in zip(share[i], left[out[i]])]  # noqa: B905
    return out


def test_packing_equals_a_plain_packer():
    rng = np.random.default_rng(3)
    items = [tuple(map(float, x)) for x in rng.integers(1, 1000, (300, 3))]
    total = [sum(x[d] for x in items) for d in range(3)]
    got = sharding.pack(items, [[t / 8 for t in total] for _ in range(8)])
    assert dict(enumerate(got)) == greedy(items, 8, 3)


def test_classifier_fit_is_the_optimum_of_its_loss():
    # few rows, one strength: a plain coordinate-wise search over the same posterior finds nothing better
    rng = np.random.default_rng(8)
    x = [np.unique(rng.integers(0, 12, 4)).astype(np.int32) for _ in range(60)]
    y = np.array([min(2, int(3 in r) + int(5 in r) + int(rng.random() < 0.2)) for r in x])
    model = next(quality_classifier._models(x, y, [3.0]))
    slots = np.unique(np.concatenate(x))
    n, seen = len(x), {s: sum(s in r for r in x) for s in slots}
    z2 = {s: max((sum(s in r for r in np.array(x, object)[y == g]) - seen[s] * (y == g).mean()) ** 2 / (seen[s] * (y == g).mean() * (y != g).mean() + 1) for g in range(3)) for s in slots}
    wide = np.array([np.sqrt(quality_classifier.FLOOR + max(z2[s] - 1, 0)) for s in slots])
    share = np.clip(np.cumsum(np.bincount(y, minlength=3))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    first = np.array([start[0], np.log(max(start[1] - start[0], 1e-2))])

    def loss(weights, t0, gap):
        s = np.array([sum(weights[np.searchsorted(slots, r)]) for r in x])
        t = np.array([-np.inf, t0, t0 + np.exp(gap), np.inf])
        cdf = lambda v: 1 / (1 + np.exp(-v))
        prob = np.array([cdf(t[g + 1] - v) - cdf(t[g] - v) for g, v in zip(y, s, strict=True)])
        return 0.5 * 3.0 * ((weights / wide) ** 2).sum() + 0.005 * ((np.array([t0, gap]) - first) ** 2).sum() - np.log(prob).sum()

    at = np.concatenate([model.weights[slots].astype(float), [model.thresholds[0], np.log(model.thresholds[1] - model.thresholds[0])]])
    of = lambda p: loss(p[:-2], p[-2], p[-1])
    best = of(at)
    for i in range(len(at)):
        for h in (1e-1, 3e-2, 1e-2):
            for sign in (h, -h):
                step = at.copy()
                step[i] += sign
                assert of(step) > best - 5e-3 * abs(best) * h


def test_classes_of_a_site_equal_those_by_whole_vectors(spark, duck):
    pages = [(u, h) for u, h in duck.sql("SELECT url, html FROM pages").fetchall() if h]
    host = lambda u: re.search(r"://([^/?#]*)", u or "")[1].lower() if "://" in (u or "") else ""
    sites = collections.defaultdict(set)
    for u, h in pages:
        sites[host(u)].add(h)
    want = set()
    for site, texts in sites.items():
        vectors = collections.defaultdict(dict)
        for p in texts:
            for token, k in collections.Counter(t[0] for t in html_template.parse(p)).items():
                vectors[token][p] = k
        classes = collections.defaultdict(set)
        for token, v in vectors.items():
            if len(texts) >= html_template.LEAST_PAGES and len(v) >= max(html_template.LEAST_PAGES, html_template.FREQUENT * len(texts)):
                classes[frozenset(v.items())].add(token)
        want |= {(site, frozenset(c)) for c in classes.values() if len(c) >= html_template.LEAST_CLASS}
    got = collections.defaultdict(set)
    for r in html_template.templates(spark.read.parquet(f"{SMALL}/pages.parquet")).collect():
        got[(r.host, r["class"])].add(r.token)
    assert {(h, frozenset(c)) for (h, _), c in got.items()} == want and want


def test_parsing_takes_time_in_proportion_to_depth():
    import time

    def took(n):
        start = time.process_time()
        html_template.parse("<div>x" * n + "<b>" * n + "<hr>" * n + "</q>" * n)
        return time.process_time() - start

    took(500)
    assert took(16_000) < 20 * max(took(2_000), 0.02)


def test_pipeline_stages(spark, duck):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.materialize(stage(spark, steps[-1], SMALL), f"test-{name}"))
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in steps]
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert all(s.columns == docs.columns for s in steps[:-1]) and steps[-1].columns == [*docs.columns, "shard"]
    left = {i: shingles(texts[i]) for i in ids[1]}
    root = components(left)
    assert ids[2] == sorted(i for i in left if root[i] == i)
    leaks = {r.doc_id for r in registry.QUERIES["op10_decontamination"](spark, SMALL).filter("contaminated").collect()}
    assert ids[3] == sorted(set(ids[2]) - leaks)
    judged = {r.doc_id for r in registry.QUERIES["op2_quality_classifier"](spark, SMALL).filter("kept").collect()}
    assert ids[1] == sorted(judged) and 0 < len(judged) < len(texts)
    assert ids[5] == ids[4] == mixed_by_hand([(i, *rest) for i, *rest in duck.sql("SELECT doc_id, source, text FROM documents").fetchall() if i in set(ids[3])])
    assert steps[-1].groupBy(F.md5(F.coalesce("text", F.lit("")))).agg(F.countDistinct("shard").alias("n")).agg(F.max("n")).first()[0] == 1


def mixed_by_hand(rows):
    """Ids in the mix, each as often as it is taken: targets by filling up, copies by counting whole numbers passed."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    by = collections.defaultdict(list)
    for i, source, _ in rows:
        by[(source is None, source or "")].append(i)
    total = {k: sum(size[i] for i in v) for k, v in by.items()}
    weight = dict(zip(sorted(by), [5, 2, 1] * len(by), strict=False))
    target, left, open_ = dict.fromkeys(by, 0.0), float(sum(total.values())), set(by)
    while open_:  # sources that would pass three times their size stop there, and the others share again
        level = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if level * weight[k] > 3 * total[k]}
        if not full:
            target |= {k: level * weight[k] for k in open_}
            break
        for k in full:
            target[k] = 3.0 * total[k]
            left -= target[k]
        open_ -= full
    out = []
    for k, ids in by.items():
        at = int(hashlib.md5(f"mix:{int(k[0])}:{k[1]}".encode()).hexdigest()[:5], 16) / (1 << 20)
        each = target[k] / total[k] if total[k] else 0.0
        for rank, i in enumerate(sorted(ids, key=lambda i: (size[i], i))):
            out += [i] * (math.floor(at + (rank + 1) * each) - math.floor(at + rank * each))
    return sorted(out)
