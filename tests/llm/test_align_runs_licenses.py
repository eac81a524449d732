"""Token alignment, periodic runs and licence scans, against plain restatements and at their edges."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_edges import CLASHES, DOCS, untouched

from candlewright.llm import license_scan, perfect_hash, periodic_runs, registry, token_alignment

TEXTS = [
    "Hello world", None, "", "foo, bar.baz\nqux", "  two  spaces ", "a▁b c", "<|endoftext|> plain </s>", "tab\tx", "émigré naïve 漢字 テスト", "don't they're x_y a.b.c (foo)[bar]",
    "\n", "\n\nx", " ", "a\0b", "Hello world", "🙂 smile 🙂🙂", "don't\nx y", " nb\xa0sp", "ﬁ ligature Ａ", "<0x41> <s> ▁",
]


@pytest.fixture(scope="module")
def models():
    return token_alignment.read_models(registry.default_tokenizer(), registry.tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain(models):
    """text -> (a ids, b ids, groups, links) by the libraries on the whole text, one byte at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_str(models[0]), sentencepiece.SentencePieceProcessor(model_proto=models[1])
    a.encode_special_tokens = True
    level = token_alignment._byte_level()

    def one(text):
        none = ([], [], "", [])
        if not text:
            return none
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
        spelt = [[bytes(level[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        if any(b"".join(x) != (" " + text).encode() for x in spelt):
            return none
        owner = [[k for k, x in enumerate(side) for _ in x] for side in spelt]
        links = sorted(set(zip(*owner, strict=True)))
        ends = [set(itertools.accumulate(map(len, side))) for side in spelt]
        groups, at = [], [0, 0]
        for cut in sorted(ends[0] & ends[1]):
            upto = [owner[s][cut - 1] + 1 for s in (0, 1)]
            groups.append("|".join(",".join(map(str, ids[s][at[s] : upto[s]])) for s in (0, 1)))
            at = upto
        return (*ids, ";".join(groups), [(ids[0][i], ids[1][j]) for i, j in links])

    return one


def check_alignment(rows, texts, plain):
    """rows: (id, n_a, ..., count_sum, groups) against the restatement over all texts."""
    known = {i: plain(t) for i, t in texts.items()}
    counts = collections.Counter(p for x in known.values() for p in set(x[3]))
    most = collections.Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    for i, (a, b, groups, links) in known.items():
        n_groups = groups.count(";") + 1 if groups else 0
        assert rows[i] == (len(a), len(b), n_groups, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), groups), texts[i]


def test_alignment_of_the_table(spark, duck, plain):
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    found = registry.QUERIES["op11_token_alignment"](spark, SMALL).collect()
    digest = {i: plain(t)[2] for i, t in texts.items()}
    assert {r.doc_id: r.groups_sha256 for r in found} == {i: hashlib.sha256(g.encode()).hexdigest() if g else "" for i, g in digest.items()}
    check_alignment({r.doc_id: (*r[1:7], digest[r.doc_id]) for r in found}, texts, plain)


def test_alignment_of_odd_texts_over_passes_of_the_table(spark, models, plain, monkeypatch):
    # small limits: lists are emptied often, vectors need two levels of the tree, counts several passes
    monkeypatch.setattr(token_alignment, "LISTED_PAIRS", 40)
    monkeypatch.setattr(token_alignment, "FAN_IN", 2)
    monkeypatch.setattr(token_alignment, "HELD_PAIRS", 60)
    texts = dict(enumerate(TEXTS + ["one two three " * 50]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    out = token_alignment.align_documents(df, *models).collect()
    check_alignment({r.doc_id: tuple(r[2:]) for r in out}, texts, plain)
    counts = token_alignment.count_pairs(token_alignment.materialize(token_alignment.list_pairs(df, *models), "lists"))
    want = collections.Counter(p for t in texts.values() for p in set(plain(t)[3]))
    assert {(r.a_id, r.b_id): r.n_docs for r in token_alignment.pair_rows(counts).collect()} == dict(want)


def test_alignment_edges(spark, models):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(f"own {c}") for c in (*CLASHES, "Groups", "n_a")})
    out = token_alignment.align_documents(df, *models)
    untouched(out)
    rows = out.collect()
    assert len(rows) == len(DOCS) and sum(r.doc_id == 1 and r.n_links > 0 for r in rows) == 2
    assert all((r.n_links == 0) == (not r.text) for r in rows)
    assert token_alignment.align_documents(df.limit(0), *models).count() == 0


def test_a_cut_needs_both_vocabularies(models, plain):
    # without words, each text is aligned in one piece, with the same groups
    tool = token_alignment.Aligner(*models)
    tool.by_word = False
    got = tool.align(pa.array(TEXTS, pa.string())).results({}, True).to_pylist()
    assert [x["groups"] for x in got] == [plain(t)[2] for t in TEXTS]


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 1000, 50_000):
        keys = np.unique(rng.integers(-(2**63), 2**63, n))
        f = perfect_hash.PerfectHash.of(keys)
        assert f.n == len(keys) and sorted(f.index(keys).tolist()) == list(range(len(keys)))
        back = perfect_hash.PerfectHash.from_bytes(f.to_bytes())
        assert (back.index(keys) == f.index(keys)).all() and (f.index(rng.integers(0, 2**63, 100)) < max(len(keys), 1)).all()
    perfect_hash.LEVELS, levels = 2, perfect_hash.LEVELS  # most keys are listed
    keys = np.arange(500, dtype=np.int64)
    assert sorted(perfect_hash.PerfectHash.from_bytes(perfect_hash.PerfectHash.of(keys).to_bytes()).index(keys).tolist()) == list(range(500))
    perfect_hash.LEVELS = levels


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(w):
    return [tuple(map(int, r)) for r in periodic_runs.find_runs(np.array(w, np.int64))]


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(1500):
        n, k = rng.randint(0, 110), rng.choice([1, 2, 2, 3, 6])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            p, s, size = rng.randint(1, 20), rng.randint(0, n), rng.randint(1, 80)
            for i in range(s + p, min(n, s + size)):
                w[i] = w[i - p]
        assert runs_of(w) == plain_runs(w), w


def test_runs_of_words_with_many_runs():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    parity = [i.bit_count() % 2 for i in range(1024)]
    # the last: two stretches of one small period side by side, so that many larger periods hold over their border
    for w in (fib[-1], parity, [0] * 500, ([0] * 7 + [1]) * 40, [0, 0, 1] * 60 + [1] + [0, 0, 1] * 50, ([0, 1] * 20 + [0]) * 6, [0] * 50 + [1] + [0] * 50 + [1] + [0] * 49, [0, 1] * 15 + [0, 0] + [1, 0] * 15):
        assert runs_of(w) == plain_runs(w)
    assert runs_of([1] * 11) == [] and runs_of([1] * 12) == [(0, 12, 1)] and runs_of(list(range(6)) * 2) == [(0, 12, 6)] and runs_of(list(range(5)) * 2) == []


def test_runs_of_the_table(spark, duck):
    got = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    some = 0
    texts = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    for i, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        if n > 1500:
            continue  # the restatement is quadratic; the query ran on all
        runs = plain_runs(w)
        dropped = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(x for k, x in enumerate(w) if k not in dropped))]
        assert got[i] == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)
        some += bool(runs)
    assert some > 10 and len(got) == len(texts)


def test_runs_edges(spark):
    more = [*DOCS, (7, "a b " * 9, None, None), (8, "x " * 50_000, None, None), (9, "\x1c \x85 a\xa0b c " * 6, None, None)]
    df = spark.createDataFrame(more, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(f"own {c}") for c in (*CLASHES, "Runs", "collapsed")})
    out = periodic_runs.periodic_runs(df)
    untouched(out)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[7].runs == [(0, 18, 2)] and rows[7].collapsed == "a b" and rows[8].runs == [(0, 50_000, 1)] and rows[8].collapsed == "x"
    assert rows[2].runs == [] and rows[2].collapsed == rows[3].collapsed == rows[5].collapsed == "" and rows[6].collapsed == "ONE two three four five six"
    assert rows[9].runs == [(0, 18, 3)] and rows[4].runs == [(0, 30_000, 997)] and out.count() == len(more)
    looped = periodic_runs.periodic_runs(df.filter("doc_id = 1"), loops=lambda ids, n: (np.full(len(n), 2), np.full(len(n), 1))).collect()
    assert [r.collapsed for r in looped] == ["one two three three three three"] * 2
    assert periodic_runs.periodic_runs(df.limit(0), loops=registry.planted_loops).count() == 0


def plain_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(k, label) for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")) for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses_of_the_table(spark, duck):
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    rows = registry.QUERIES["op13_license_scan"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:6] == plain_base(texts[r.doc_id])
        # all notices of this table are one of five, each by itself
        more = {"gpl-3": "GNU General Public License, version 3", "all-rights-reserved": "all rights reserved"}
        want = set(r.base_labels.split(",")) - {""} | {x for x, phrase in more.items() if phrase.lower() in (texts[r.doc_id] or "").lower()}
        weight = {"mit": 0.1, "apache-2": 0.1, "gpl-3": 0.6, "cc-by-nc": 0.9, "all-rights-reserved": 1.0}
        assert r.labels == ",".join(sorted(want)) and r.score == max((weight[x] for x in want), default=0.0)


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("SPDX-License-Identifier: MIT", "mit", 0.1),
        ("// spdx-license-identifier: (MIT OR GPL-2.0-only) AND CC-BY-NC-4.0 */", "cc-by-nc,gpl-2,mit", 0.9),
        ("SPDX-License-Identifier: MIT AND GPL-3.0+ OR AGPL-3.0-or-later", "agpl-3,gpl-3,mit", 0.6),
        ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", "gpl-2", 0.3),
        ("SPDX-License-Identifier: MIT OR GPL-2.0 AND CC-BY-NC-4.0", "cc-by-nc,gpl-2,mit", 0.1),
        ("SPDX-License-Identifier: (MIT OR GPL-2.0) AND", "gpl-2,mit", 0.1),
        ("SPDX-License-Identifier: ((MIT OR ISC", "isc,mit", 0.1),
        ("SPDX-License-Identifier: MIT) AND GPL-2.0", "mit", 0.1),
        ("SPDX-License-Identifier: Foo-1.0", "foo-1.0", 0.5),
        ("SPDX-License-Identifier: OR MIT", "", 0.0),
        ("SPDX-License-Identifier:\nGPL-3.0", "", 0.0),
        ("SPDX license identifier of what", "", 0.0),
        ("Under the MIT License or the Apache License, Version 2.0.", "apache-2,mit", 0.1),
        ("the MIT License and the GNU General Public License version 3", "gpl-3,mit", 0.6),
        ("MIT License or GPLv3", "gpl-3,mit", 0.1),
        ("MIT License. This is not here or there. GPLv3", "gpl-3,mit", 0.6),
        ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa", 0.9),
        ("GNU Lesser General Public License, version 3; all rights reserved", "all-rights-reserved,lgpl-3", 1.0),
        ("permitted license, no notice", "", 0.0),
    ],
)
def test_expressions(text, labels, score):
    found = license_scan.scan(text)
    assert (found["labels"], found["score"]) == (labels, score)


def test_evaluation_by_trial():
    # random expressions, fully bracketed by construction, against the value that built them
    rng = random.Random(1)
    values = {f"l{i}": i / 10 for i in range(11)}

    def build(depth, least=1):
        """(tokens, value) of an expression whose weakest operator binds at least so strongly."""
        rank = rng.choice([0, 1, 2, 3]) if depth else 0
        if not rank:
            name = rng.choice(list(values))
            return [name], values[name]
        op = {1: "or", 2: "and", 3: "with"}[rank]
        (a, x), (b, y) = build(depth - 1, rank), build(depth - 1, rank + 1)
        value = min(x, y) if op == "or" else max(x, y) if op == "and" else x / 2
        tokens = [*a, op, *b]
        return (["(", *tokens, ")"], value) if rank < least else (tokens, value)

    for _ in range(300):
        tokens, value = build(4)
        assert license_scan.evaluate(tokens, values.__getitem__) == value
        assert license_scan.parse(" ".join(tokens)) == (tokens, len(" ".join(tokens)))


def test_license_edges(spark):
    more = [*DOCS, (7, "MÏT License under the mit licenseé CC_BY#NC", None, None), (8, "under the MIT License " * 20_000, None, None), (9, "cc by\xa0nc cc\x85by nc", None, None)]
    df = spark.createDataFrame(more, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(f"own {c}") for c in (*CLASHES, "Score", "labels")})
    out = license_scan.scan_licenses(df)
    untouched(out, "n_words")
    rows = out.collect()
    assert len(rows) == len(more) and all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(r.text) for r in rows)
    assert license_scan.scan_licenses(df.limit(0)).count() == 0
