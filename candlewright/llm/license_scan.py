"""Licences that documents state: identifier tags and notice phrases found by Aho-Corasick, and their expressions.

One automaton holds all phrases as words. Where notices overlap, the leftmost and then the longest counts, and notices
joined by `and` or `or` form an expression; the text behind a tag is one by itself. A shunting-yard parser evaluates an
expression to how much it restricts use: `or` leaves the choice, so the least of its sides, `and` the most, and `with`
names an exception, which halves it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_prefix, with_results

#: Fixed values. Base phrases, as words, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label, restriction from 0 (public domain) to 1 (no use), identifiers without version suffixes, notice phrases as words.
LICENSES = (
    ("cc0", 0.0, ("cc0-1.0",), ("cc0 1 0", "creative commons zero")),
    ("unlicense", 0.0, ("unlicense",), ("released into the public domain", "the unlicense")),
    ("mit", 0.1, ("mit", "mit-0"), ("under the mit license", "mit license")),
    ("isc", 0.1, ("isc",), ("isc license",)),
    ("zlib", 0.1, ("zlib",), ("zlib license",)),
    ("bsd-2", 0.1, ("bsd-2-clause",), ("bsd 2 clause", "simplified bsd license")),
    ("bsd-3", 0.1, ("bsd-3-clause",), ("bsd 3 clause", "new bsd license")),
    ("apache-2", 0.1, ("apache-2.0",), ("apache license version 2", "apache license 2 0", "apache 2 0 license")),
    ("cc-by", 0.2, ("cc-by-3.0", "cc-by-4.0"), ("cc by 3 0", "cc by 4 0", "creative commons attribution license")),
    ("mpl-2", 0.4, ("mpl-2.0",), ("mozilla public license version 2", "mpl 2 0")),
    ("epl-2", 0.4, ("epl-2.0",), ("eclipse public license version 2", "eclipse public license 2 0")),
    ("lgpl-2.1", 0.4, ("lgpl-2.1",), ("gnu lesser general public license version 2 1",)),
    ("lgpl-3", 0.4, ("lgpl-3.0",), ("gnu lesser general public license version 3", "lgplv3")),
    ("lgpl", 0.4, ("lgpl",), ("gnu lesser general public license",)),
    ("cc-by-sa", 0.5, ("cc-by-sa-3.0", "cc-by-sa-4.0"), ("cc by sa",)),
    ("gpl-2", 0.6, ("gpl-2.0",), ("gnu general public license version 2", "gplv2")),
    ("gpl-3", 0.6, ("gpl-3.0",), ("gnu general public license version 3", "gplv3")),
    ("gpl", 0.6, ("gpl",), ("gnu general public license",)),
    ("agpl-3", 0.7, ("agpl-3.0",), ("gnu affero general public license version 3", "agplv3")),
    ("cc-by-nd", 0.8, ("cc-by-nd-4.0",), ("cc by nd",)),
    ("cc-by-nc", 0.9, ("cc-by-nc-3.0", "cc-by-nc-4.0"), ("cc by nc",)),
    ("cc-by-nc-sa", 0.9, ("cc-by-nc-sa-3.0", "cc-by-nc-sa-4.0"), ("cc by nc sa",)),
    ("cc-by-nc-nd", 0.95, ("cc-by-nc-nd-3.0", "cc-by-nc-nd-4.0"), ("cc by nc nd",)),
    ("all-rights-reserved", 1.0, ("licenseref-proprietary",), ("all rights reserved",)),
)
#: Restriction of an identifier that is not listed; it is its own label, in lower case.
UNKNOWN = 0.5
#: The tag, as words and in the text; its expression ends with the line.
TAG, TAGGED = "spdx license identifier", re.compile(r"SPDX-License-Identifier\s*:[ \t]*([^\r\n]*)", re.I)
#: Words that may stand between the notices of one expression; it needs one of the first two.
JOINING = ("and", "or", "either", "the", "under", "terms", "of", "both", "a", "licensed", "dual", "at", "your", "option")
STEP = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.:-]*\+?))")
RANK = {"or": 1, "and": 2, "with": 3}
RESULT = (
    "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,"
    "notices:array<struct<label:string,word:bigint,n_words:bigint>>,expressions:array<struct<text:string,labels:string,score:double>>>"
)
KIND = pa.struct([
    *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("notices", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64())]))),
    ("expressions", pa.list_(pa.struct([("text", pa.string()), ("labels", pa.string()), ("score", pa.float64())]))),
])
#: Bytes to words: A-Z lower-cased, all other ASCII characters but letters and digits white space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

OF_ID = {i: (label, weight) for label, weight, ids, _ in LICENSES for i in ids}
OF_LABEL = {label: weight for label, weight, _, _ in LICENSES}


@lru_cache(1)
def automaton():
    """Phrases between spaces -> (number of words, label); the tag's label is empty."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in {**{p: label for label, _, _, phrases in LICENSES for p in phrases}, TAG: ""}.items():
        found.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1, label))
    found.make_automaton()
    return found


def license_of(identifier: str) -> tuple[str, float]:
    """(label, restriction) of an identifier, whatever its case; later versions count as the version."""
    name = re.sub(r"(?:\+|-only|-or-later)$", "", identifier.lower())
    return OF_ID.get(name, (name, UNKNOWN))


def parse(text: str) -> tuple[list[str], int]:
    """The tokens of the longest beginning of text that is an expression once its parentheses are closed, and its end."""
    tokens: list[str] = []
    depth = at = whole = end = 0
    operand = True  # an operand comes next
    while m := STEP.match(text, at):
        bracket, name = m.groups()
        word = (name or "").lower()
        if operand:
            if bracket == ")" or word in RANK:
                break
            depth += bracket == "("
            operand = bracket == "("
        elif bracket == "(" or (name and word not in RANK) or (bracket and not depth):
            break
        else:
            depth -= bracket == ")"
            operand = not bracket
        tokens.append(bracket or (word if word in RANK else name))
        at = m.end()
        if not operand:
            whole, end = len(tokens), at
    tokens = tokens[:whole]
    return tokens + [")"] * (tokens.count("(") - tokens.count(")")), end


def evaluate(tokens: list[str], value: Callable[[str], float]) -> float:
    """Shunting-yard: operands wait for the operator that binds them, operators for weaker ones or a parenthesis."""
    values: list[float] = []
    waiting: list[str] = []

    def apply() -> None:
        b, a, op = values.pop(), values.pop(), waiting.pop()
        values.append(min(a, b) if op == "or" else max(a, b) if op == "and" else a / 2)

    for t in tokens:
        if t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting[-1] != "(":
                apply()
            waiting.pop()
        elif t in RANK:
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[t]:
                apply()
            waiting.append(t)
        else:
            values.append(value(t))
    while waiting:
        apply()
    return values[0]


def joined(labels) -> str:
    return ",".join(sorted(set(labels)))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()  # of bytes, so that only ASCII characters part words


def tagged(text: str) -> list[tuple[int, int, dict]]:
    """(first word, words, expression) of what stands behind identifier tags. Exceptions are no licences and give no label."""
    out, at, last = [], 0, 0
    for m in TAGGED.finditer(text):
        at, last = at + len(words_of(text[last : m.start(1)].encode("utf-8", "surrogatepass"))), m.start(1)
        tokens, end = parse(m[1])
        if tokens:
            names = [t for i, t in enumerate(tokens) if t not in RANK and t not in "()" and not (i and tokens[i - 1] == "with")]
            found = {"text": " ".join(tokens), "labels": joined(license_of(x)[0] for x in names), "score": evaluate(tokens, lambda t: license_of(t)[1])}
            out.append((at, len(words_of(m[1][:end].encode())), found))
    return out


def noticed(words: list[bytes], hits: list[tuple[int, int, str]]) -> tuple[list[dict], list[dict]]:
    """(notices, expressions) of the hits (word, number of words, label): leftmost, then longest, without overlap."""
    chosen: list[tuple[int, int, str]] = []
    for hit in sorted(hits, key=lambda h: (h[0], -h[1])):
        if not chosen or hit[0] >= chosen[-1][0] + chosen[-1][1]:
            chosen.append(hit)
    chains: list[list[str]] = []
    for i, (at, _, label) in enumerate(chosen):
        gap = [w.decode("latin-1") for w in words[chosen[i - 1][0] + chosen[i - 1][1] : at]] if i else []
        op = next((w for w in gap if w in JOINING[:2]), None)
        if op and all(w in JOINING for w in gap):
            chains[-1] += [op, label]
        else:
            chains.append([label])
    notices = [{"label": label, "word": at, "n_words": n} for at, n, label in chosen]
    return notices, [{"text": " ".join(c), "labels": joined(c[::2]), "score": evaluate(c, OF_LABEL.__getitem__)} for c in chains]


def scan(text: str | None) -> dict:
    """What RESULT names, for one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = words_of(data)
    chain = b" " + b" ".join(words) + b" "
    starts, found, tags = [], [], False
    for end, (phrase, n, label) in automaton().iter(chain.decode("latin-1")):
        if not label:
            tags = True
            continue
        starts.append(end - len(phrase) - 1)
        found.append((n, label, phrase))
    hits, base = [], []
    if found:
        places = np.searchsorted(np.flatnonzero(np.frombuffer(chain, np.uint8) == ord(" ")), starts).tolist()
        hits = [(at, n, label) for at, (n, label, _) in zip(places, found, strict=True)]
        base = [(at, BASE[phrase]) for at, (_, _, phrase) in zip(places, found, strict=True) if phrase in BASE]
    by_tag = tagged(text) if tags else []
    spans = np.array([(at, at + n) for at, n, _ in by_tag]).reshape(-1, 2)
    # what a tag's expression spells is no notice beside it
    behind = lambda at: (k := np.searchsorted(spans[:, 0], at, "right")) and at < spans[k - 1, 1]
    notices, expressions = noticed(words, [h for h in hits if not behind(h[0])])
    expressions += [e for _, _, e in by_tag]
    places = [at for at, _ in base]
    labels = joined([label for _, label in base] + [x for e in expressions for x in e["labels"].split(",")])
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": joined(label for _, label in base),
        "labels": labels, "score": max((e["score"] for e in expressions), default=0.0), "notices": notices, "expressions": expressions,
    }


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, notices and expressions.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. n_base counts all places of base phrases, overlapping ones
    too; first_word and last_word are null without one. score is the most that an expression of the text restricts its
    use, 0 without any. A null or empty text has no words and no labels. Texts are scanned whole in one walk, however long.
    Equal texts get equal results; ties do not arise. An empty table gives an empty result. Columns named like the results,
    in whatever case, are replaced; all others stay, whatever their names.
    """
    own = own_prefix(docs)

    @F.arrow_udf(RESULT)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([scan(t) for t in texts.to_pylist()], KIND)

    rows = docs.withColumn(f"{own}found", scanned(F.col(text_col)))
    return with_results(rows, own, {f.name: F.col(f"{own}found.{f.name}") for f in KIND})
