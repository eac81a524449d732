"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: opening tags with the path of elements above them, and blocks of text with their path.
For every token of a host, the occurrence vector over the host's distinct pages is kept as a sum of hashes of (page,
count): two tokens have the same vector exactly if the sums agree. Tokens of one vector that occur on enough pages form
an equivalence class. On each page a class is valid if its tokens come in the class's order, and classes that cross are
resolved so that the rest nest: each lies in one gap between neighbouring tokens of another, or beside it. The template
is what nests; its text is literal, and the gaps are the slots.

Regions of no main text (menus, headers, footers, sidebars, notices, adverts, forms, comments, by element, or by class, id
or role) are left out. The main region is then the article and main elements in which some slot holds text, and where there
is none of these elements, all of the page that is not mainly links. Of a region's literal text that which stands between
texts of slots is a repeated part of the article and stays; at its edges it goes, but headings of articles stay. A region
without text in any slot, as in near-equal pages, is content that the pages share: it stays whole where no other has any.
So does an article of which over SHARED is literal.

Vectors are sums, so no task ever holds a host's pages, and a host of any size is only partial sums.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import host_of, join_spread, materialize, own_prefix, with_results

PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|</?[a-zA-Z][a-zA-Z0-9:-]*(?=[\s/>]|\Z)(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^<>])*+(?:>|\Z)|<[!?][^>]*>?|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: What a browser shows nobody: hidden elements, and (in RAW) what it parses as no text or only without scripts.
HIDDEN = re.compile(r"""\shidden(?=[\s/>=])|display\s*:\s*none""", re.I)
#: Elements whose content is not parsed.
RAW = frozenset(("script", "style", "noscript", "textarea", "title", "xmp", "iframe", "template"))
CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(
    ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
)
DROPPED = frozenset(("head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "object", "audio", "video", "canvas", "fieldset", "datalist"))
CONTENT = frozenset(("article", "main"))
FOREIGN = frozenset(("svg", "math"))
#: Elements whose text is a block of the box around them; a box is any other element that is not inline.
BLOCKS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_AD = "ad|ads|adv|advert|adverts|advertisement|sponsor|sponsored|promo|promotion|share|sharing|comment|comments|reply|replies"
_MARK = r"(?:^|[\s_-])(?:%s)(?:$|[\s_-])"
MARKED = re.compile(
    _MARK % f"nav|navbar|navigation|menu|menubar|footer|contentinfo|sidebar|aside|complementary|notice|cookie|cookies|consent|gdpr|alert|popup|modal|overlay|form|search|login|signup|"
    f"subscribe|newsletter|social|related|recommended|breadcrumb|breadcrumbs|pagination|commentlist|disqus|discussion|{_AD}",
    re.I,
)
#: Marks of headers say nothing of headings, nor within an article, where a header holds the title.
HEADER = re.compile(_MARK % "header|masthead|banner", re.I)
#: Marks of inline elements.
INLINE_MARKED = re.compile(_MARK % _AD, re.I)
#: Marks of articles that are none: class names that begin so.
NO_ARTICLE = re.compile(rf"(?:^|\s)(?:related|recommended|{_AD})(?:$|[\s_-])", re.I)
ASIDE = re.compile(r"comment|repl(?:y|ies)|discuss|related|/(?:aside|nav|footer|form|dialog)\b", re.I)
CLOSES_P = frozenset(("p", "div", "ul", "ol", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre", "hr", "footer", "header", "aside", "nav", "form", "main", "dl"))
#: A token is frequent if this share of a host's distinct pages has it, and at least so many pages do.
FREQUENT, LEAST_PAGES = 0.5, 3
#: Least tokens of an equivalence class.
LEAST_CLASS = 2
#: An article with a larger share of literal text is one that pages share, not a page's own.
SHARED = 0.75
#: Up to so many template tokens in all, templates are broadcast; beyond, they are joined by host.
BROADCAST_TOKENS = 200_000
#: The same for pages that come more than once in a host (hashes of 8 bytes and the host).
BROADCAST_COPIES = 200_000
#: The same for hosts with enough pages, and their page totals.
BROADCAST_HOSTS = 200_000


def _hash(text: str) -> int:
    """A signed 64-bit hash."""
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


class Open(NamedTuple):
    """An open element: what its text inherits. block is the place in the stack of the nearest element that is not inline,
    box the number of the nearest box."""

    name: str
    path: int
    dropped: bool
    content: int
    aside: bool
    foreign: bool
    block: int
    linked: bool
    box: int


#: Hash, `tag` or `text`, text, whether dropped, content, link share, box, whether a heading.
Token = tuple[int, str, str, bool, int, float, int, bool]


def parse(page: str | None) -> list[Token]:
    """Tokens in page order.

    A text token is a whole block with its white space normalised, without inline adverts and the like. `dropped` says that
    a region of no main text is around it, `content` numbers the outermost article or main element around it (0: none).
    Paths are hashes of the element and the path above it, so the time is in proportion to the page's length however deep it nests.
    """
    out: list[Token] = []
    stack = [Open("", 0, False, 0, False, False, 0, False, 0)]
    opened: Counter[str] = Counter()  # open elements by name: an end tag without one is not searched for
    held: list[str] = []
    linked = n_content = n_boxes = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            e = stack[stack[-1].block]
            out.append((_hash(f"{e.path}\n{text}"), "text", text, e.dropped, e.content, linked / len(text), e.box, e.name in HEADINGS))
        linked = 0

    def close(at: int) -> None:
        opened.subtract(e.name for e in stack[at:])
        del stack[at:]

    page, at_char = page or "", 0
    while m := PIECE.match(page, at_char):
        piece, at_char = m.group(), m.end()
        if piece[0] != "<" or len(piece) == 1:
            over = stack[-1]
            if over.dropped and not stack[over.block].dropped:  # by an inline element
                continue
            text = entities.unescape(piece)
            held.append(text)
            if over.linked:
                linked += len(text.strip())
            continue
        n = NAME.match(piece)
        if not n:
            if piece.startswith("<![CDATA["):
                held.append(piece[9:].removesuffix("]]>"))
            continue
        name = n[1].lower()
        if piece[1] == "/":
            if name not in INLINE:
                flush()
            if opened[name] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name == "br":
            held.append("\n")
            continue
        if name not in INLINE:
            flush()
            at = stack[-1].block
            if name in CLOSES_P and at and (stack[at].name == "p" or name == stack[at].name == "li"):
                close(at)
        marks = " ".join(next(filter(None, x), "") for x in MARK.findall(piece))
        over = stack[-1]
        own = f"/{name}" + (f".{marks}" if marks else "")
        path = _hash(f"{over.path}{own}")
        if name not in INLINE:
            out.append((path, "tag", name, over.dropped, over.content, 0.0, over.box, False))
        if name in RAW:
            end = CLOSE[name].search(page, at_char)
            at_char = end.end() if end else len(page)
            continue
        if name in VOID or (over.foreign and piece.endswith("/>")):  # elsewhere the slash means nothing
            continue
        dropped, content, inline = over.dropped, over.content, name in INLINE
        if name in CONTENT and not content:
            n_content += 1
            content = n_content
            # a wrapper's layout class does not cover the article in it, unless it is a list of comments or the like
            dropped = bool(marks and NO_ARTICLE.search(marks)) or (dropped and over.aside)
        elif name in CONTENT:
            dropped = dropped or bool(marks and NO_ARTICLE.search(marks))
        elif inline:
            dropped = dropped or bool(marks and INLINE_MARKED.search(marks)) or HIDDEN.search(piece) is not None
        elif name not in ("html", "body"):
            header = not content and name not in HEADINGS and (name == "header" or bool(marks and HEADER.search(marks)))
            dropped = dropped or name in DROPPED or header or bool(marks and MARKED.search(marks)) or HIDDEN.search(piece) is not None
        opened[name] += 1
        box = over.box
        if not inline and name not in BLOCKS:
            n_boxes += 1
            box = n_boxes
        foreign, aside = over.foreign or name in FOREIGN, over.aside or (not inline and ASIDE.search(own) is not None)
        stack.append(Open(name, over.path if inline else path, dropped, content, aside, foreign, over.block if inline else len(stack), over.linked or name == "a", box))
    flush()
    return out


def nested_template(tokens: list[Token], template: dict[int, tuple[int, int]]) -> set[int]:
    """Template tokens of this page, of the classes that are valid on it and nest.

    template: token -> (class, place). First occurrences count. A class is valid if they follow its places. Of two classes
    that cross, the one with fewer tokens on the page is left out, or that which begins later.
    """
    at: dict[int, list[int]] = {}
    order: list[int] = []
    seen: set[int] = set()
    for t in tokens:
        if t[0] in template and t[0] not in seen:
            seen.add(t[0])
            group, place = template[t[0]]
            at.setdefault(group, []).append(place)
            order.append(group)
    left = {g: len(p) for g, p in at.items() if p == sorted(p)}
    size, begun, around = dict(left), set(), []  # around: the open classes, outermost first
    for g in order:
        if g not in left:
            continue
        left[g] -= 1
        if g not in begun:
            begun.add(g)
            around.append(g)
        while around and around[-1] != g:  # all inside g's gap are whole, or cross it
            if size[around[-1]] > size[g]:
                around.remove(g)
                del left[g]
                break
            del left[around.pop()]
        else:
            if not left[g]:
                around.pop()
    return {h for h in seen if template[h][0] in left}


def main_text(tokens: list[Token], template: dict[int, tuple[int, int]]) -> str:
    """Text of the main region, blocks joined by one space."""
    literal = nested_template(tokens, template)
    texts = [t for t in tokens if t[1] == "text" and not t[3]]
    regions: dict[int, list[Token]] = {}
    for t in texts:
        if t[4]:
            regions.setdefault(t[4], []).append(t)
    if not regions:
        return " ".join(t[2] for t in _without_edges([t for t in texts if t[5] < 0.5], literal))
    own = [r for r in regions.values() if any(t[0] not in literal for t in r)]
    kept = []
    for r in own or regions.values():
        shared = sum(len(t[2]) for t in r if t[0] in literal) / sum(len(t[2]) for t in r)
        kept += r if shared > SHARED else _without_edges(r, literal, article=True)
    return " ".join(t[2] for t in kept)


def _without_edges(texts: list[Token], literal: set[int], article: bool = False) -> list[Token]:
    """Blocks of slots, and literal ones between two of them: in an article any, else those of the same box. All, if no block
    is of a slot."""
    slots = [i for i, t in enumerate(texts) if t[0] not in literal]
    if not slots:
        return texts
    out, k = [], 0
    for i, t in enumerate(texts):
        while k < len(slots) and slots[k] < i:
            k += 1
        inside = 0 < k < len(slots)
        beside = inside and t[6] == texts[slots[k - 1]][6] == texts[slots[k]][6]
        if t[0] not in literal or (inside if article else beside) or (article and t[7]):
            out.append(t)
    return out


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, token, class, place): the equivalence classes of each host with LEAST_PAGES or more distinct pages.

    Null pages don't count and equal ones once; an empty table has no classes, and tokens whose pages are equally many but
    not the same fall into different ones. A host's tokens lie in as many tasks as they need; its total goes to each.
    Columns other than the two are not read.
    """

    def occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: dict[str, list] = {"host": [], "token": [], "vector": [], "place": [], "page": []}
            for host, page in zip(pdf["host"], pdf["html"], strict=True):
                tokens = parse(page)
                ident = _hash(page or "")
                counts = Counter(t[0] for t in tokens)
                places: dict[int, int] = {}
                for i, t in enumerate(tokens):
                    places.setdefault(t[0], i)
                for token, n in counts.items():
                    rows["host"].append(host)
                    rows["token"].append(token)
                    rows["vector"].append(_hash(f"{ident}:{n}") >> 24)  # 40 bits, so that sums stay exact
                    rows["place"].append(places[token] / len(tokens))
                    rows["page"].append(1)
                rows["host"].append(host)
                rows["token"].append(None)
                rows["vector"].append(0)
                rows["place"].append(0.0)
                rows["page"].append(1)
            yield pd.DataFrame(rows | {"token": pd.array(rows["token"], dtype="Int64")})

    host = host_of(F.col(url_col)).alias("host")
    distinct = pages.filter(F.col(html_col).isNotNull()).select(host, F.col(html_col).alias("html"), F.xxhash64(html_col).alias("h"))
    once = distinct.groupBy("host", "h").agg(F.count("*").alias("n"))
    copied = materialize(once.filter("n > 1").select("host", "h"), "copied-pages")
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_COPIES else copied
    # equal pages count once
    firsts = distinct.join(copied, ["host", "h"], "left_semi").groupBy("host", "h").agg(F.min("html").alias("html"))
    single = distinct.join(copied, ["host", "h"], "left_anti").select("host", "html").union(firsts.select("host", "html"))
    found = single.mapInPandas(occurrences, "host string, token bigint, vector bigint, place double, page int")
    sums = materialize(found.groupBy("host", "token").agg(F.sum("vector").alias("vector"), F.sum("page").alias("n"), F.avg("place").alias("place")), "occurrences")
    totals = sums.filter("token IS NULL").select("host", F.col("n").alias("total"))
    frequent = join_spread(sums.filter("token IS NOT NULL"), totals.filter(F.col("total") >= LEAST_PAGES), "host", "token", BROADCAST_HOSTS)
    frequent = frequent.filter(F.col("n") >= F.greatest(FREQUENT * F.col("total"), F.lit(LEAST_PAGES)))
    # a host has at most mean-tokens / FREQUENT frequent tokens, so these groups are small however many pages it has
    listed = frequent.groupBy("host", "vector", "n").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("tokens")).filter(F.size("tokens") >= LEAST_CLASS)
    return materialize(listed.select("host", F.xxhash64("vector", "n").alias("class"), F.posexplode("tokens").alias("place", "t")).select("host", F.col("t.token").alias("token"), "class", "place"), "templates")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with `text` (main text; empty if none) and `n_chars` (its code points).

    Null and empty html give an empty text. Text that a browser shows nobody (hidden elements, noscript) is none. Pages without a host form one site. Repeated pages count once for the
    template and get equal texts. Very long pages are parsed whole, each by itself. An empty table gives an empty result;
    columns named text and n_chars, in whatever case, are replaced, and all others stay, whatever their names.
    """
    found = templates(pages, url_col, html_col)
    own = own_prefix(pages)
    site, spread, template, main = (f"{own}{c}" for c in ("host", "spread", "template", "text"))
    listed = found.groupBy(F.col("host").alias(site)).agg(F.collect_list(F.struct("token", "class", "place")).alias(template))
    rows = pages.withColumns({site: host_of(F.col(url_col)), spread: F.xxhash64(html_col)})
    if found.count() <= BROADCAST_TOKENS:
        rows = rows.join(F.broadcast(listed), site, "left")
    else:
        rows = join_spread(rows, listed, site, spread, -1, "left")

    @F.pandas_udf("string")
    def text(host: pd.Series, html: pd.Series, template: pd.Series) -> pd.Series:
        known: dict[str, dict[int, tuple[int, int]]] = {}
        out = []
        for h, page, t in zip(host, html, template, strict=True):
            if h not in known:
                known[h] = {x["token"]: (x["class"], x["place"]) for x in t} if t is not None else {}
            out.append(main_text(parse(page), known[h]))
        return pd.Series(out)

    rows = rows.withColumn(main, text(site, F.col(html_col), template))
    return with_results(rows, own, {"text": F.col(main), "n_chars": F.length(main).cast("bigint")})
