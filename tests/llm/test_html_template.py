"""The main text of pages: what the template decides, and that no article is lost."""

import random

import pytest

from candlewright.llm import html_template as H


def texts(spark, pages, host="h.org"):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    return [r.text for r in H.extract(df).orderBy("page_id").collect()]


def alone(page):
    return H.main_text(H.parse(page), {})


ARTICLE = "<article><h1>One title</h1><p>First part of it.</p><p>Second part of it.</p></article>"


@pytest.mark.parametrize("around", [f"<body><nav><a href=/>Home</a></nav>{ARTICLE}<footer>No %d</footer></body>", f"<body><nav><a href=/>Home</a></nav>{ARTICLE.replace('article', 'div')}<footer>No %d</footer></body>"])
def test_pages_that_share_their_article_keep_it(spark, around):
    assert texts(spark, [around % i for i in range(3)]) == ["One title First part of it. Second part of it."] * 3


def test_articles_that_differ_in_a_word_stay_whole(spark):
    part = " ".join(f"word{k}" for k in range(60))
    pages = [f"<article><h1>Title</h1><p>{part}</p><p>Number {i}</p><p>{part} end</p></article>" for i in range(4)]
    assert texts(spark, pages) == [f"Title {part} Number {i} {part} end" for i in range(4)]


def test_repeated_subheadings_are_part_of_the_article(spark):
    page = lambda i: f"<div id=top>Daily News</div><article><h2>Background</h2><p>Story {i} has this length of words</p><h2>What now</h2><p>Later {i} more</p><p>Share this</p></article>"
    assert texts(spark, [page(i) for i in range(6)]) == [f"Background Story {i} has this length of words What now Later {i} more" for i in range(6)]
    # without an article, literal text counts between two blocks of its own box only
    page = lambda i: f"<div><p>Daily News</p></div><div><p>Story {i}</p><p>What now</p><p>Later {i}</p></div><div><p>Our offices</p></div><div><p>Contact {i}</p></div>"
    assert texts(spark, [page(i) for i in range(6)]) == [f"Story {i} What now Later {i} Contact {i}" for i in range(6)]


def test_the_template_decides_where_no_element_does(spark):
    # tables and divs without a name: only what a site repeats tells the menu from the text
    def page(i):
        return f"<table><tr><td>Home</td><td>About us</td></tr></table><div><div>Welcome, reader</div><div><b>Title {i}</b><br>Text {i} of the page</div><div>Imprint</div></div>"

    pages = [page(i) for i in range(8)]
    assert texts(spark, pages) == [f"Title {i} Text {i} of the page" for i in range(8)]
    assert alone(pages[0]) == "Home About us Welcome, reader Title 0 Text 0 of the page Imprint"


def test_an_article_that_all_pages_hold_goes_where_another_is_theirs(spark):
    pages = [f"<article><h2>About</h2><p>This site</p></article><article><p>Story {i}</p></article>" for i in range(5)]
    assert texts(spark, pages) == [f"Story {i}" for i in range(5)]


def test_marks_are_evidence():
    assert alone('<article class="post social-issues"><h1 class="header">T</h1><p>x</p></article>') == "T x"
    assert alone('<article><div class="article-header"><h1>T</h1></div><div class="masthead">m</div><p>x</p></article>') == "T m x"
    assert alone('<div class="header">Site</div><h1 class="header">T</h1><p>x</p>') == "T x"
    assert alone('<article><p>a <span class="ad">Buy now</span>b <a class="share-link" href=x>Share</a> c</p><div class="ad">d</div></article>') == "a b c"
    assert alone('<article><p>x</p></article><div class="comments"><article>y</article></div><article class="comment-1">z</article>') == "x"
    assert alone('<p>x</p><p hidden>y</p><p style="display:none">z</p><noscript>w</noscript><p aria-hidden="true">v</p>') == "x v"


def test_links_count_however_deep():
    menu = "<ul>" + "".join(f"<li><a href=/{i}><span><b><i><u><em>Entry {i}</em></u></i></b></span></a></li>" for i in range(3)) + "</ul>"
    assert alone(f"<div>{menu}<p>Text with <a href=x>one link</a> and more words</p></div>") == "Text with one link and more words"


def nests(order):
    """Whether classes, given by their places, lie in gaps of each other or beside."""
    at = {}
    for i, g in enumerate(order):
        at.setdefault(g, []).append(i)
    gap = lambda a, b: len({sum(x < y for x in at[a]) for y in at[b]}) == 1
    return all(gap(a, b) or gap(b, a) for a in at for b in at if a != b)


def test_what_is_valid_nests():
    rng = random.Random(2)
    for _ in range(500):
        order = [rng.randrange(5) for _ in range(rng.randrange(1, 14))]
        tokens = [(i, "text", "", False, 0, 0.0, 0, False) for i in range(len(order))]
        seen, template = {}, {}
        for i, g in enumerate(order):
            template[i] = (g, seen.setdefault(g, 0))
            seen[g] += 1
        kept = H.nested_template(tokens, template)
        left = [g for i, g in enumerate(order) if i in kept]
        assert nests(left) and all(left.count(g) == order.count(g) for g in left)  # a class stays or goes whole
        if nests(order):
            assert len(kept) == len(order)
    # a class whose tokens change places is not valid
    tokens = [(h, "text", "", False, 0, 0.0, 0, False) for h in (1, 2, 4, 3)]
    assert H.nested_template(tokens, {1: (7, 0), 2: (7, 1), 3: (8, 0), 4: (8, 1)}) == {1, 2}
