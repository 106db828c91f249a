import itertools
import random
import re
from html import unescape

from sedra.llm import html_text as h

SCHEMA = "page_id long, url string, html string, text string"


def brute_cut(unary, edges):
    def cost(x):
        return sum(-u for u, v in zip(unary, x) if v) + sum(w for i, j, w in edges if x[i] != x[j])

    return min(cost(x) for x in itertools.product((False, True), repeat=len(unary))), cost


def test_min_cut_equals_brute_force():
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randint(1, 9)
        unary = [rng.choice([-2, -1, 0, 1, 2]) * rng.random() for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.random() * 2) for _ in range(rng.randint(0, 14))]
        best, cost = brute_cut(unary, edges)
        assert abs(cost(h.min_cut(unary, edges)) - best) < 1e-6


ARTICLE = "The committee met on Monday and agreed to publish what it had found, said the chair."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site name</a> The best of all sites since 1999.</header><nav><ul><li><a href=a>Home</a><li><a href=b>About</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site work for you, and you agree to that.</div>
<article><h1>A title &amp; more</h1><p><b>{ARTICLE}<br><p>Of&nbsp;course.</p><!-- no --><div class="ad">Buy the best things here today, said everybody who knows.</div>
<p>Second <i>para</i>graph, with <a href="x">a link</a> in it.\n\t And more.</p><ul><li>One point made here.<li>Another point.</ul></article>
<aside>Other stories that you may like to read some day.</aside><section id="comments"><p>I think that this is a great article, thank you so much.</p></section>
<form><label>Your name</label><button>Send</button></form><footer>&copy; 2024 All rights reserved.</footer></body></html>"""
WANT = f"A title & more {ARTICLE} Of course. Second paragraph, with a link in it. And more. One point made here. Another point."


def test_page_with_an_article():
    assert h.main_text(PAGE) == WANT


def test_page_without_an_article():
    page = f'<div id="menu"><a>Home</a> <a>News</a></div><div><h2>Head</h2><p>{ARTICLE} {ARTICLE}</p><p>{ARTICLE}</p><p>Yes.</p></div><div class="footer">Imprint</div><div><a>One</a></div><div><a>Two</a></div>'
    assert h.main_text(page) == f"Head {ARTICLE} {ARTICLE} {ARTICLE} Yes."


def test_broken_markup():
    for page, want in [
        (None, ""), ("", ""), ("<p", ""), ("<script>x", ""), ("<!-- x", ""), ("<nav>a</nav>", ""),
        (f"<article><p>{ARTICLE}</p><p class=\"x>{ARTICLE}", f"{ARTICLE} {ARTICLE}"), (f"<article></div></b>{ARTICLE}", ARTICLE), (f"<article><p>{ARTICLE}<p>{ARTICLE}</article><foot", f"{ARTICLE} {ARTICLE}"),
    ]:
        assert h.main_text(page) == want, page


def by_pattern(html):
    """What the article element of the synthetic pages holds."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    return " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(?:/?p|br|/?h1)>", " ", inner))).split())


def test_synthetic_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in h.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == by_pattern(r.html) and got[r.page_id].n_chars == len(by_pattern(r.html)) and got[r.page_id].url == r.url


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "")]
    got = h.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.page_id), str(r.url), r.text) for r in got) == [("1", "u", WANT)] * 2 + [("2", "None", ""), ("None", "v", "")]
    assert h.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_class_words_are_evidence_and_no_verdict():
    a = f"<p>{ARTICLE}</p><p>{ARTICLE}</p>"
    want = f"{ARTICLE} {ARTICLE}"
    for page in (
        f'<div class="layout has-sidebar"><article>{a}</article></div>', f'<article class="post comments-open">{a}</article>', f'<div class="content no-sidebar">{a}</div>',
        f'<article><div class="reviews">{a}</div></article>', f'<form id="all"><nav><a href="/">Home</a></nav><main>{a}</main></form>', f'<body class="with-menu">{a}<div class="footer">Imprint</div></body>',
        f'<article>{a}<div class="userposts"><p>I think that this is a great article, thank you so much.</p></div></article>', f'<div class="story">{a}</div><div class="userposts"><p>I think that this is a great article, thank you so much.</p></div>',
        f'<article>{a}<div class="reviews"><p>I think that this is a great book, thank you so much.</p></div></article>', f'<div class="post">{a}</div><div class="site-footer"><p>Made by hand in the north, since 1999.</p></div>',
    ):
        assert h.main_text(page) == want, page
    assert h.class_words("layout has-sidebar") == (False, False, False) and h.class_words("post comments-open")[0] and h.class_words("topnav x")[1]


def test_cut_differs_from_the_signs_and_is_right():
    """Blocks whose own evidence is wrong, and which their neighbours set right."""
    p = f"<p>{ARTICLE} {ARTICLE}</p>"
    page = f'<div class="menu"><a href="/">Home</a></div><div>{p}<p>See <a href="/x">the plan of the old bridge</a></p>{p}<ul><li><a href="/d">On doughs and breads</a></li></ul>{p}</div><div><a href="/a">Older</a></div>'
    blocks = h.blocks_of(page)
    signs = [h.evidence(b, h.excuse(blocks), h.default_costs()) > 0 for b in blocks]
    labels = h.label_blocks(blocks)
    assert labels == [False, True, True, True, True, True, False] and signs != labels


def test_costs_hold_on_pages_they_were_not_fitted_on():
    wrong = total = 0
    for k, page in enumerate(h.PAGES):
        blocks = h.blocks_of(page)
        want = [b.text.startswith("+") for b in blocks]
        blocks = [h.Block(b.text.lstrip("+"), b.element, b.link_chars) for b in blocks]
        wrong += sum(a != b for a, b in zip(h.label_blocks(blocks, h.fit_costs(h.PAGES[:k] + h.PAGES[k + 1 :])), want))
        total += len(want)
    assert wrong <= 0.05 * total


def test_very_long_page():
    page = "<article>" + f"<p>{ARTICLE}</p>" * 20_000 + "</article>" + "<div>" * 3000 + "x"
    assert h.main_text(page) == " ".join([ARTICLE] * 20_000)
