from collections import Counter

import pytest

from lodestrand.llm import html
from lodestrand.llm.common import Scratch

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head>
<body><header><a href="/">Site</a></header><nav><ul><li><a>A</a><li><a>B</a></ul></nav><div class="ad">Buy {n}</div>
<div class="cookie-notice"><p>We use cookies</div><main><article><h1>Head {n}</h1><p>One &eacute;&nbsp;&lt;x&gt;
  two<p><b>Three<br>four {n}</p><form><input><button>Go</button></form><ul><li>item {n}<li>other</ul><div class="share">Share</div><p>Read us daily</p>
<section class="comments"><article><p>Nice post, a long reader comment that is longer than the article itself, it goes on and on and on and on</p></article></section></article></main>
<aside>Side</aside><footer>&copy; f</footer>"""
TEXT = "Head {n}\nOne é <x> two\nThree four {n}\nitem {n}\nother\nRead us daily"


def test_one_page():
    assert html.main_text(PAGE.format(n=1), None) == TEXT.format(n=1)


@pytest.mark.parametrize("page, text", [("", ""), ("just text", "just text"), ("<p>a < b &amp c</p>", "a < b & c"), ("<div>a<!-- <p>x --><p>b", "a\nb"), ("<article>cut off <p>here", "cut off\nhere"), ("</p></div>x", "x"), ("<script>x", ""), ("<p hidden>a</p><p>b", "b")])
def test_broken_pages(page, text):
    assert html.main_text(page, None) == text


@pytest.mark.parametrize("mark", ["content has-sidebar", "post category-social", "post comments-open", "post-body no-sidebar", "overflow-hidden", "teaser", "search"])
@pytest.mark.parametrize("name", ["body", "main", "article", "div"])
def test_class_words_do_not_lose_the_article(name, mark):
    page = f'<nav>Menu</nav><{name} class="{mark}" data-id="ad" data-hidden="1"><p>A whole article.<p>To its end.</{name}><div class="ad">Buy</div>'
    assert html.main_text(page, None).startswith("A whole article.\nTo its end.") and "Buy" not in html.main_text(page, None)


@pytest.mark.parametrize("attributes", ['class="ad"', 'class="box related-posts"', 'id="ad-2"', 'class="cookie-notice"', 'role="search"', "hidden", 'aria-hidden="true"', 'style="display: none"'])
def test_marked_and_hidden_blocks_go(attributes):
    assert html.main_text(f"<article><p>A<div {attributes}>x</div><p>B</article>", None) == "A\nB"
    assert html.main_text(f'<div class="ad"><main><p>A<div {attributes}>x x x x x</div></main></div>', None) == "A"


def test_a_comment_longer_than_the_article_goes():
    assert html.main_text('<div class="post">A</div><div class="comments"><p>long long long</div>', None) == "A"
    assert html.main_text('<article>A<article class="comment">long long long</article></article>', None) == "A"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>menu<article><p>One, a long part</article><p>between<article><p>two</article>", "One, a long part\ntwo"),
        ('<p>menu<div class="entry">One, a long part<div class="entry">inner</div></div><div class="entry">two</div>', "One, a long part\ninner\ntwo"),
        ("<p>menu<main><p>The body of the page, which is long<article>card</article><p>end</main>", "The body of the page, which is long\ncard\nend"),
        ("<p>The body of the page, which is long<article>card</article>", "The body of the page, which is long\ncard"),
        ("<p>menu and more of it<main><p>A<article>The article of the page</article></main>", "The article of the page"),
    ],
)
def test_all_parts_of_an_article_stay(page, text):
    assert html.main_text(page, None) == text


def test_constants_of_a_template_go_where_there_are_enough_pages(spark):
    rows = [(i, "http://a.example/x", PAGE.format(n=i)) for i in range(20)] + [(100 + i, f"http://b.example:80/{i}", PAGE.format(n=7)) for i in range(20)]
    rows += [(200, None, None), (201, None, ""), (202, "c.example", PAGE.format(n=1)), (0, "http://a.example/x", PAGE.format(n=0)), (None, "//A.EXAMPLE/y", PAGE.format(n=5))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html.extract(pages).collect()
    got = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows)
    # All different pages of host a share this paragraph; on host b there is one page, copied.
    for i in (0, 5, 19):
        assert f"Head {i}" in got[i] and f"four {i}" in got[i] and "Share" not in got[i] and "Nice post" not in got[i]
    assert got[100] == got[119] == TEXT.format(n=7) and got[202] == TEXT.format(n=1)
    assert got[200] == got[201] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in found)


FEW = """<div class="top"><p>We use cookies on all of our pages</div><div class="text"><h1>Summary</h1><p>Text {n} is about {n} and of no other thing
at all, from here to the end of it, as the pages of a site are.</div><div class="end"><h3>Home</h3><p>News</p><h4>Contact us</h4></div>"""


@pytest.mark.parametrize("pages", [2, 3, 11])
def test_few_pages_have_a_wrapper_too(spark, pages):
    rows = [(i, "http://a/", FEW.format(n=f"x{i}")) for i in range(pages)]
    # Two versions of one article are no template, and one page has none.
    long = "<p>" + "the same words of one article " * 5
    rows += [(100, "http://b/", f"<p>Seen 1 times{long}"), (101, "http://b/", f"<p>Seen 2 times{long}"), (102, "http://c/", FEW.format(n=1))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(pages):
        assert f"Text x{i} is about" in got[i] and "cookies" not in got[i] and ("News" in got[i]) == (pages == 2)
    assert got[100].count("the same words") == 5 and "cookies" in got[102]


def test_no_rows(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_inference():
    a = html.wrap(html.parse("<div><h1>A</h1><p>x<p>y</div>"))
    b = html.wrap(html.parse("<div><h1>B</h1><table><td>t</table><p>z</div>"))
    assert html.expression(html.align(a, b)) == "<div><h1>#TEXT</>(<table><td>t</></>)?(<p>#TEXT</>)+</>"
    assert html.expression(html.align(a, a)) == "<div><h1>A</>(<p>#TEXT</>)+</>"


def test_wrappers_do_not_depend_on_how_pages_are_dealt(spark):
    pages = spark.createDataFrame([(i, "http://a/", PAGE.format(n=i)) for i in range(12)], "page_id long, url string, html string")
    made = {html.infer(pages.repartition(n), Scratch(spark, "t")).first()["wrapper"] for n in (1, 3)}
    import json

    assert len({html.expression(json.loads(m)[1]) for m in made}) == 1


def test_deep_and_long_pages():
    deep = "<article>" + "<div>" * 100_000 + "<p>in the depth" + "<nav>menu</nav>" + "</div>" * 99_990 + "<p>higher</article><footer>f</footer>"
    assert html.main_text(deep, html.wrap(html.parse(deep)), 1) == "in the depth\nhigher"
    long = "<article>" + "".join(f"<p>{i}<div>d{i}</div>" for i in range(50_000)) + "</article>"
    other = "<article>" + "".join(f"<div>{i}</div><h2>d{i}</h2>" for i in range(50_000)) + "</article>"
    wrapper = html.align(html.wrap(html.parse(long)), html.wrap(html.parse(other)))
    assert html.main_text(long, wrapper, 2).count("\n") == 99_999
    assert len(html.expression(wrapper)) < 1_000_000
    unclosed = "<div><p>x" * 100_000
    assert html.main_text(unclosed, None).count("x") == 100_000


def test_text_under_the_deepest_block_keeps_its_order():
    page = "<div>" * 200 + "a<div>b<div>c</div>d</div>e<div class='ad'>no</div>f" + "</div>" * 200 + "g"
    assert html.main_text(page, None) == "a\nb\nc\nd\ne\nf\ng"


def test_both_alignments_are_common_subsequences():
    import random

    own = random.Random(1)
    for _ in range(300):
        a, b = ([own.choice("abc") for _ in range(own.randrange(12))] for _ in range(2))
        longest, by_turn = html._longest(a, b), html._by_turn(a, b)
        for found in (longest, by_turn):
            assert all(a[x] == b[y] for x, y in found)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        assert len(by_turn) <= len(longest)


def test_numbers_in_classes_do_not_tell_blocks_apart():
    pages = [f'<article class="post post-{i}"><p>{i}</article>' for i in range(50)]
    wrapper = html.wrap(html.parse(pages[0]))
    for page in pages[1:]:
        wrapper = html.align(wrapper, html.wrap(html.parse(page)))
    assert html.expression(wrapper) == "<article.post post-0><p>#TEXT</></>"


def test_optional_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(html, "MOST_OPTIONAL", 5)
    wrapper = html.wrap(html.parse("<p>a<ul><li>x</ul>"))
    for i in range(40):
        wrapper = html.align(wrapper, html.wrap(html.parse(f"<p>b<div class='c{chr(97 + i % 26)}{chr(97 + i // 26)}'>y</div><ul><li>x</ul>")))
    assert len(wrapper[4]) <= 7 and wrapper[4][0][1] == 41


class Plain(__import__("html.parser", fromlist=["HTMLParser"]).HTMLParser):
    """A second extractor, by the standard library's parser: the text of the article by blocks, for pages of the test tables."""

    OUT = {"nav", "footer", "aside", "form", "script", "style", "head"}
    BLOCK = {"p", "h1", "h2", "h3", "ul", "ol", "li", "div", "article", "section", "table", "tr", "td", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.out = 0
        self.said, self.blocks = [], []

    def cut(self):
        if said := " ".join("".join(self.said).split()):
            self.blocks.append(said)
        self.said = []

    def handle_starttag(self, tag, attrs):
        self.said += [" "] if tag == "br" else []
        if tag in self.BLOCK:
            self.cut()
        self.inside += tag == "article"
        self.out += tag in self.OUT

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.cut()
        self.inside -= tag == "article"
        self.out -= tag in self.OUT

    def handle_data(self, data):
        if self.inside and not self.out:
            self.said.append(data)


def test_pages_of_the_tables_as_a_second_extractor_reads_them(spark):
    import os

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    alike = 0
    for r in pages.collect():
        own = Plain()
        own.feed(r["html"])
        own.cut()
        a, b = Counter(got[r["page_id"]].split()), Counter("\n".join(own.blocks).split())
        both = sum((a & b).values())
        alike += 2 * both / max(sum(a.values()) + sum(b.values()), 1) if a or b else 1
    assert alike / len(got) > 0.98
