"""Main text of pages: hand-made pages, and all test pages against the plain reading of their article."""

from html.parser import HTMLParser

import pytest

from podium.llm import density, queries
from podium.llm.density import main_text
from tests.llm.conftest import SF_DIR

LONG = "The quick brown fox jumps over the lazy dog and goes on to sleep in the warm sun. " * 6
LONG = LONG.strip()


class Article(HTMLParser):
    """The text inside <article>, every tag but <b> parting blocks."""

    def __init__(self):
        super().__init__()
        self.inside, self.pieces = False, []

    def _part(self, tag, inside):
        if tag != "b":
            self.pieces.append(" ")
        if tag == "article":
            self.inside = inside

    def handle_starttag(self, tag, attrs):
        self._part(tag, True)

    def handle_endtag(self, tag):
        self._part(tag, False)

    def handle_data(self, data):
        if self.inside:
            self.pieces.append(data)


def plain(html):
    reader = Article()
    reader.feed(html or "")
    reader.close()
    return " ".join("".join(reader.pieces).split())


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("<nav><a href=/>Home</a></nav><footer>All rights</footer>", ""),
        ("just   text\n of a page", "just text of a page"),
        ("<article><h1>T</h1><p>a<b>b</b>c<br>d<p>e &amp; f&nbsp;g &copy 1 &lt 2</article>", "T abc d e & f g © 1 < 2"),
        ("<body><article><p>In <a href='/x'>links</a> too.</p></article><p>" + LONG, "In links too."),
        ("<article><p>one</p><aside>no</aside><form>no<input></form><script>var a='</p>';</script><p>two", "one two"),
        ("<article><p>one</p><div class='comments'><p>" + LONG + "</p></div></article>", "one"),
        ("<article>one</article><section id=comments><article>" + LONG + "</article></section>", "one"),
        ("<main class='with-sidebar'><p>one</p><div class='cookie-notice'>no</div></main>", "one"),
        ("<div class=sidebar-page><article>kept</article></div>", "kept"),
        ("<article><p title=\"a>b\">one<p title=it's>two<!-- > no --><p hidden>no<p>three</article>", "one two three"),
        ("<article><ul><li>one<li>two<ul><li>three</ul></ul><table><tr><td>4<td>5</table>", "one two three 4 5"),
        ("<article>a < b, 1<2 and x<!-- open", "a < b, 1<2 and x"),
        ("<article>one<script>never closed <p>no", "one"),
        ("<ARTICLE><P>One</P></ARTICLE>", "One"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_density_alone_finds_the_article():
    menu = "<div><a href=1>Home page</a> <a href=2>All news</a> <a href=3>About us</a></div>"
    foot = "<div><span>Terms</span><span>Imprint</span><span>2020</span></div>"
    body = f"<div><h2>Head</h2><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div></div>"
    assert main_text(f"<body>{menu}{body}{foot}") == f"Head {LONG} Short. {LONG}"


def test_links_count_against_a_node():
    page = density.Page("<div><p>" + LONG + "</p></div><div><a>" + LONG + "</a></div>")
    _, dense, _, _ = density.densities(page)
    first, second = (i for i, t in enumerate(page.tags) if t == "div")
    assert dense[first] > dense[second] > 0 or dense[second] == 0


def test_deep_and_long_pages():
    deep = "<div>" * 100_000 + "end"
    assert main_text(deep) == "end"
    assert main_text("<article>" + "<p>word</i><b>" * 100_000) == " ".join(["word"] * 100_000)
    assert main_text("<article>" + "<a b=" * 50_000) == ""


def test_rows(spark):
    rows = [
        (1, "u", "<article>one"),
        (1, "u", "<article>one"),
        (None, None, None),
        (2, "v", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.selectExpr("*", "1 as text", "2 as n_chars", "3 as _text")
    found = density.extracted(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted([(1, "u", "one", 3)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert density.extracted(pages.limit(0)).collect() == []


def test_all_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    found = queries.queries()["op11_main_text"](spark, SF_DIR).collect()
    assert len(found) == len(pages)
    for row in found:
        text = plain(pages[row["page_id"]]["html"])
        assert (row["url"], row["text"], row["n_chars"]) == (pages[row["page_id"]]["url"], text, len(text))
