"""Templates of hosts with many copies and of sections of large hosts; what names and structure may take out; a naive reader."""

import random
from html.parser import HTMLParser

import pytest

from tracelake.llm import html_text

PAGES = "page_id long, url string, html string"
COMPILED = html_text._compiled()


def texts(spark, htmls, **options):
    rows = [(i, "https://h.example/p", h) for i, h in enumerate(htmls)]
    return {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, PAGES), **options).collect()}


def text(html):
    return "\n".join(html_text.main_lines(html_text.read_tree(html, *COMPILED), frozenset()))


def test_copies_do_not_raise_the_share(spark):
    got = texts(spark, [f"<body><div><p>About us</p></div><p>text {i % 15}</p></body>" for i in range(100)])
    assert all(t == f"text {i % 15}" for i, t in got.items())


def test_the_pages_needed_do_not_grow_with_the_host(spark):
    box = "<div><p>Section box</p></div>"
    got = texts(spark, [f"<body>{box if i < 60 else ''}<p>text {i}</p></body>" for i in range(600)])
    assert all(t == f"text {i}" for i, t in got.items())


def test_articles_without_containers_count_for_the_host(spark):
    few = [f"<body><div><p>Said</p></div><p>text {i}</p></body>" for i in range(6)]
    got = texts(spark, few + [f"<article><p>story {i}</p></article>" for i in range(40)])
    assert all("Said" in got[i] for i in range(6))


def test_counts_decide_where_nothing_else_does(spark):
    # attributes differ from page to page, the subtree's names and texts do not; a quoted paragraph is text
    pages = [f"<article><h1>Title {i}</h1><div class='x{i}'><p>Read our other sites</p><ul><li>One</li></ul></div><p>Quoted by all.</p><p>story {i}</p></article>" for i in range(12)]
    with_counts, without = texts(spark, pages), texts(spark, pages, least=10**9)
    assert all(with_counts[i] == f"Title {i}\nQuoted by all.\nstory {i}" for i in range(12))
    assert all("Read our other sites\nOne" in without[i] for i in range(12))


def test_a_page_of_templates_alone_keeps_its_text(spark):
    pages = ["<body><div><p>Closed today</p></div></body>"] * 3 + [f"<body><div><p>Closed today</p></div><p>text {i}</p></body>" for i in range(10)]
    got = texts(spark, pages)
    assert got[0] == "Closed today" and got[5] == "text 2"


@pytest.mark.parametrize(
    "html,want",
    [
        ("<!-- <article> --><p>Hello</p>", "Hello"),
        ('<script>var x="<article>"</script><p>Hello</p>', "Hello"),
        ("<main><form><p>whole page</p></form></main>", "whole page"),
        ("<article><p>a</p><p class='banner-text'>b</p></article>", "a\nb"),
        ("<article><div id='search-results'><p>a</p></div></article>", "a"),
        ("<article><div class='social-science'>a</div></article>", "a"),
        ("<article></article><p>Hello</p>", "Hello"),
        ("<article><div class='comments'>a</div></article>", "a"),  # all there is
        ("<article><p>x</p><div class='comment-list'>a</div><div class='cookie_notice'>b</div><section id='related'>c</section></article>", "x"),
        ("<article><p>x</p><article class='comment'><p>reader</p></article></article>", "x"),
        ("<article><p>x</p><p class='ad'>buy</p><ul class='share-buttons'><li>tell</li></ul></article>", "x"),
        ("<nav>menu</nav><form><label>Find</label></form>", ""),
        ("<body><div><form><p>Name</p></form></div><p>text</p></body>", "text"),
        ("<div class='header'><h1>T</h1></div><header><p>site</p></header><p>text</p>", "T\ntext"),
        ("a</div>b<p>c", "a\nb\nc"),
    ],
)
def test_what_names_and_structure_take(html, want):
    assert text(html) == want


def test_very_long_and_deep_pages():
    assert text("<div>" * 5000 + "deep" + "<p>x</p>" * 3) == "deep\nx\nx\nx"
    long = "<p>" + "word &amp; " * 200_000 + "</p>"
    assert len(text(f"<article>{long}</article>")) == 200_000 * 7 - 1


class Naive(HTMLParser):
    """Blocks of the article of a well-formed page, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.piece = [], [], ""

    def flush(self):
        line = " ".join(self.piece.split())
        self.blocks += [line] if line else []
        self.piece = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.piece += " "
            return
        if tag in html_text.BLOCKS:
            self.flush()
        self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.flush()
        while self.open and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if "article" in tags and not {"aside", "form", "nav", "script", "style"} & set(tags) and not any(c in ("ad", "comments") for _, c in self.open):
            self.piece += data


def page(rng):
    words = lambda n: " ".join(rng.choice(["ein", "Wort", "&amp;", "x&lt;y", "caf&eacute;", "&#8364;5", "fin."]) for _ in range(rng.randint(1, n)))
    inline = lambda: rng.choice([words(6), f"<b>{words(3)}</b>", f"<a href='/x'>{words(2)}</a>", f"{words(2)}<br>{words(2)}", f"<i><b>{words(2)}</b></i>"])

    def block(depth):
        kind = rng.choice(["p", "p", "h2", "ul", "div", "blockquote", "aside", "ad", "comments", "form", "script"])
        if kind == "script":
            return "<script>if (a < b) { c = '<p>no</p>'; }</script>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{inline()}</li>" for _ in range(rng.randint(1, 3))) + "</ul>"
        if kind in ("ad", "comments"):
            return f'<div class="{kind}"><p>{inline()}</p></div>'
        if kind == "div" and depth:
            return "<div class='c'>" + "".join(block(depth - 1) for _ in range(rng.randint(0, 3))) + "</div>"
        kind = "p" if kind == "div" else kind
        return f"<{kind}>" + " ".join(inline() for _ in range(rng.randint(1, 3))) + f"</{kind}>"

    body = "".join(block(2) + rng.choice(["", "\n", "<!-- note <article> -->"]) for _ in range(rng.randint(1, 8)))
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><p>menu</p></nav><article><h1>{words(4)}</h1>{body}</article><footer>end</footer></body></html>"


@pytest.mark.parametrize("seed", range(40))
def test_agrees_with_a_naive_reader(seed):
    html = page(random.Random(seed))
    naive = Naive()
    naive.feed(html)
    naive.flush()
    assert text(html) == "\n".join(naive.blocks)
