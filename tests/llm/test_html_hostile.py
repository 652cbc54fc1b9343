"""Quotes inside tags, hostile pages, and marginals against all states."""

import time
from itertools import product
from math import exp, isclose

import pytest

from palimpsest.llm import html_text

BODY = "<article><h1>One</h1><p{0}>Some text here that is long enough to be the article.</p><p>A second paragraph, long enough too.</p></article>"
WANT = "One Some text here that is long enough to be the article. A second paragraph, long enough too."


@pytest.mark.parametrize("own", ["", " class=it's", ' "', " title='a>b' x=\"y'z>\"", " a= 'x>' b", " a=x\"y", " a='", " =", " /", " title=\"it's\" b='\"'"])
def test_quotes_count_only_where_a_value_begins(own):
    got = html_text.main_text(BODY.format(own))
    assert got == WANT if own != " a='" else "Some text" not in got  # a value that is never closed takes what follows


def test_tags_that_end_with_a_slash():
    tags = lambda page: [(n.tag, n.parent.tag) for n in html_text.parse(page)[1:]]
    assert tags("<div/><p>x") == [("div", "html"), ("p", "html"), ("#", "p")]
    assert tags("<a href=/x/>y</a>") == [("a", "html"), ("#", "a")]
    assert tags('<div class="a"/><p>x') == [("div", "html"), ("p", "html"), ("#", "p")]
    assert tags("<p>a</x><b>c</p></b>d") == [("p", "html"), ("#", "p"), ("b", "p"), ("#", "b"), ("#", "html")]
    assert tags("</><!--><p>a<p") == [("p", "html"), ("#", "p")]


@pytest.mark.parametrize(
    "part", ["<a ", "<", "<!--", "<svg ", "<button><b>", "<select><option>", "<title>", "&", "<p a=\"", "</x>", "<p><y-z><b><hr>", "<ul><li>", "class class=", "<![CDATA[", "</div>", "<p =", "<script>"]
)
def test_time_is_linear(part):
    html_text.trained()
    page = "<div>" * 1000 + part * (1_000_000 // len(part))
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 6


def test_deep_page_with_stray_end_tags():
    began = time.process_time()
    html_text.main_text("<div>" * 300_000 + "</p></i>" * 300_000 + "<b>" * 300_000 + "<hr>" * 100_000)
    assert time.process_time() - began < 40


@pytest.mark.parametrize("page", ["<div class=menu><a href=/>Menu</a></div><article><p>Some <b>text</b> here.</p></article>", "<ul><li>a<li>b</ul><p>c", "<footer>x</footer>"])
def test_marginals_are_those_of_all_states(page):
    model, nodes = html_text.trained(), html_text.parse(page)
    at = {id(n): i for i, n in enumerate(nodes)}
    total, inside = 0.0, [0.0] * len(nodes)
    for state in product((0, 1), repeat=len(nodes)):
        weight = 1.0
        for n, y in zip(nodes, state, strict=True):
            weight *= exp(model.own(n)) if y else 1.0
            if n.parent is not None:
                weight *= model.move[html_text.kind(n)][state[at[id(n.parent)]]][y]
        total += weight
        inside = [a + weight * y for a, y in zip(inside, state, strict=True)]
    for got, want in zip(model.marginals(nodes), inside, strict=True):
        assert isclose(got, want / total, rel_tol=1e-9)


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extracted(none, carry=["url"]).collect() == []
