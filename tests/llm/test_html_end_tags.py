"""Pages whose end tags are left out keep their article."""

import pytest

from palimpsest.llm import html_text

BODY = "<nav><a href=/>Menu</a></nav><article><h1>One</h1><p>Some text here,\n that is long enough to stand as the article of a page.</p></article><footer>me</footer>"
WANT = "One Some text here, that is long enough to stand as the article of a page."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><meta charset=utf-8></head><body>{BODY}</body></html>",
        f"<html><head><title>x</title><meta charset=utf-8><body>{BODY}",
        f"<head><meta charset=utf-8><link rel=a href=b><script>if (a < b) c('<p>')</script><style>p {{}}</style>{BODY}",
        f"<head><title>x<meta charset=utf-8></head><body>{BODY}",
    ],
)
def test_head(page):
    assert html_text.main_text(page) == WANT


@pytest.mark.parametrize("tag", sorted(html_text.RAW - {"script"}))
@pytest.mark.parametrize("later", ["", "<p><{0}>z</{0}></p>"])
def test_unclosed_element_takes_only_itself(tag, later):
    texts = [n.text.strip() for n in html_text.parse(f"<div><{tag} class=a></div>{BODY}" + later.format(tag)) if n.tag == "#"]
    assert {"Menu", "One", "me"} <= set(texts) and "z" not in texts


def test_labels_of_controls_are_not_text():
    texts = lambda page: [n.text.strip() for n in html_text.parse(page) if n.tag == "#"]
    assert texts("<div><button><b>Go</b></div><p>a</p>") == ["a"]
    assert texts("<select><option>1<option>2<p>a</p>") == ["a"]
    assert texts("<object>x<object>y</object>z</object><p>a</p>") == ["a"]
    assert texts("<p>a</p><script>never closed <p>b</p>") == ["a"]
