"""Labelled pages to train the page model on: invented pages of many layouts, with the texts that are content."""

from __future__ import annotations

import html
import random

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu ner lin tor mas que".split()
# Names that page authors give to the parts of a page.
MAIN = ["article", "main", "div class=content", "div id=main-content", "div class=post-body", "div class=entry-content", "section class=article-body", "div class=story", "main id=content", "div role=main", "div class=text", "article class=post"]
MENUS = ["nav", "div class=menu", "ul class=nav", "div id=navigation", "nav class=navbar", "div class=breadcrumbs", "div role=navigation", "div class=topbar", "menu", "ul class=menu"]
HEADS = ["header", "div id=header", "header class=site-header", "div class=masthead", "div class=banner", "div role=banner"]
FEET = ["footer", "div id=footer", "footer class=site-footer", "div class=bottom", "div class=copyright", "div role=contentinfo"]
SIDES = ["aside", "div class=sidebar", "div id=sidebar", "aside class=related", "div class=widget", "section class=recommended", "div role=complementary", "div class=promo", "div class=share", "div class=social", "div class=newsletter", "div class=tags"]
NOTICES = ["div class=cookie-notice", "div class=notice", "div id=consent", "div class=alert", "div class=popup", "div class=modal", "div role=alert", "dialog", "div class=disclaimer", "p class=notice", "div class=cookie-banner"]
ADVERTS = ["div class=ad", "div class=advert", "div id=ads", "div class=sponsored", "aside class=ad", "section class=advertisement", "ins class=ads", "div class=banner-ad"]
COMMENTS = ["section class=comments", "div id=comments", "div class=comment-list", "ol class=commentlist", "div class=discussion", "div class=replies", "section id=comments", "div class=user-comments", "div class=reader-comments"]
BOXES = ["div", "div class=wrapper", "div class=container", "div id=page", "section", "div class=row"]


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.content: set[str] = set()

    def words(self, low: int, high: int) -> str:
        out = ["".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))]
        return " ".join(out).capitalize()

    def text(self, low: int, high: int, keep: bool = False, dot: bool = True) -> str:
        s = self.words(low, high) + "." * dot
        if keep:
            self.content.add(s)
        return html.escape(s)

    def put(self, name: str, inner: str) -> str:
        tag, _, own = name.partition(" ")
        key, _, value = own.partition("=")
        return f"<{tag}" + (f' {key}="{value}"' if own else "") + f">{inner}</{tag}>"

    def links(self, n: int) -> str:
        items = "".join(f'<li><a href="/{i}">{self.text(1, 3, dot=False)}</a></li>' for i in range(n))
        return f"<ul>{items}</ul>" if self.r.random() < 0.7 else items.replace("<li>", "").replace("</li>", " ")

    def paragraph(self, keep: bool) -> str:
        low, high = self.r.choice([(1, 5), (5, 15), (15, 60), (30, 120)])
        s = self.text(low, high, keep)
        q = self.r.random()
        if q < 0.15:
            s += " <b>" + self.text(1, 4, keep) + "</b> " + self.text(3, 20, keep)
        elif q < 0.3:
            s += ' <a href="/x">' + self.text(1, 4, keep, dot=False) + "</a> " + self.text(3, 20, keep)
        elif q < 0.4:
            s = f"<b>{s}<br>"
        return f"<p>{s}" + "</p>" * (self.r.random() < 0.85)

    def main(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            h = f"<h1>{self.text(2, 10, True, dot=r.random() < 0.5)}</h1>"
            out.append(f"<header>{h}</header>" if r.random() < 0.15 else h)
        for _ in range(r.randint(1, 9)):
            q = r.random()
            if q < 0.7:
                out.append(self.paragraph(True))
            elif q < 0.78:
                out.append(f"<h2>{self.text(1, 8, True, dot=False)}</h2>")
            elif q < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.text(2, 20, True)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif q < 0.88:
                out.append(f"<blockquote><p>{self.text(5, 30, True)}</p></blockquote>")
            elif q < 0.92:
                out.append("<table><tr>" + "".join(f"<td>{self.text(1, 6, True)}</td>" for _ in range(3)) + "</tr></table>")
            elif q < 0.96:
                out.append(f"<pre>{self.text(5, 30, True)}</pre>")
            else:
                out.append(f"<div>{self.text(5, 40, True)}</div>")
            if r.random() < 0.08:
                out.append(self.aside())
        return "".join(out)

    def aside(self) -> str:
        r = self.r
        name = r.choice(r.choice([ADVERTS, NOTICES, SIDES]))
        return self.put(name, self.paragraph(False) if r.random() < 0.6 else self.text(1, 30))

    def comments(self) -> str:
        one = lambda: f'<div class="comment"><span class="author">{self.text(1, 2, dot=False)}</span>{self.paragraph(False)}</div>'
        return self.put(self.r.choice(COMMENTS), f"<h3>{self.text(1, 2, dot=False)}</h3>" * (self.r.random() < 0.6) + "".join(one() for _ in range(self.r.randint(1, 5))))

    def form(self) -> str:
        return f'<form action="/s"><label>{self.text(1, 4, dot=False)}</label><input name="q"><p>{self.text(2, 12)}</p></form>'

    def build(self) -> str:
        r, body = self.r, []
        menu = lambda: self.put(r.choice(MENUS), self.links(r.randint(2, 8)))
        if r.random() < 0.5:
            body.append(self.put(r.choice(HEADS), (f"<a href='/'>{self.text(1, 4, dot=False)}</a>" if r.random() < 0.5 else f"<p>{self.text(1, 12)}</p>") + menu() * (r.random() < 0.5)))
        if r.random() < 0.8:
            body.append(menu())
        for chance, part in ((0.4, self.aside), (0.2, self.form)):
            if r.random() < chance:
                body.append(part())
        inner = self.put(r.choice(MAIN), self.main())
        if r.random() < 0.3:
            inner += self.comments()
        if r.random() < 0.4:
            inner += self.put(r.choice(SIDES), f"<h3>{self.text(1, 4, dot=False)}</h3>" + (self.links(r.randint(2, 6)) if r.random() < 0.5 else self.paragraph(False)))
        for _ in range(r.choice([0, 0, 1, 2])):
            inner = self.put(r.choice(BOXES), inner)
        body.append(inner)
        for chance, part in ((0.15, self.comments), (0.2, self.form), (0.3, self.aside)):
            if r.random() < chance:
                body.append(part())
        if r.random() < 0.85:
            body.append(self.put(r.choice(FEET), r.choice([lambda: "&copy; " + self.text(2, 12), lambda: self.links(3), lambda: f"<p>{self.text(2, 20)}</p>"])()))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 5)}</title></head><body>{''.join(body)}</body></html>"


def labelled_pages(n: int = 1200, seed: int = 1) -> list[tuple[str, set[str]]]:
    """n pages, each with the set of its texts that are content; texts are long enough to be told apart."""
    out = []
    for i in range(n):
        p = _Page(seed * 1_000_003 + i)
        page = p.build()
        out.append((page, p.content))
    return out
