"""Labelled pages to train the content model on: pages of many layouts whose parts are marked as main text or not.

Each page is drawn from its number alone: a masthead, menus, notices, forms, adverts, sidebars, reader comments and a
footer around an article, by semantic elements, by class names, by both, or by bare boxes and tables. ``data-main`` is
1 on what a reader came for and 0 on what surrounds or interrupts it; unmarked elements hold both.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PAGES = 1000
#: Common names of the parts of a page, fixed values: element, and class or id.
HEADER = "header|header top masthead banner brand logo site-header page-header topbar"
MENU = "nav|nav menu navbar navigation breadcrumb breadcrumbs main-menu tabs toc links"
NOTICE = "div|cookie consent notice gdpr alert privacy popup modal overlay newsletter subscribe paywall toast message warning"
ADVERT = "div|ad ads advert advertisement sponsored promo promotion banner adsense dfp commercial"
SIDEBAR = "aside|sidebar side widget related recommended popular trending rail more secondary archive tagcloud"
FORM = "form|search login signup contact newsletter-form register feedback poll"
COMMENTS = "section|comments comment comment-list respond replies discussion disqus responses reviews thread"
FOOTER = "footer|footer copyright bottom colophon legal site-footer imprint foot"
EXTRA = "div|share social tags meta author byline pagination pager rating toolbar print credits"
MAIN = "main|main content wrapper container page primary body layout column center"
ARTICLE = "article|article post entry entry-content article-body story text post-content body-text hentry maincontent prose"


def _word(r: random.Random) -> str:
    return "".join(r.choice(("ta", "ri", "mon", "el", "s", "qu", "ent", "or", "ü", "in", "é", "al", "th", "er")) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, n: int) -> str:
    return " ".join(_word(r) for _ in range(n))


def _sentences(r: random.Random, n: int) -> str:
    kind = r.random()
    if kind < 0.08:
        return " | ".join(_word(r) for _ in range(n))
    if kind < 0.12:
        return _words(r, n)
    out, left = [], n
    while left > 0:
        k = min(left, r.randint(2, 18))
        out.append(_words(r, k).capitalize() + r.choice("....!?"))
        left -= k
    return " ".join(out)


def _open(r: random.Random, part: str, style: str, mark: int | None, inner: str) -> str:
    element, names = part.split("|")
    name = r.choice(names.split())
    if style == "bare":
        element, said = r.choice(("div", "td", "section", "div")), ""
    elif style == "classes":
        element = "div" if element != "form" else "form"
        said = f' {r.choice(("class", "id"))}="{name}"'
    else:
        said = f' class="{name}"' if style == "both" or element == "div" or r.random() < 0.3 else ""
    marked = "" if mark is None else f' data-main="{mark}"'
    return f"<{element}{said}{marked}>{inner}</{element}>"


def _links(r: random.Random, n: int) -> str:
    items = [f'<a href="/{_word(r)}">{_words(r, r.randint(1, 3))}</a>' for _ in range(n)]
    return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if r.random() < 0.7 else " &middot; ".join(items)


def _body(r: random.Random) -> str:
    out = [f"<h1>{_words(r, r.randint(2, 10)).capitalize()}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.choice((0, 1, 2, 3, 5, 8, 13))):
        n = r.choice((1, 2, 3, 5, 8, 20, 40, 60, 90, 140))
        kind = r.random()
        if kind < 0.72:
            out.append(f"<p>{'<b>' if r.random() < 0.1 else ''}{_sentences(r, n)}" + (f' <a href="/x">{_words(r, 2)}</a> {_sentences(r, 5)}' if r.random() < 0.15 else "") + r.choice(("</p>", "</p>", "<br>")))
        elif kind < 0.79:
            out.append(f"<h2>{_words(r, r.randint(1, 6))}</h2>")
        elif kind < 0.85:
            out.append("<ul>" + "".join(f"<li>{_sentences(r, r.randint(1, 15))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.89:
            out.append(f"<blockquote>{_sentences(r, n)}</blockquote>")
        elif kind < 0.92:
            out.append(f"<pre>{_words(r, n)}</pre>")
        elif kind < 0.95:
            out.append(f"<figure><img src=x><figcaption>{_sentences(r, 6)}</figcaption></figure>")
        else:
            out.append("<table>" + "".join(f"<tr><td>{_word(r)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
    return "".join(out)


def _surround(r: random.Random, part: str) -> str:
    if part is FORM:
        return f"<label>{_words(r, 2)}</label><input name=q>" + (f"<p>{_sentences(r, 8)}</p>" if r.random() < 0.4 else "")
    if part is COMMENTS:
        return f"<h3>{_words(r, 2)}</h3>" + "".join(f'<div class="comment"><p>{_words(r, 2)}</p><p>{_sentences(r, r.choice((4, 12, 30, 60)))}</p></div>' for _ in range(r.randint(1, 4)))
    if part is MENU:
        return _links(r, r.randint(3, 9))
    if part is FOOTER:
        return r.choice((f"&copy; {_word(r)}.example.net &middot; {_sentences(r, r.randint(3, 20))}", f"<p>{_sentences(r, 15)}</p>{_links(r, 4)}"))
    kind = r.random()
    if kind < 0.5:
        return _sentences(r, r.choice((2, 5, 9, 16)))
    return (f"<h3>{_words(r, 2)}</h3>" if kind < 0.75 else "") + (_links(r, r.randint(2, 6)) if kind < 0.85 else f"<p>{_sentences(r, r.choice((4, 10, 25)))}</p>")


def labelled_page(number: int) -> str:
    """The page of that number, with marks."""
    r = random.Random(f"labelled:{number}")
    style = r.choices(("semantic", "both", "classes", "bare"), (5, 4, 4, 1))[0]

    def around(part: str, chance: float) -> str:
        return _open(r, part, style if style != "bare" or part is FORM or r.random() < 0.5 else "classes", 0, _surround(r, part)) if r.random() < chance else ""

    article = _body(r)
    if r.random() < 0.25:
        cut = article.rfind("<p>", 0, r.randint(1, len(article) + 1))
        extra = _open(r, r.choice((ADVERT, EXTRA, SIDEBAR)), "both", 0, _surround(r, ADVERT))
        article = article + extra if cut < 0 else article[:cut] + extra + article[cut:]
    inside = _open(r, COMMENTS, "both", 0, _surround(r, COMMENTS)) if r.random() < 0.08 else ""
    main = _open(r, ARTICLE, style, 1, article + inside)
    held = around(ADVERT, 0.35) + around(EXTRA, 0.25) + main + around(EXTRA, 0.3) + around(COMMENTS, 0.35)
    if r.random() < 0.6:
        held = _open(r, MAIN, style, None, held + around(SIDEBAR, 0.3))
    page = around(NOTICE, 0.3) + around(HEADER, 0.6) + around(MENU, 0.8) + around(FORM, 0.3) + around(ADVERT, 0.4) + held + around(SIDEBAR, 0.5) + around(NOTICE, 0.15) + around(FOOTER, 0.9)
    return f"<!DOCTYPE html><html><head><title>{_words(r, 4)}</title></head><body>{page}</body></html>"


def labelled_pages(spark: SparkSession, pages: int = PAGES) -> DataFrame:
    """(html) of the first ``pages`` labelled pages, made in tasks."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([labelled_page(i) for i in batch.column(0).to_pylist()], pa.string())], ["html"])

    return spark.range(pages).mapInArrow(make, "html string")
