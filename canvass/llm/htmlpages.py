"""Labelled pages from which the extraction learns its weights: ``data-label`` marks the main text.

Their words don't matter, only how many stand in which elements; so most are written by rule.
"""

from __future__ import annotations

#: Names that pages give to boilerplate in class, id or role (fixed list).
BOILERPLATE_NAMES = (
    "ad ads advert advertisement adsense sponsor sponsored promo promoted banner notice cookie cookies consent gdpr "
    "popup modal overlay alert newsletter subscribe subscription signup login share sharing social follow related "
    "recommended teaser sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "comment comments commentlist disqus replies reply respond discussion footer foot header masthead topbar toolbar search form "
    "copyright legal disclaimer contentinfo complementary skip hidden tags meta"
).split()
#: Names of places and kinds of boxes, which beside a name of boilerplate change nothing about it (fixed list).
PLACE_NAMES = (
    "top bottom left right upper lower center main primary secondary first last global site page web box boxes block blocks bar list item items "
    "area section wrapper wrap container inner outer content text body row col column columns panel unit slot zone holder group link links "
    "nav title heading label button buttons icon icons post article entry user reader"
).split()
#: Names of states: beside one of these a name of boilerplate says what a page has, not what an element is (fixed list).
STATE_NAMES = "has no with without is not open opened closed free show hide visible enabled disabled".split()
#: Names that pages give to the element with the main text (fixed list).
CONTENT_NAMES = "content article post entry story main body text maincontent articlebody".split()

_SENTENCE = "words of a sentence that somebody wrote for this page to be read"


def _words(n: int) -> str:
    return " ".join((_SENTENCE.split() * (n // 13 + 1))[:n])


def _prose(paragraphs: int = 4) -> str:
    one = f"<p>{_words(40)} <a href='/x'>{_words(2)}</a> {_words(20)} <b>{_words(3)}</b> <em>{_words(2)}</em> <i>{_words(2)}</i> <span>{_words(4)}</span> <strong>{_words(2)}</strong>.</p>"
    more = (
        f"<h2>{_words(4)}</h2><h3>{_words(4)}</h3><ul><li>{_words(12)}</li><li>{_words(12)}</li></ul><ol><li>{_words(9)}</li></ol>"
        f"<blockquote>{_words(15)}</blockquote><pre><code>{_words(6)}</code></pre><figure><figcaption>{_words(8)}</figcaption></figure>"
        f"<table><tr><th>{_words(2)}</th><td>{_words(6)}</td></tr></table><dl><dt>{_words(2)}</dt><dd>{_words(8)}</dd></dl><section><div>{_words(20)}</div></section>"
    )
    return one * paragraphs + more


def _around(main: str) -> str:
    return (
        f"<!DOCTYPE html><html><head><title>{_words(8)}</title></head><body>"
        f"<header><h1>{_words(3)}</h1><p>{_words(6)}</p></header>"
        f"<nav><ul>{f'<li><a href=/>{_words(2)}</a></li>' * 6}</ul></nav>{main}"
        f"<aside><h3>{_words(3)}</h3><p>{_words(25)}</p></aside>"
        f"<form><label>{_words(3)}</label><input><select><option>{_words(2)}</option></select><button>{_words(2)}</button></form>"
        f"<footer><p>{_words(12)}</p><a href=/>{_words(2)}</a></footer></body></html>"
    )


def _teasers(name: str, n: int = 3) -> str:
    return f"<section class='{name}' data-label='other'>" + f"<article><h3>{_words(4)}</h3><p>{_words(20)}</p></article>" * n + "</section>"


def _inside(name: str) -> str:
    return f"<div class='{name}' data-label='other'><p>{_words(10)}</p><a href=/>{_words(2)}</a><span>{_words(4)}</span></div>"


def _layouts(body: str) -> list[str]:
    """Pages of other kinds around one body: old tables, nested wrappers, sections, and names on html and body."""
    menu = "".join(f"<a href=/>{_words(2)}</a> | " for _ in range(5))
    return [
        f"<html class='has-menu'><body class='no-sidebar single-post'>{menu}{body}<p class='copyright'>{_words(9)}</p></body></html>",
        f"<body><table><tr><td>{menu}</td></tr><tr><td>{body}</td><td class='sidebar'><p>{_words(20)}</p></td></tr><tr><td class='footer'>{_words(9)}</td></tr></table></body>",
        f"<body><div id='page'><div id='wrapper'><div class='topbar'>{menu}</div><div class='row'>{body}</div><div class='widget'><h3>{_words(2)}</h3><p>{_words(15)}</p></div></div></div></body>",
        f"<body><div class='navbar'>{menu}</div><section>{body}</section><section class='related'><p>{_words(25)}</p></section><div class='newsletter'>{_words(12)}</div></body>",
    ]


LABELLED_PAGES = (
    *(_around(f"<{tag}><div data-label='main'><h1>{_words(6)}</h1>{_prose()}</div></{tag}>") for tag in ("article", "main")),
    *(_around(f"<div class='{name}' data-label='main'><h1>{_words(6)}</h1>{_prose(3)}</div>") for name in CONTENT_NAMES),
    *(_around(f"{_inside(name)}<article data-label='main'><h1>{_words(6)}</h1>{_prose(1)}{_inside(name)}{_prose(1)}</article>{_inside(name)}") for name in BOILERPLATE_NAMES),
    *(_around(f"<p>{_words(9)}</p><div><p>{_words(30)}</p></div><article data-label='main'><h1>{_words(6)}</h1>{_prose(1)}</article><p>{_words(9)}</p>") for _ in range(3)),
    # articles that are teasers or comments, beside a body in a div
    *(_around(f"<div class='{body}' data-label='main'><h1>{_words(6)}</h1>{_prose()}</div>{_teasers(name)}") for body in CONTENT_NAMES for name in ("teaser", "comments", "related")),
    # other layouts
    *(page for name in ("article", "div class='content'", "div", "section") for page in _layouts(f"<{name} data-label='main'><h1>{_words(6)}</h1>{_prose(3)}</{name.split()[0]}>")),
)
