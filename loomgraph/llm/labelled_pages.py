"""Labelled pages, composed for this package, on which html.py fits its weights: (html, its main text).

Content stands between the comments <!--[--> and <!--]-->, which are no text.

A page is a layout (what holds the content, with or without an element of its own) and a choice of blocks before, inside,
beside and after it. Class words are drawn from those that sites use for such blocks, so that a weight is learned for each.
"""

from __future__ import annotations

import random

WORDS = "river mill wheel flour water sill road floor upper night bend stone carried neighbours lost rose morning winter field horse bread letter market summer tower bridge house garden window evening".split()
MENUS = ("nav", "navbar", "navigation", "menu", "menubar", "main-menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "skip", "toolbar", "tags", "topbar")
HEADS = ("header", "masthead", "site-header", "page-header", "banner", "branding", "contentinfo")
FEET = ("footer", "foot", "site-footer", "copyright", "bottom", "disclaimer", "legal")
ADS = ("ad", "ads", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "adbox")
NOTICES = ("cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "cookie-notice", "cookie-banner")
SIGNUPS = ("newsletter", "subscribe", "signup", "login", "search", "respond")
SIDES = ("sidebar", "side-bar", "aside", "complementary", "widget", "widgets", "related", "recommended", "popular", "share", "sharing", "social", "author-bio", "trending")
COMMENTS = ("comment", "comments", "reply", "replies", "disqus", "commentlist", "discussion", "reviews")
CONTENTS = ("content", "post", "entry", "story", "article-body", "post-content", "entry-content", "main", "main-content", "article", "text", "body-copy")


def _sentence(r: random.Random, low: int = 4, high: int = 16) -> str:
    return " ".join(r.choice(WORDS) for _ in range(r.randint(low, high))).capitalize() + r.choice((".", ".", "."))


def _named(r: random.Random, tag: str, names: tuple[str, ...], inside: str, end: bool = True) -> str:
    """An element with a class, id or role of those names, or (half the time, where the tag says it all) with none."""
    own = r.choice(names)
    how = r.choice((f' class="{own}"', f" class='x {own}'", f' id="{own}"', f" class={own}", f' role="{own}" class="box"'))
    if tag not in ("div", "section", "ul", "ol", "p", "span", "td") and r.random() < 0.6:
        how = ""
    return f"<{tag}{how}>{inside}" + f"</{tag}>" * end


def _links(r: random.Random, n: int) -> str:
    way = r.randint(0, 3)
    text = [f'<a href="/{r.choice(WORDS)}">{" ".join(r.sample(WORDS, r.randint(1, 3)))}</a>' for _ in range(n)]
    return {0: lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in text) + "</ul>", 1: lambda: " ".join(text), 2: lambda: " | ".join(text), 3: lambda: "<ul>" + "".join(f"<li>{x}" for x in text) + "</ul>"}[way]()


def _junk(r: random.Random, kind: str) -> str:
    n = r.randint(3, 9)
    said = " ".join(_sentence(r) for _ in range(r.randint(1, 3)))
    match kind:
        case "menu":
            return r.choice((lambda: _named(r, "nav", MENUS, _links(r, n)), lambda: _named(r, "div", MENUS, _links(r, n)), lambda: _named(r, "ul", MENUS, "".join(f'<li><a href="#">{w}</a>' for w in r.sample(WORDS, n))), lambda: _named(r, "menu", MENUS, _links(r, n))))()
        case "bare":  # links in elements that say nothing
            return r.choice((f"<div>{_links(r, n)}</div>", "<table><tr>" + "".join(f"<td><a href=/{w}>{w}</a></td>" for w in r.sample(WORDS, n)) + "</tr></table>", _links(r, n)))
        case "head":
            return _named(r, r.choice(("header", "div")), HEADS, f"<h1>{r.choice(WORDS)} daily</h1>" + r.choice(("", f"<p>{said}</p>", "<form><input name=q><label>Find</label><button>Search</button></form>")))
        case "foot":
            return _named(r, r.choice(("footer", "footer", "div")), FEET, f"&copy; 2020 {' '.join(r.sample(WORDS, 3))} &middot; {said}")
        case "ad":
            return _named(r, r.choice(("div", "aside", "section", "span")), ADS, r.choice((said, f"<p>{said}</p>", f'<a href="/buy">{said}</a>')))
        case "notice":
            return _named(r, r.choice(("div", "section", "dialog")), NOTICES, f"<p>{said}</p><button>Yes</button>")
        case "signup":
            return r.choice((f"<form action=/s><label>{said}</label><input><button>Send {r.choice(WORDS)}</button></form>", _named(r, "div", SIGNUPS, f"<h3>{r.choice(WORDS)}</h3><p>{said}</p><form><fieldset><input><button>Go</button></fieldset></form>")))
        case "side":
            return _named(r, r.choice(("aside", "div", "section")), SIDES, f"<h3>{r.choice(WORDS)}</h3>" + r.choice((_links(r, n), f"<p>{said}</p>", f"<p>{said}</p>{_links(r, n)}")))
        case "comments":
            each = "".join(_named(r, r.choice(("div", "li")), ("comment", "reply", "comment-body"), f"<p>{' '.join(_sentence(r) for _ in range(r.randint(1, 3)))}</p>") for _ in range(r.randint(1, 4)))
            return _named(r, r.choice(("section", "div", "ol")), COMMENTS, f"<h3>{n} replies</h3>{each}")
        case _:
            return f"<div {r.choice(('hidden', 'style=\"display:none\"', 'aria-hidden=\"true\"', 'style=\"color:red;visibility: hidden\"'))}><p>{said}</p></div>"


def _content(r: random.Random) -> tuple[str, str]:
    """Blocks of content, with what may stand among them, and their text."""
    html, text = [], []
    if r.random() < 0.7:
        t = _sentence(r, 2, 8)
        html.append(r.choice((f"<h1>{t}</h1>", f"<h2>{t}</h2>", f'<header><h1 class="title">{t}</h1></header>')))
        text.append(t)
    for _ in range(r.randint(2, 7)):
        a, b, c = " ".join(_sentence(r) for _ in range(r.randint(1, 5))), _sentence(r), _sentence(r, 1, 3)
        block, own = r.choice(
            (
                (f"<p>{a}</p>", a), (f"<p>{a}", a), (f"<br>{a}<br>{b}<br>", f"{a} {b}"), (f"<p>{a} <b>{b}</b></p>", f"{a} {b}"), (f"<p>{a}<br>{b}</p>", f"{a} {b}"), (f"<p>{c}</p>", c), (f"<blockquote>{b}</blockquote>", b),
                (f"<h3>{c}</h3><p>{a}</p>", f"{c} {a}"), (f"<ul><li>{b}<li>{c}</ul>", f"{b} {c}"), (f"<ol><li>{b}</li><li><p>{c}</p></li></ol>", f"{b} {c}"), (f"<p>{a} See <a href=/m>the map</a> there.</p>", f"{a} See the map there."),
                (f"<table><tr><th>{c}<td>{b}</table>", f"{c} {b}"), (f"<dl><dt>{c}<dd>{b}</dl>", f"{c} {b}"), (f"<div>{a}</div>", a), (f"<section><p>{a}</p></section>", a), (f"<figure><img src=a.png><figcaption>{c}</figcaption></figure>", c), (f"<pre>{b}</pre>", b),
            )
        )
        html.append(block)
        text.append(own)
        if r.random() < 0.15:
            html.append(("</p>" if block == f"<p>{a}" else "") + "<!--]-->" + _junk(r, r.choice(("ad", "side", "signup", "side"))) + "<!--[-->")
    return "<!--[-->" + "".join(html) + "<!--]-->", " ".join(text)


def page(seed: int) -> tuple[str, str]:
    r = random.Random(seed)
    if r.random() < 0.12:  # text with little markup or none
        text = " ".join(_sentence(r) for _ in range(r.randint(1, 9)))
        return r.choice(("{}", "<body>{}</body>", "<div>{}</div>", "<html><body><div><div>{}</div></div>", "<table><tr><td>{}</table>", "<center>{}</center>")).format(f"<!--[-->{text}<!--]-->"), text
    inner, text = _content(r)
    own = f' class="{r.choice(CONTENTS)}"' if r.random() < 0.6 else f' id="{r.choice(CONTENTS)}"' if r.random() < 0.5 else ""
    wrap = r.choice(("article", "article", "main", "div", "div", "section", "td", "nest", "both", ""))
    body = {"": inner, "td": f"<table><tr><td>{inner}</td></tr></table>", "nest": f"<div><div{own}>{inner}</div></div>", "both": f"<main><article>{inner}</article></main>"}.get(wrap) or f"<{wrap}{own}>{inner}</{wrap}>"
    before = [_junk(r, k) for k in r.sample(("head", "menu", "bare", "ad", "notice", "hidden", "menu"), r.randint(1, 4))]
    after = [_junk(r, k) for k in r.sample(("comments", "side", "foot", "bare", "signup", "hidden", "comments", "ad"), r.randint(1, 4))]
    if r.random() < 0.5:
        after.append(_junk(r, "foot"))
    title = "<title>T</title><style>p{margin:0}</style><script>var a='<p>';</script>"
    return f"<!DOCTYPE html><html><head>{title}</head><body>{''.join(before)}{body}{''.join(after)}</body></html>", text


#: Pages to fit on, and others, of other seeds, to judge the fit by.
PAGES = [page(seed) for seed in range(200)]
HELD_OUT = [page(seed) for seed in range(1000, 1200)]
