"""Main text of web pages by a maximum-scoring run of tokens.

A page is a row of tokens, each with a score: a word's is the log-odds of being content, by a logistic regression on what
encloses it (tag names, words of class, id and role, links, being hidden, being beside an article), between -1 and 1; a tag's is negative, by the
share of its kind that lies outside the content. The contiguous run with the greatest sum, found in one scan, is the
content region; within it, words whose enclosing elements score as no content (adverts, comments and the like among the
article) are left out. All weights come from the labelled pages in labelled_pages.py; no tag or class name decides by rule.

Edge cases: a null or empty html, or one whose words all score as no content, gives an empty text; a tag cut off at the
page's end stays out; a tag whose quoted value never ends is taken to end at its first `>`, and so are those after it;
unknown character references stay as they are; a page without any markup is all text. Time is linear in the page.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, spread, steps

OUT = "page_id long, url string, text string, n_chars long"
#: Elements whose content is never text of the page; their content isn't markup either.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title", "object", "canvas", "math", "audio", "video")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where the next of their kind begins.
SERIAL = frozenset(("li", "td", "th", "tr", "dt", "dd", "option"))
#: Quotes count as the spec has it: after an equals sign only. Every repeat is possessive, so that a tag is read once.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
MAIN = re.compile(r"<(?:article|main)[\s>]", re.I)
ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/])\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+", re.I)
UNSEEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}
SPACES = re.compile(r"\s+")
#: A weight of one: weights are whole numbers, so that sums don't depend on their order.
ONE = 1 << 10


class Weights(NamedTuple):
    base: int  # of a word that nothing encloses
    link: int
    around: dict[str, int]  # by what encloses a word
    tags: dict[str, int]  # by tag, a closing one with a slash
    other: int  # of a tag not seen
    left_out: int  # of a word that scores as no content whatever links enclose it


class Token(NamedTuple):
    kind: str  # text, or tag or gap for inline and block tags
    value: str
    score: int
    kept: bool
    label: bool  # whether the labelled page's marks have it as content


@lru_cache(1 << 16)
def features(tag: str, attrs: str, inner: bool) -> tuple[str, ...]:
    """What an element says of the words in it: its name, its words of class, id and role, and whether it is hidden."""
    out = []
    for m in ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            out += [f".{w}" for w in value.lower().split()]
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and UNSEEN.search(value):
            out.append("hidden")
    if tag not in INLINE and tag not in ("html", "body"):
        out.append("<inner header" if inner and tag == "header" else f"<{tag} named" if out else f"<{tag}")
    return tuple(dict.fromkeys(out))


def tokens(page: str, w: Weights, around: list[tuple[str, ...]] | None = None) -> list[Token]:
    """The page's tokens; `around`, if given, gets what encloses each text token."""
    out: list[Token] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    #: each tag name's places in the stack
    places: defaultdict[str, list[int]] = defaultdict(list)
    open_: Counter[str] = Counter()
    weight = w.around
    at, end, links, total, label, plain = 0, len(page), 0, w.base, False, False
    #: what it says of a word to be outside the articles of a page that has some
    beside = weight.get("beside", 0) if MAIN.search(page) else None
    total += beside or 0

    def text(value: str) -> None:
        if value.isspace():
            out.append(Token("text", value, 0, total > 0, label))
        else:
            own = total + w.link if links else total
            score = max(-ONE, min(ONE, own)) if total > 0 else max(w.left_out, own)
            out.append(Token("text", value, len(value.split()) * score, total > 0, label))
        if around is not None:
            out_of_it = beside is not None and not places["article"] and not places["main"]
            around.append((*(f for f, n in open_.items() if n), *["link"] * (links > 0), *["beside"] * out_of_it))

    def pop(down_to: int) -> None:
        nonlocal total, links
        for name, own in stack[down_to:]:
            places[name].pop()
            links -= name == "a"
            if beside and name in ("article", "main") and not places["article"] and not places["main"]:
                total += beside
            for f in own:
                open_[f] -= 1
                if not open_[f]:
                    total -= weight.get(f, 0)
        del stack[down_to:]

    begin = 0
    while at < end:
        at = page.find("<", at)
        if at < 0:
            break
        start, next_ = at, page[at + 1 : at + 2]
        if next_ in ("!", "?"):
            cdata = page.startswith("<![CDATA[", at)
            stop, mark = (page.find("-->", at + 4), 3) if page.startswith("<!--", at) else (page.find("]]>", at), 3) if cdata else (page.find(">", at), 1)
            to = stop if stop >= 0 else end
            at = stop + mark if stop >= 0 else end
            if start > begin:
                text(page[begin:start])
            if cdata and to > start + 9:
                text(page[start + 9 : to])
            elif page.startswith("<!--", start):
                label = {"<!--[-->": True, "<!--]-->": False}.get(page[start:at], label)
            begin = at
            continue
        m = None if plain else TAG.match(page, at)
        if m is None:
            m = NAME.match(page, at)
            if m is None and next_ != "/":
                at += 1
                continue
            stop = page.find(">", at)
            if m is None and stop < 0:
                at += 1
                continue
            at = stop + 1 if stop >= 0 else end
            plain = plain or m is not None
            attrs = page[m.end() : at - 1] if m is not None else ""
        else:
            at, attrs = m.end(), m[3]
        if start > begin:
            text(page[begin:start])
        begin = at
        if m is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        kind = "tag" if tag in INLINE else "gap"
        name = f"/{tag}" if closing else tag
        out.append(Token(kind, name, w.tags.get(name, w.other), False, label))
        if tag in RAW and not closing:
            if not attrs.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                stop = RAW_END[tag].search(page, at)
                at = begin = stop.end() if stop else end
        elif tag in VOID:
            continue
        elif not closing:
            if stack and (stack[-1][0] == tag and tag in SERIAL or stack[-1][0] == "p" and kind == "gap"):
                pop(len(stack) - 1)
            if attrs.endswith("/"):
                continue
            own = features(tag, attrs, bool(places["article"] or places["main"] or places["section"]))
            if beside and tag in ("article", "main") and not places["article"] and not places["main"]:
                total -= beside
            places[tag].append(len(stack))
            stack.append((tag, own))
            links += tag == "a"
            for f in own:
                if not open_[f]:
                    total += weight.get(f, 0)
                open_[f] += 1
        elif places[tag]:
            pop(places[tag][-1])
    if begin < end:
        text(page[begin:])
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and one past the last of the contiguous run with the greatest sum; of equal sums the earliest, (0, 0) if none is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def extract(page: str | None, weights: Weights | None = None) -> str:
    if not page:
        return ""
    toks = tokens(page, weights or fitted())
    first, last = best_run([t.score for t in toks])
    parts = [t.value if t.kind == "text" else " " * (t.kind == "gap") for t in toks[first:last] if t.kind != "text" or t.kept]
    return SPACES.sub(" ", htmllib.unescape("".join(parts))).strip()


def f1(a: str, b: str) -> float:
    """F1 over words, repeats included."""
    x, y = Counter(a.split()), Counter(b.split())
    if not x or not y:
        return float(x == y)
    return 2 * sum((x & y).values()) / (x.total() + y.total())


#: What tags, and words that are left out in any case, weigh against words of content: the best of these on the labelled pages.
TAG_SCALES, LEFT_OUT = (0.0625, 0.125, 0.25, 0.5, 1.0), (0.03125, 0.125, 0.5, 1.0)


def fit(pages: list[tuple[str, str]]) -> Weights:
    """Weights from pages whose content stands between the comments <!--[--> and <!--]-->."""
    none = Weights(0, 0, {}, {}, 0, 0)
    rows, names = [], Counter()
    outside: defaultdict[str, list[int]] = defaultdict(lambda: [0, 0])
    for page, _ in pages:
        around: list[tuple[str, ...]] = []
        toks = tokens(page, none, around)
        texts = [t for t in toks if t.kind == "text"]
        rows += [(a, t.label, len(t.value.split())) for a, t in zip(around, texts) if not t.value.isspace()]
        within = [i for i, t in enumerate(toks) if t.label]
        for i, t in enumerate(toks):
            if t.kind != "text":
                outside[t.value][0] += not within or not within[0] <= i <= within[-1]
                outside[t.value][1] += 1
    for a, _, _ in rows:
        names.update(a)
    known = sorted(f for f, n in names.items() if n >= 3)
    place = {f: i for i, f in enumerate(known)}
    x = np.zeros((len(rows), len(known) + 1))
    x[:, -1] = 1
    for i, (a, _, _) in enumerate(rows):
        x[i, [place[f] for f in a if f in place]] = 1
    y = np.array([float(r[1]) for r in rows])
    n = np.sqrt([r[2] for r in rows])
    # Newton's steps towards the greatest likelihood, with a ridge that holds rare features near zero
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.3)
    ridge[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        beta = beta + np.linalg.solve(hessian, x.T @ (n * (y - p)) - ridge * beta)
    whole = np.round(beta * ONE).astype(int).tolist()
    around_ = dict(zip(known, whole))
    link = around_.pop("link", 0)

    def made(scale: float, left_out: float) -> Weights:
        tags = {t: min(-1, round(ONE * scale * float(np.log((b - a + 0.5) / (b + 1))))) for t, (a, b) in outside.items()}
        return Weights(whole[-1], link, around_, tags, -round(ONE * scale / 2), -round(ONE * left_out))

    good = lambda w: float(np.mean([f1(extract(page, w), text) for page, text in pages]))
    scale = max(TAG_SCALES, key=lambda s: good(made(s, LEFT_OUT[0])))
    return made(scale, max(LEFT_OUT, key=lambda x: good(made(scale, x))))


@lru_cache(1)
def fitted() -> Weights:
    from .labelled_pages import PAGES

    return fit(PAGES)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html."""
    weights = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "html"):
                text = [extract(x, weights) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return mapped(spread(pages.select("page_id", "url", "html")), run, OUT)
