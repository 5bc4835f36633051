"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element in page order.  A
line's length is the length of its text; lines of menus, headers, footers,
sidebars, notices, adverts, forms and comments (by element, role or the words of
class and id) have length 0, and so have lines that are mostly links where the
page marks no main part.  Window k holds the sum of the lengths of ``WINDOW``
lines from line k on.  A segment starts where that sum surges over a threshold
(relative to the page's largest window, so that short pages have one, too) and
ends where it dives to zero.  If the page marks an article (else a main part, by
element, role or a usual class or id), only its lines count and the threshold is
lower, as a marked part holds little else than text.

What is aside parts lines but loses no main text: all lines between the first surge
and the last dive are text, and so are, before and after, the headings next to them
and the lines of the same parent, up to a menu or a page footer.  Of a marked part
that drops what surges nowhere, is no heading and stands apart behind what is aside.

A form around an article or main element doesn't void it.  A wrapper whose class
or id has a word of layout (such as sidebar-right or modal-wrap), and a form around
a part marked by its name, doesn't either where that part has more text than all
else that counts.  What is within an aside, nav or footer element, is hidden, or
stands among adverts, comments or related pages stays aside.

Cases: a null or empty html, and a page without text, give an empty string;
tags, quotes and comments that never end are closed by the end of the page;
elements may be nested or left open in any number, in time proportional to the
page; repeated rows are extracted each for itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.functions.pages import spread

WINDOW = 3
#: A surge is more than this many characters in a window, or this part of the
#: page's largest window if that is less.
SURGE_CHARS, SURGE_PART = 86, 0.2
#: The same part in a marked main part.
MARKED_PART = 0.02
#: Above this part of linked text a line outside a marked main part is a menu.
LINKED = 0.6

# Element names of HTML and words that name the page's other parts.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside form button select option svg canvas object template dialog menu search datalist audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus "
    "breadcrumb breadcrumbs masthead footer sidebar sidebars aside widget widgets comment comments commentlist disqus respond reply replies "
    "cookie cookies consent gdpr notice notices alert popup popups modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations pagination pager toolbar topbar skip search searchbox form".split())
#: Whole classes and ids that mark a main part where no element does.
MAIN_NAMES = frozenset(
    "content main main-content maincontent article article-body article-content articlebody post post-body post-content entry entry-content story "
    "story-body page-content body-content".split())
#: Of these, what an article can be that isn't the page's own.
REPLIES = frozenset("ad ads advert advertisement sponsored promo comment reply related recommended teaser".split())
#: What is around a part: nothing aside, an aside, a form, a wrapper by its words,
#: or such a wrapper around a marked part.
CLEAR, ASIDE, FORM, WRAPPER, CONTESTED = range(5)
#: A class such as has-sidebar or no-comments is about another element.
NEGATED = frozenset("has no with without".split())
#: Words of wrappers that may hold the main part nevertheless.
LAYOUT = frozenset("banner banners nav navbar navigation menu menus masthead footer sidebar sidebars aside alert modal overlay share sharing social toolbar topbar skip notice notices form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold a line each.
SINGLE = HEADINGS | frozenset("p li pre blockquote dd dt figcaption caption td th address summary".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = BLOCKS - {"caption", "dd", "dt", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _aside(tag: str, attrs: str, inside: int) -> tuple[int, int]:
    """Whether the element is none of the main text, and if so how (``ASIDE``,
    ``FORM``, ``WRAPPER``); 2 for an article, 1 for another main part, else 0."""
    if tag in DROPPED and tag != "form" or tag == "header" and not inside:
        return ASIDE, 0
    if tag == "form":
        own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
        words = set(_SPLIT.split(f"{own.get('class', '')} {own.get('id', '')}".lower()))
        hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(own.get("style", "").lower())
        plain = not words & (WORDS - LAYOUT) and own.get("role", "form").strip().lower() not in ROLES - {"form"}
        return (FORM if plain and not hidden else ASIDE), 0
    main = 2 if tag == "article" else 1 if tag == "main" else 0
    named = REPLIES if main else WORDS
    if not attrs or attrs == "/":
        return CLEAR, main
    own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    role = own.get("role", "").strip().lower()
    if role in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(own.get("style", "").lower()):
        return ASIDE, 0
    if tag not in ("html", "body"):
        words = set(_SPLIT.split(f"{own.get('class', '')} {own.get('id', '')}".lower()))
        found = words & named if not words & NEGATED else set()
        if found or "header" in words and not inside and not main:
            return (WRAPPER if found <= LAYOUT and not main else ASIDE), 0
        if tag in ("div", "section", "td") and not MAIN_NAMES.isdisjoint(f"{own.get('class', '')} {own.get('id', '')}".lower().split()):
            main = 1
    if role in ("main", "article") or own.get("itemprop") == "articleBody":
        main = max(main, 1 if role == "main" else 2)
    return CLEAR, main


def _around(state: int, tag: str, other: int, part: int) -> int:
    """What is around an element's content, from what is around the element."""
    if state == ASIDE or other == ASIDE or other and state == CONTESTED:
        return ASIDE
    if other:
        return max(state, other)
    if part and state == FORM:
        return CLEAR if tag in ("article", "main") else CONTESTED
    return CONTESTED if part and state == WRAPPER else state


class Line(NamedTuple):
    text: str
    #: What is around it, the main part it is in and its linked characters.
    aside: int
    main: int
    linked: int
    #: Its block's tag, the number of that block's parent; whether it is in a footer.
    tag: str
    parent: int
    footer: bool


class Open(NamedTuple):
    """An open element."""

    tag: str
    #: How it is aside and what is around its content; the main part it is in.
    other: int
    around: int
    part: int
    main: int
    #: The nearest block: its tag, its number and that of the block around it.
    block: str
    own: int
    above: int
    footer: bool


PAGE = Open("", CLEAR, CLEAR, 0, 0, "", 0, 0, False)


def lines_of(html: str) -> list[Line]:
    """Each block's text in page order."""
    out: list[Line] = []
    stack: list[Open] = []
    held: Counter = Counter()
    serial = 0
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                # Bare text stands beside the blocks of the element it is in.
                top = stack[-1] if stack else PAGE
                alone = top.block in SINGLE
                out.append(Line(text, top.around, top.main, linked, top.block if alone else "", top.above if alone else top.own, top.footer))
        linked = 0

    def pop_to(depth: int) -> None:
        held.subtract(x.tag for x in stack[depth:])
        del stack[depth:]

    at, links = 0, 0
    while True:
        m = _TAG.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece:
            # Text ends a head that has no end tag, and so does a tag of the body.
            if stack and stack[-1].tag == "head" and piece.strip():
                flush()
                pop_to(len(stack) - 1)
            parts.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag) if held[tag] else None
            if tag == "a":
                links = 0
            if depth is not None:
                if any(x.tag in BLOCKS or x.other for x in stack[depth:]):
                    flush()
                pop_to(depth)
            elif tag in BLOCKS:
                flush()
            continue
        attrs = m[3] if m[2] else m[6]
        if tag == "head" and len(stack) > held["html"]:
            continue
        if stack and stack[-1].tag == "head" and tag not in IN_HEAD:
            flush()
            pop_to(len(stack) - 1)
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            parts.append(" ")
            continue
        top = stack[-1] if stack else PAGE
        other, part = _aside(tag, attrs, top.main)
        if tag in BLOCKS or other or part:
            flush()
        if tag in CLOSES_P or tag == "li":
            goal = "li" if tag == "li" else "p"
            for k in range(len(stack) - 1, -1, -1) if held[goal] else ():
                if stack[k].tag == goal:
                    pop_to(k)
                    break
                if stack[k].tag in BLOCKS and stack[k].tag != "p":
                    break
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        if tag == "a":
            links = 1
        serial += 1
        top = stack[-1] if stack else PAGE
        blocks = (tag, serial, top.own, top.footer or tag == "footer") if tag in BLOCKS else top[5:]
        stack.append(Open(tag, other, _around(top.around, tag, other, part), part, max(top.main, part), *blocks))
        held[tag] += 1
    flush()
    return out


def _settled(lines: list[Line]) -> list[Line]:
    """The lines with contested ones told to be clear or aside."""
    contested = sum(len(x.text) for x in lines if x.aside == CONTESTED)
    if contested:
        best = max((x.main for x in lines if not x.aside), default=0)
        clear = sum(len(x.text) for x in lines if not x.aside and x.main >= best and (best or x.linked <= LINKED * len(x.text)))
        now = CLEAR if contested > clear else ASIDE
        lines = [x._replace(aside=now) if x.aside == CONTESTED else x for x in lines]
    return lines


def _widened(lines: list[Line], kept: list[bool], chosen: list[int]) -> list[int]:
    """The lines that belong to the region of those chosen by surge and dive."""
    first, last = chosen[0], chosen[-1]
    parents = {lines[k].parent for k in chosen}
    out = [k for k in range(first, last + 1) if kept[k]]
    for way in (range(first - 1, -1, -1), range(last + 1, len(lines))):
        for k in way:
            x = lines[k]
            if x.aside and not x.footer:
                continue
            heading = x.tag in HEADINGS and k < first
            if not kept[k] or not (heading or x.tag and x.parent in parents):
                break
            out.append(k)
    return sorted(out)


def main_text(html: str | None) -> str:
    lines = _settled(lines_of(html or ""))
    marked = max((x.main for x in lines if not x.aside), default=0)
    sizes: list[int] = []
    owner: list[int] = []
    keep: list[bool] = []
    for k, x in enumerate(lines):
        menu = not marked and x.linked > LINKED * len(x.text)
        kept = not x.aside and not menu and x.main >= marked
        # What is aside parts the lines around it: a run of empty lines.
        sizes += [len(x.text)] if kept else [0] * WINDOW
        owner += [k] if kept else [k] * WINDOW
        keep.append(kept)
    window = [sum(sizes[k : k + WINDOW]) for k in range(len(sizes))]
    surge = min(SURGE_CHARS, (MARKED_PART if marked else SURGE_PART) * max(window, default=0))
    chosen, inside = [], False
    for k, size in enumerate(sizes):
        if not inside and size and window[k] > surge:
            inside = True
        elif inside and not window[k]:
            inside = False
        if inside and size:
            chosen.append(owner[k])
    if chosen:
        chosen = _widened(lines, keep, chosen)
    return "\n".join(lines[k].text for k in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages(page_id, url, html)``."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return spread(pages.select("page_id", "url", F.col("html").cast("string").alias("html"))).mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
