"""Cleaning of page sources: columns to columns, and, where the tree decides,
page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions import tree
from weftline.functions.pages import per_page
from weftline.functions.text import c, clean_whitespace
from weftline.operators.dom import BOILERPLATE, MAIN_CONTENT

# What is removed, rewritten and renamed.
REMOVED = ("script", "style", "iframe", "noscript", "svg")
SEMANTIC = {
    "nav": "navigation|menu|nav", "header": "header|masthead|site-header", "footer": "footer|site-footer", "main": "main|content|main-content",
    "article": "article|post|entry", "section": "section",
}
BOOLEAN = ("checked", "selected", "disabled", "readonly", "required", "multiple", "hidden")
EVENTS = ("onclick", "onmouseover", "onmouseout", "onchange", "onsubmit", "onload")
SECTIONS = "section|article|main|header|footer|nav|aside"
BASE = "https://example.com/"


def remove_elements(html: Column | str) -> Column:
    out = c(html)
    for tag in REMOVED:
        out = F.regexp_replace(out, f"(?s)<{tag}[^>]*>.*?</{tag}>", "")
    return F.regexp_replace(out, r"<link[^>]*rel=[\"']stylesheet[\"'][^>]*>", "")


def simplify_structures(html: Column | str) -> Column:
    """Four directly nested divs become one, three spans become one."""
    div, span = r"<div[^>]*>\s*", r"<span[^>]*>\s*"
    out = F.regexp_replace(c(html), div * 3 + r"<div[^>]*>(.*?)</div>\s*</div>\s*</div>\s*</div>", "<div>$1</div>")
    return F.regexp_replace(out, span * 2 + r"<span[^>]*>(.*?)</span>\s*</span>\s*</span>", "<span>$1</span>")


def enhance_semantics(html: Column | str) -> Column:
    out = c(html)
    for tag, names in SEMANTIC.items():
        out = F.regexp_replace(out, f'<div[^>]*class="[^"]*(?:{names})[^"]*"[^>]*>(.*?)</div>', f"<{tag}>$1</{tag}>")
    out = F.regexp_replace(out, "<main([^>]*)>", '<main$1 role="main">')
    return F.regexp_replace(out, "<nav([^>]*)>", '<nav$1 role="navigation">')


def normalize_attributes(html: Column | str, base: str = BASE) -> Column:
    out = c(html)
    for name in BOOLEAN:
        out = F.regexp_replace(out, f'{name}="[^"]*"', name)
    for name in EVENTS:
        out = F.regexp_replace(out, f'{name}="([^"]*)"', f'data-event-{name}="$1"')
    return F.regexp_replace(out, '(href|src)="(?!http|#|data:)/?([^"]+)"', f'$1="{base}$2"')


def add_context_clues(html: Column | str) -> Column:
    out = F.regexp_replace(c(html), r"<a(?![^>]*aria-)([^>]*)>([^<]*)</a>", '<a$1 aria-description="Link to: $2">$2</a>')
    out = F.regexp_replace(out, f"<({SECTIONS})([^>]*)>", "<!-- Begin $1 --><$1$2>")
    return F.regexp_replace(out, f"</({SECTIONS})>", "</$1><!-- End $1 -->")


def preprocess(html: Column | str, mode: str = "standard") -> Column:
    """The rewriting steps in order; ``minimal`` leaves them out.  Parsing and
    serialising (``fix_unclosed``) is a step of its own, as it needs the tree."""
    if mode == "minimal":
        return c(html)
    return normalize_attributes(enhance_semantics(simplify_structures(remove_elements(html))))


def _matcher(selectors: list[str]):
    """Whether a node matches one of simple selectors (tag, #id, .class, role)."""
    tags = {s for s in selectors if s[0] not in "#.["}
    ids = {s[1:] for s in selectors if s[0] == "#"}
    classes = {s[1:] for s in selectors if s[0] == "."}
    roles = {s[6:-1] for s in selectors if s.startswith("[role=")}
    return lambda n: n.tag in tags or n.attrs.get("id") in ids or not classes.isdisjoint(n.classes) or n.attrs.get("role") in roles


def _visible_text(root: tree.Node) -> str:
    parts: list[str] = []
    todo: list = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            parts.append(node)
        elif isinstance(node, tree.Node) and node.tag not in ("script", "style"):
            todo.extend(reversed(node.children))
    return " ".join(" ".join(parts).split())


def _without(root: tree.Node, drop) -> tree.Node:
    for node in list(root.walk()):
        node.children = [x for x in node.children if not (isinstance(x, tree.Node) and drop(x))]
    return root


def fix_unclosed(pages: DataFrame) -> DataFrame:
    """(page_id, html): parsed and serialised again."""
    return per_page(pages, lambda html: [{"html": tree.parse(html).html()}], "html string")


def html_to_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): all text but that of scripts and styles."""
    return per_page(pages, lambda html: [{"text": _visible_text(tree.parse(html))}], "text string")


def remove_boilerplate(pages: DataFrame) -> DataFrame:
    """(page_id, html) without the subtrees that are no content."""
    drop = _matcher(BOILERPLATE)
    return per_page(pages, lambda html: [{"html": _without(tree.parse(html), drop).html()}], "html string")


def find_main(root: tree.Node) -> tree.Node | None:
    nodes = list(root.walk())
    for selector in MAIN_CONTENT:
        test = _matcher([selector])
        found = next((n for n in nodes if test(n)), None)
        if found is not None:
            return found
    return None


def main_content_html(pages: DataFrame) -> DataFrame:
    """(page_id, html): the first known main element, else body."""

    def run(html: str):
        root = tree.parse(html)
        return [{"html": (find_main(root) or root.find("body")).html()}]

    return per_page(pages, run, "html string")


def extract_text(html: Column | str) -> Column:
    """Text by patterns alone: tags go, white space collapses."""
    bare = F.regexp_replace(c(html), r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return clean_whitespace(F.regexp_replace(bare, "<[^>]+>", " "))
