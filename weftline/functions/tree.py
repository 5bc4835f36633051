"""An HTML tree builder and its rows.

Builds the tree that the HTML standard asks for in the cases that pages hold in
practice: html, head and body are made where missing, void and raw-text elements
are known, end tags are implied, formatting elements are opened again in later
blocks, and stray end tags are ignored (a stray ``</p>`` makes an empty p).  It
never fails: what is left open at the end of the input is closed.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from html import unescape

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style iframe noscript noembed noframes xmp".split())
ESCAPABLE_RAW_TEXT = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu "
    "nav ol p pre search section summary table ul".split())
#: What an open element of the key is closed by, and where the search stops.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
TABLE_PARTS = frozenset("tr thead tbody tfoot td th caption".split())
SCOPE = frozenset("html table td th caption button object template".split())

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'>/][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element; its children are nodes, strings (text) and comments."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def add(self, child: Node | str | Comment) -> None:
        if isinstance(child, str) and self.children and isinstance(self.children[-1], str):
            self.children[-1] += child
            return
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def texts(self) -> list[str]:
        """All text nodes below, in document order."""
        out: list[str] = []
        todo: list = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif isinstance(node, Node):
                todo.extend(reversed(node.children))
        return out

    def text(self, joined: str = "") -> str:
        return joined.join(self.texts())

    def walk(self) -> Iterator[Node]:
        """This element and all below, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.elements))

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def html(self) -> str:
        """Serialised: attributes in double quotes, text escaped."""
        out: list[str] = []
        todo: list = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                out.append(node[0])
            elif isinstance(node, Comment):
                out.append(f"<!--{node.text}-->")
            elif isinstance(node, str):
                out.append(node.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\xa0", "&nbsp;"))
            else:
                attrs = "".join(f' {k}="{escape_attribute(v)}"' for k, v in node.attrs.items())
                out.append(f"<{node.tag}{attrs}>")
                if node.tag in VOID:
                    continue
                todo.append((f"</{node.tag}>",))
                if node.tag in RAW_TEXT:
                    out.append(node.text())
                else:
                    todo.extend(reversed(node.children))
        return "".join(out)


def unrolled(first: Generator) -> object:
    """What a recursion returns that is written as generators, each of which
    yields the generator of a call and is sent its result: an explicit stack, so
    that no page nests too deep."""
    stack, value = [first], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


class Comment:
    __slots__ = ("text",)

    def __init__(self, text: str) -> None:
        self.text = text


def escape_attribute(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;").replace("\xa0", "&nbsp;")


def attributes(source: str) -> dict[str, str]:
    """The first value of each name; names in lower case."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


class _Builder:
    def __init__(self) -> None:
        self.html = Node("html")
        self.head: Node | None = None
        self.body: Node | None = None
        self.open: list[Node] = [self.html]
        self.formatting: list[Node] = []  # opened and not closed, oldest first

    @property
    def top(self) -> Node:
        return self.open[-1]

    def push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.top.add(node)
        self.open.append(node)
        return node

    def need_head(self) -> None:
        if self.head is None:
            self.head = self.push("head", {})

    def need_body(self) -> None:
        if self.body is None:
            self.need_head()
            del self.open[1:]
            self.body = self.push("body", {})

    def depth_of(self, tags, stop=SCOPE) -> int | None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                return k
            if self.open[k].tag in stop:
                return None
        return None

    def close_from(self, depth: int) -> None:
        del self.open[max(depth, 2 if self.body in self.open else 1):]

    def reopen(self) -> None:
        """Open again the formatting elements that a block's end has closed."""
        for k, node in enumerate(self.formatting):
            if not any(x is node for x in self.open):
                self.formatting[k] = self.push(node.tag, dict(node.attrs))

    def text(self, text: str) -> None:
        if self.body is None:
            if self.head is not None and self.top.tag in HEAD_ONLY:
                self.top.add(text)
                return
            if not text.strip():
                return
            self.need_body()
            text = text.lstrip()
        if text.strip() and self.formatting:
            self.reopen()
        self.top.add(text)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "html":
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
            return
        if tag == "head":
            if self.head is None:
                self.need_head()
                self.head.attrs.update(attrs)
            return
        if tag == "body":
            self.need_body()
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)
            return
        if self.body is None:
            if tag in HEAD_ONLY:
                self.need_head()
            else:
                self.need_body()
        if tag in CLOSES_P:
            at = self.depth_of({"p"})
            if at is not None:
                self.close_from(at)
            if tag in HEADINGS and self.top.tag in HEADINGS:
                self.open.pop()
        if tag in SIBLINGS:
            closes, stop = SIBLINGS[tag]
            at = self.depth_of(closes, stop | {"html", "body"})
            while at is not None:
                self.close_from(at)
                at = self.depth_of(closes, stop | {"html", "body"}) if tag in ("tr", "thead", "tbody", "tfoot", "optgroup") else None
            if tag == "tr" and self.top.tag == "table":
                self.push("tbody", {})
            if tag in ("td", "th") and self.top.tag == "table":
                self.push("tbody", {})
            if tag in ("td", "th") and self.top.tag in ("tbody", "thead", "tfoot"):
                self.push("tr", {})
        elif tag not in CLOSES_P and tag not in HEAD_ONLY:
            if tag == "a":
                self.end("a")
            self.reopen()
        node = self.push(tag, attrs)
        if tag in VOID or closed and self.body is None and tag in HEAD_ONLY:
            self.open.pop()
        elif tag in FORMATTING:
            # Three alike are as many as the standard keeps.
            alike = [n for n in self.formatting if n.tag == tag and n.attrs == attrs]
            if len(alike) >= 3:
                self.formatting.remove(alike[0])
            self.formatting.append(node)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.body is None and self.head is not None:
                del self.open[1:]
            return
        if tag == "br":
            self.start("br", {}, False)
            return
        if tag in FORMATTING:
            at = next((n for n in reversed(self.formatting) if n.tag == tag), None)
            if at is None:
                return
            self.formatting.remove(at)
            depth = next((k for k in range(len(self.open)) if self.open[k] is at), None)
            if depth is not None:
                block = next((k for k in range(depth + 1, len(self.open)) if self.open[k].tag in CLOSES_P or self.open[k].tag in SIBLINGS), None)
                if block is None:
                    self.close_from(depth)
            return
        if tag in HEADINGS:
            at = self.depth_of(HEADINGS)
        elif tag == "p":
            at = self.depth_of({"p"})
            if at is None:
                self.need_body()
                self.top.add(Node("p"))
                return
        else:
            stop = {"html", "table"} - {tag} if tag in TABLE_PARTS else {"html"} if tag in SCOPE else SCOPE | {"html"}
            at = self.depth_of({tag}, stop)
        if at is not None and self.open[at] not in (self.html, self.body, self.head):
            self.close_from(at)


def parse(source: str | None) -> Node:
    """The html element of ``source``."""
    source = source or ""
    build, at = _Builder(), 0
    while True:
        m = _TOKEN.search(source, at)
        piece = source[at : m.start() if m else len(source)]
        if piece:
            build.text(unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["comment"] is not None:
                build.top.add(Comment(m["comment"]))
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            build.end(tag)
            continue
        own = (m["attrs"] if m["tag"] else m["attrs2"]) or ""
        build.start(tag, attributes(own) if own else {}, own.endswith("/"))
        if tag in RAW_TEXT or tag in ESCAPABLE_RAW_TEXT:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            raw = source[at : stop.start() if stop else len(source)]
            if raw:
                build.top.add(unescape(raw) if tag in ESCAPABLE_RAW_TEXT else raw)
            at = stop.end() if stop else len(source)
            if build.top.tag == tag:
                build.open.pop()
    build.need_body()
    return build.html


def path_token(node: Node) -> str:
    if "id" in node.attrs:
        return f"{node.tag}#{node.attrs['id']}"
    return f"{node.tag}.{node.classes[0]}" if node.classes else node.tag


def rows(root: Node, wanted: frozenset[str] | None = None) -> list[dict]:
    """A row for each element in document order.  An element d lies below a if
    a.pre < d.pre <= a.post.  Texts of subtrees are gathered only if ``wanted``
    (None: all) names them."""
    out: list[dict] = []
    with_text = wanted is None or not wanted.isdisjoint(("text", "text_concat"))

    def visit(node: Node, parent: dict | None, index: int) -> None:
        stack = [(node, parent, index, False)]
        while stack:
            n, up, k, done = stack.pop()
            if done:
                up["post"] = len(out) - 1
                continue
            elements = n.elements
            row = {
                "pre": len(out), "parent_pre": up["pre"] if up else None, "depth": up["depth"] + 1 if up else 0, "child_index": k,
                "tag": n.tag, "attrs": list(n.attrs.items()), "classes": n.classes,
                "own_text": "".join(c for c in n.children if isinstance(c, str)), "n_child_nodes": len(n.children), "n_child_elements": len(elements),
                "parent_tag": up["tag"] if up else None, "path": [*up["path"], n.tag] if up else [n.tag],
                "ancestors": [*up["ancestors"], up["pre"]] if up else [], "tokens": [*up["tokens"], path_token(n)] if up else [path_token(n)],
            }
            if with_text:
                texts = n.texts()
                row["text"], row["text_concat"] = " ".join(texts), "".join(texts)
            row["selector_path"] = f"#{n.attrs['id']}" if "id" in n.attrs else " > ".join(row["tokens"])
            out.append(row)
            if elements:
                stack.append((n, row, 0, True))
                stack.extend((c, row, j, False) for j, c in reversed(list(enumerate(elements))))
            else:
                row["post"] = row["pre"]

    visit(root, None, 0)
    return out
