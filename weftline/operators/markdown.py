"""Pages as Markdown with semantic marks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Generator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weftline.functions import tree
from weftline.functions.pages import per_page

# Levels, marks and what is skipped.
LEVELS = ("none", "basic", "standard", "extended", "full")
MAIN = "main|article|[role=main]|#content|.content|#main|.main|.post|.article|.entry".split("|")
SKIPPED_TAGS = frozenset("script style noscript iframe svg nav footer aside template head".split())
SKIPPED_CLASSES = frozenset("ad ads advertisement banner sidebar menu social share comments cookie-notice popup modal newsletter related".split())
HIDDEN_WORDS = ("hidden", "hide", "invisible")
INLINE = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~", "mark": "=="}


@dataclass(frozen=True)
class Options:
    semantic_labels: bool = True
    reference_links: bool = False
    heading_ids: bool = False
    max_heading_level: int = 6
    metadata_level: str = "basic"
    main_content_only: bool = True
    keep_query: bool = False
    github_breaks: bool = False
    max_width: int | None = None
    post_process: Callable[[str], str] | None = None
    custom_handlers: dict[str, str] = field(default_factory=dict)


def metadata(root: tree.Node) -> dict[str, str]:
    """Title, description and the like, also from JSON-LD where still missing."""
    out: dict[str, str] = {}
    title = root.find("title")
    if title is not None and title.text().strip():
        out["title"] = title.text().strip()
    names = {
        "description": "description", "keywords": "keywords", "author": "author", "og:title": "og_title", "og:description": "og_description", "og:type": "og_type",
        "article:published_time": "published_date", "article:modified_time": "modified_date",
    }
    for n in root.walk():
        if n.tag == "meta" and "content" in n.attrs:
            key = n.attrs.get("name") or n.attrs.get("property") or ""
            if key in names:
                out.setdefault(names[key], n.attrs["content"])
        elif n.tag == "link" and n.attrs.get("rel") == "canonical" and "href" in n.attrs:
            out.setdefault("canonical_url", n.attrs["href"])
        elif n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            try:
                data = json.loads(n.text())
            except ValueError:
                continue
            for key, name in (("headline", "title"), ("name", "title"), ("description", "description"), ("datePublished", "published_date"), ("dateModified", "modified_date")):
                if isinstance(data, dict) and isinstance(data.get(key), str):
                    out.setdefault(name, data[key])
    if "lang" in root.attrs:
        out["language"] = root.attrs["lang"]
    return out


LEVEL_FIELDS = (
    (), ("title", "description"), ("author", "published_date", "language"), ("keywords", "modified_date", "canonical_url"),
    ("og_title", "og_description", "og_type"))


def front_matter(data: dict[str, str], level: str) -> str:
    names = [n for fields in LEVEL_FIELDS[: LEVELS.index(level) + 1] for n in fields]
    lines = [f'{n}: "{escape_yaml(data[n])}"' for n in names if n in data]
    return "---\n" + "\n".join(lines) + "\n---\n\n" if lines else ""


def escape_yaml(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", " ")


def slug(text: str) -> str:
    return re.sub(r"[\W_]+", "-", text.lower()).strip("-")


class _Writer:
    def __init__(self, options: Options) -> None:
        self.o = options
        self.links: dict[str, str] = {}
        self.images: dict[str, str] = {}

    def reference(self, table: dict[str, str], url: str, text: str, plain: str) -> str:
        """The reference of a url: initials of its first text, made distinct."""
        if url not in table:
            base = "".join(w[0] for w in text.split()[:3]).lower() or f"{plain}{len(table) + 1}"
            name, k = base, 2
            while name in table.values():
                name, k = f"{base}-{k}", k + 1
            table[url] = name
        return table[url]

    def skipped(self, n: tree.Node) -> bool:
        style, own = n.attrs.get("style", "").replace(" ", ""), n.attrs.get("class", "")
        return (
            n.tag in SKIPPED_TAGS or not SKIPPED_CLASSES.isdisjoint(n.classes) or "hidden" in n.attrs or "display:none" in style or "visibility:hidden" in style
            or any(w in own for w in HIDDEN_WORDS))

    # Methods that call one another are generators for ``tree.unrolled``.
    def inline(self, n: tree.Node) -> Generator:
        pieces = []
        for c in n.children:
            pieces.append((yield self.piece(c)))
        return re.sub(r"\s+", " ", "".join(pieces)).strip()

    def piece(self, c) -> Generator:
        """A child within a line."""
        if isinstance(c, str):
            return re.sub(r"\s+", " ", c)
        if not isinstance(c, tree.Node) or self.skipped(c):
            return ""
        text = yield self.inline(c)
        if c.tag in self.o.custom_handlers:
            return self.o.custom_handlers[c.tag].format(text=text, **{k.replace("-", "_"): v for k, v in c.attrs.items()})
        if c.tag == "br":
            return "  \n" if self.o.github_breaks else " "
        if c.tag == "img":
            return self.image(c)
        if not text:
            return ""
        if c.tag in INLINE:
            return f"{INLINE[c.tag]}{text}{INLINE[c.tag]}"
        if c.tag == "a":
            return self.link(c, text)
        if c.tag == "code":
            return f"`{text}`"
        if c.tag in ("sub", "sup"):
            return f"{'~' if c.tag == 'sub' else '^'}{text}{'~' if c.tag == 'sub' else '^'}"
        if c.tag == "q":
            return f'"{text}"'
        if c.tag == "cite":
            return f"*{text}*"
        if c.tag == "abbr" and c.attrs.get("title"):
            return f"{text} ({c.attrs['title']})"
        if c.tag == "span":
            if not {"bold", "strong"}.isdisjoint(c.classes):
                return f"**{text}**"
            if not {"italic", "emphasis"}.isdisjoint(c.classes):
                return f"*{text}*"
        return f" {text} " if c.tag in tree.CLOSES_P else text

    def link(self, n: tree.Node, text: str) -> str:
        href = n.attrs.get("href", "")
        if not href or href == "#":
            return text
        href = href if self.o.keep_query else href.split("?", 1)[0]
        if self.o.reference_links:
            return f"[{text}][{self.reference(self.links, href, text, 'link')}]"
        title = f' "{n.attrs["title"]}"' if n.attrs.get("title") else ""
        return f"[{text}]({href}{title})"

    def image(self, n: tree.Node) -> str:
        src, alt = n.attrs.get("src", ""), n.attrs.get("alt", "")
        if not src:
            return ""
        mark = f" [IMAGE: {alt}]" if self.o.semantic_labels and alt else ""
        if self.o.reference_links:
            return f"![{alt}][{self.reference(self.images, src, alt, 'img')}]"
        return f"![{alt}]({src}){mark}"

    def blocks(self, n: tree.Node) -> Generator:
        """The blocks of a node's children; runs of inline children make one."""
        out: list[str] = []
        line: list[str] = []

        def end() -> None:
            text = re.sub(r"[ \t]+", " ", "".join(line)).strip()
            line.clear()
            if text:
                out.append(text)

        for c in n.children:
            if isinstance(c, tree.Node) and (c.tag in tree.CLOSES_P or c.tag in ("table", "li", "dt", "dd", "figcaption", "summary", "body", "main")):
                end()
                if not self.skipped(c):
                    out += yield self.block(c)
            else:
                line.append((yield self.piece(c)))
        end()
        return out

    def block(self, n: tree.Node) -> Generator:
        label = self.o.semantic_labels
        if n.tag in self.o.custom_handlers:
            return [(yield self.piece(n))]
        if n.tag in tree.HEADINGS:
            level, text = int(n.tag[1]), (yield self.inline(n))
            if not text:
                return []
            mark = ("[TITLE] " if level == 1 else "[SECTION] ") if label else ""
            tail = f" {{#{slug(text)}}}" if self.o.heading_ids else ""
            return [f"{'#' * min(level, self.o.max_heading_level)} {mark}{text}{tail}"]
        if n.tag == "p":
            text = yield self.inline(n)
            return [text] if text else []
        if n.tag == "hr":
            return ["[DIVIDER]\n\n---" if label else "---"]
        if n.tag in ("ul", "ol", "menu"):
            text = "\n".join((yield self.items(n, 0)))
            mark = "[ORDERED_LIST]" if n.tag == "ol" else "[LIST]"
            return [f"{mark}\n\n{text}" if label else text] if text else []
        if n.tag == "dl":
            lines = []
            for c in n.elements:
                if c.tag in ("dt", "dd"):
                    lines.append((": " if c.tag == "dd" else "[TERM] " if label else "") + (yield self.inline(c)))
            return ["\n".join((["[DEFINITION_LIST]", ""] if label else []) + lines)] if lines else []
        if n.tag == "pre":
            code = n.find("code")
            names = [x.removeprefix("language-").removeprefix("lang-") for x in (code or n).classes if x.startswith(("language-", "lang-"))]
            return [f"```{names[0] if names else ''}\n{n.text().strip(chr(10))}\n```"]
        if n.tag == "blockquote":
            inner = "\n\n".join((yield self.blocks(n)))
            quoted = "\n".join(f"> {x}" if x else ">" for x in inner.split("\n"))
            return [f"[QUOTE]\n\n{quoted}" if label else quoted] if inner else []
        if n.tag == "table":
            return [t] if (t := (yield self.table(n))) else []
        if n.tag == "figure":
            return (["[FIGURE]"] if label else []) + (yield self.blocks(n))
        if n.tag == "figcaption":
            return [("[CAPTION] " if label else "") + (yield self.inline(n))]
        if n.tag == "summary":
            return [f"**{(yield self.inline(n))}**"]
        if n.tag == "div" and not {"code", "highlight"}.isdisjoint(n.classes):
            return [f"```\n{n.text().strip()}\n```"]
        if n.tag == "div" and not {"quote", "blockquote"}.isdisjoint(n.classes):
            text = yield self.inline(n)
            return [f"> {text}"] if text else []
        return (yield self.blocks(n))

    def items(self, n: tree.Node, depth: int) -> Generator:
        out = []
        first = int(n.attrs["start"]) if re.fullmatch(r"-?\d+", n.attrs.get("start", "")) else 1
        for k, li in enumerate((c for c in n.elements if c.tag == "li"), first):
            own = tree.Node("li")
            own.children = [c for c in li.children if not (isinstance(c, tree.Node) and c.tag in ("ul", "ol", "menu"))]
            mark = f"{k}." if n.tag == "ol" else "-"
            out.append(f"{'  ' * depth}{mark} {(yield self.inline(own))}")
            for c in li.elements:
                if c.tag in ("ul", "ol", "menu"):
                    out += yield self.items(c, depth + 1)
        return out

    def table(self, n: tree.Node) -> Generator:
        rows, align, head = [], {}, None
        for tr in (x for x in n.walk() if x.tag == "tr"):
            cells = [c for c in tr.elements if c.tag in ("td", "th")]
            if not cells:
                continue
            for k, c in enumerate(cells):
                found = c.attrs.get("align") or (re.search(r"text-align:\s*(\w+)", c.attrs.get("style", "")) or [None, None])[1]
                if found:
                    align.setdefault(k, found)
            if head is None and (tr.parent.tag == "thead" or all(c.tag == "th" for c in cells)):
                head = len(rows)
            row = []
            for c in cells:
                row.append((yield self.inline(c)).replace("|", "\\|"))
            rows.append(row)
        if not rows:
            return ""
        rows.insert(0, rows.pop(head or 0))
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        size = [max(3, *(len(r[k].encode()) for r in rows)) for k in range(width)]
        line = lambda r: "| " + " | ".join(x + " " * (size[k] - len(x.encode())) for k, x in enumerate(r)) + " |"
        rule = [{"left": ":" + "-" * (s - 1), "right": "-" * (s - 1) + ":", "center": ":" + "-" * (s - 2) + ":"}.get(align.get(k), "-" * s) for k, s in enumerate(size)]
        caption = n.find("caption")
        named = "" if caption is None else (yield self.inline(caption))
        lead = f"**{named}**\n\n" if named else ""
        return lead + "\n".join([line(rows[0]), line(rule), *map(line, rows[1:])])


def wrap(text: str, width: int) -> str:
    """Greedy wrapping of long lines at spaces, by bytes."""
    out = []
    for line in text.split("\n"):
        now = ""
        for word in line.split(" "):
            if now and len(now.encode()) + 1 + len(word.encode()) > width:
                out.append(now)
                now = word
            else:
                now = f"{now} {word}" if now else word
        out.append(now)
    return "\n".join(out)


def _select(root: tree.Node, selectors: list[str]) -> tree.Node | None:
    nodes = list(root.walk())
    for s in selectors:
        for n in nodes:
            hit = s[1:] in n.classes if s[0] == "." else n.attrs.get("id") == s[1:] if s[0] == "#" else n.attrs.get("role") == s[6:-1] if s[0] == "[" else n.tag == s
            if hit:
                return n
    return None


def to_markdown(html: str, options: Options = Options()) -> str:
    root = tree.parse(html)
    body = root.find("body")
    node = body
    if options.main_content_only:
        node = _select(body, MAIN)
        if node is None:
            scored = [(len(n.text().encode()) * (1 + sum(x.tag == "p" for x in n.walk())), n) for n in body.walk() if n.tag in ("p", "article", "section")]
            node = max(scored, key=lambda x: x[0], default=(0, body))[1]
    writer = _Writer(options)
    blocks = tree.unrolled(writer.block(node) if node.tag in tree.CLOSES_P else writer.blocks(node))
    for table, lead in ((writer.links, ""), (writer.images, "")):
        if table:
            blocks.append("\n".join(f"[{name}]: {lead}{url}" for url, name in sorted(table.items(), key=lambda x: x[1])))
    text = re.sub(r"\n{3,}", "\n\n", "\n\n".join(b for b in blocks if b)).strip()
    if options.max_width:
        text = wrap(text, options.max_width)
    text = front_matter(metadata(root), options.metadata_level) + text + "\n"
    return options.post_process(text) if options.post_process else text


def markdown(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """(page_id, markdown) of each page (page_id, html)."""
    return per_page(pages, lambda html: [{"markdown": to_markdown(html, options)}], "markdown string")
