"""Token-bounded chunks of pages, with importance, relations and context.

Packing is a fold over a page's elements in order, so it runs page by page in
Python; scores, neighbours and texts for prompts are columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions import tree
from weftline.functions.pages import per_page
from weftline.functions.text import c, clip_bytes, ellipsis, strip_tags

# Limits, tag groups, scores and separators.
MAX_DOCUMENT = 100_000
SECTION_TAGS = "body article section div main aside nav header footer form table".split()
PRIORITY = ("main", "article", ".content", "#content", ".main-content")
PRESERVED = frozenset("article section table form figure pre".split())
TAG_BONUS = {"main": 0.4, "article": 0.3, "section": 0.2, "header": -0.1, "footer": -0.2, "aside": -0.1, "nav": -0.2}
INTERACTIVE_MARKS = "<button|<input|<a |<select|<textarea|onclick=|role=\"button\""
CHUNK_TAGS = frozenset("main article section nav aside header footer div form table ul ol dl".split())
CHUNK_WORDS = "content main article post entry page section container wrapper product item card result".split()
TYPE_BY_TAG = {
    "html": "Document", "table": "Table", "ul": "List", "ol": "List", "dl": "List", "form": "Form", "nav": "Navigation", "header": "Header",
    "footer": "Footer", "main": "MainContent", "article": "MainContent", "aside": "Sidebar",
}
BASE_IMPORTANCE = {
    "Document": 1.0, "MainContent": 0.9, "Element": 0.5, "Table": 0.7, "List": 0.6, "Form": 0.7, "Navigation": 0.4, "Header": 0.5, "Footer": 0.3,
    "Sidebar": 0.4, "Text": 0.5,
}
BLOCK_ENDS = re.compile("</(?:div|p|section|article|main|header|footer|nav)>")
SPLIT_ENDS = re.compile("</(?:p|div|section|article|li|table|tr|form|fieldset)>")
BREAKS = re.compile(r"[\s.;,>)]")


@dataclass(frozen=True)
class Options:
    """Sizes are in tokens as ``count`` estimates them."""

    strategy: str = "semantic"
    max_tokens: int = 8000
    min_tokens: int = 1000
    overlap: int = 200
    max_chunks: int | None = None

    @staticmethod
    def count(text: str) -> int:
        return len(text) // 4 + 1


def strategy_of(name: str) -> str:
    """A known strategy; anything else is semantic."""
    return name.lower() if name.lower() in ("size", "semantic", "hierarchical", "adaptive") else "semantic"


def _chunk(content: str, start: int, kind: str = "Element", importance: float = 0.5, depth: int = 0, parent: int | None = None) -> dict:
    return {"content": content, "start": start, "content_type": kind, "importance": importance, "depth": depth, "parent_index": parent}


def by_characters(text: str, o: Options, offset: int = 0) -> list[dict]:
    """Windows of about ``max_tokens``, cut back to a break, overlapping."""
    sample = text[:1000]
    per_token = len(sample) / o.count(sample) if sample else 4.0
    size, back = max(1, int(o.max_tokens * per_token)), int(o.overlap * per_token)
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            at = [m.end() for m in BREAKS.finditer(text, max(start, end - 20), end)]
            end = at[-1] if at and at[-1] > start else end
        out.append(_chunk(text[start:end], offset + start))
        start = end if end >= len(text) else max(start + 1, end - back)
    return out


def balance(html: str) -> str:
    """Close what ``html`` leaves open; stray ends stay."""
    open_: list[str] = []
    for m in re.finditer(r"<(/?)([a-zA-Z][\w-]*)[^>]*?(/?)>", html):
        tag = m[2].lower()
        if m[1]:
            if tag in open_:
                del open_[len(open_) - 1 - open_[::-1].index(tag) :]
        elif not m[3] and tag not in tree.VOID:
            open_.append(tag)
    return html + "".join(f"</{t}>" for t in reversed(open_))


def split_large(html: str, o: Options) -> list[tuple[int, str]]:
    """(offset, piece) of an element that is too large for one chunk."""
    points = [m.end() for m in SPLIT_ENDS.finditer(html)]
    if len(points) < 2:
        sample = html[:1000]
        per_token = len(sample) / o.count(sample) if sample else 4.0
        size = max(1, int(o.max_tokens * per_token))
        step = max(1, size - int(o.overlap * per_token))
        for at in range(size, len(html), step):
            low = max(0, at - 50)
            window = html[low : at + 50]
            cut = next((window.rfind(s) + len(s) for s in (">", ". ", "\n\n", "\n", " ") if s in window), None)
            points.append(low + cut if cut else at)
    out, start = [], 0
    for point in sorted(points):
        if point > start and o.count(html[start:point]) <= o.max_tokens:
            out.append((start, html[start:point]))
            start = max(start + 1, point - o.overlap)
    if start < len(html):
        rest = html[start:]
        size = max(1, o.max_tokens * 4)
        out += [(start, rest)] if o.count(rest) <= o.max_tokens else [(start + k, rest[k : k + size]) for k in range(0, len(rest), size)]
    return [(k, balance(x)) for k, x in out]


def pack(parts: list[tuple[str, str]], o: Options, kind_of=None) -> list[dict]:
    """Greedy packing of (kind, html) in order; too large parts are split."""
    out: list[dict] = []
    held: list[tuple[str, str]] = []
    start = at = tokens = 0

    def flush() -> None:
        nonlocal held, tokens, start
        if held:
            kind = kind_of([k for k, _ in held]) if kind_of else "Element"
            out.append(_chunk("".join(h for _, h in held), start, kind))
        held, tokens, start = [], 0, at

    for kind, html in parts:
        n = o.count(html)
        if n > o.max_tokens:
            flush()
            out.extend(_chunk(piece, at + k, kind_of([kind]) if kind_of else "Element") for k, piece in split_large(html, o))
            at += len(html)
            start = at
            continue
        if tokens + n > o.max_tokens and tokens >= o.min_tokens:
            flush()
        held.append((kind, html))
        tokens += n
        at += len(html)
    flush()
    return out


def _basic(html: str, o: Options) -> list[dict]:
    """Without elements to pack: cut after the ends of blocks."""
    points = [m.end() for m in BLOCK_ENDS.finditer(html)]
    if not points:
        return by_characters(html, o)
    out, start = [], 0
    for point in points:
        n = o.count(html[start:point])
        if o.min_tokens <= n <= o.max_tokens:
            out.append(_chunk(html[start:point], start))
            start = point
        elif n > o.max_tokens:
            out += by_characters(html[start:point], o, start)
            start = point
    if start < len(html):
        rest = html[start:]
        out += [_chunk(rest, start)] if o.count(rest) <= o.max_tokens else by_characters(rest, o, start)
    return out


def by_size(html: str, o: Options) -> list[dict]:
    body = tree.parse(html).find("body")
    return pack([("element", e.html()) for e in body.elements], o) if body.elements else _basic(html, o)


def _section_kind(kinds: list[str]) -> str:
    single = {"main": "MainContent", "article": "MainContent", "section": "Element", "content": "MainContent", "nav": "Navigation",
              "header": "Header", "footer": "Footer", "aside": "Sidebar", "form": "Form", "table": "Table"}
    if len(kinds) == 1:
        return single.get(kinds[0], "Element")
    return next((single[k] for k in ("main", "article", "section", "content") if k in kinds), "Element")


def by_semantics(html: str, o: Options) -> list[dict]:
    """Topmost sections below body; what lies between them is content."""
    names = frozenset("main article section nav header footer aside form table".split())
    parts: list[tuple[str, str]] = []

    def visit(node: tree.Node):
        for child in node.children:
            if isinstance(child, tree.Node) and child.tag in names:
                parts.append((child.tag, child.html()))
            elif isinstance(child, tree.Node) and any(n.tag in names for n in child.walk()):
                yield visit(child)
            elif isinstance(child, tree.Node):
                parts.append(("content", child.html()))
            elif isinstance(child, str) and child.strip():
                parts.append(("content", child))

    tree.unrolled(visit(tree.parse(html).find("body")))
    return pack(parts, o, _section_kind) if parts else by_size(html, o)


def _node_kind(node: tree.Node) -> str:
    if node.tag in TYPE_BY_TAG:
        return TYPE_BY_TAG[node.tag]
    cls, role = node.attrs.get("class", ""), node.attrs.get("role", "")
    for kind, words, name in (
        ("Navigation", ("nav",), "navigation"), ("MainContent", ("main", "content"), "main"), ("Sidebar", ("sidebar",), "complementary"),
        ("Header", ("header",), "banner"), ("Footer", ("footer",), "contentinfo")):
        if role == name or any(w in cls for w in words):
            return kind
    return "Element"


def _node_importance(node: tree.Node, kind: str) -> float:
    text, score = node.text(), BASE_IMPORTANCE.get(kind, 0.5)
    links = sum(n.tag == "a" for n in node.walk())
    score += 0.1 if any(n.tag in tree.HEADINGS for n in node.walk()) else 0.0
    size = len(text.encode())
    score -= 0.1 if size and links / (size / 100) > 5 else 0.0
    return round(max(0.1, min(1.0, score)), 6)


def by_hierarchy(html: str, o: Options) -> list[dict]:
    """A tree of chunks along the tree of elements."""
    out: list[dict] = []

    def wanted(node: tree.Node, n: int) -> bool:
        named = any(w in node.attrs.get("class", "") or w in node.attrs.get("id", "") for w in CHUNK_WORDS)
        return (node.tag in CHUNK_TAGS or named) and n >= o.min_tokens or n >= o.max_tokens // 2

    def visit(node: tree.Node, depth: int, parent: int | None):
        own = node.html()
        n = o.count(own)
        here, below = parent, depth
        if wanted(node, n):
            kind = _node_kind(node)
            here, below = len(out), depth + 1
            out.append(_chunk(own, 0, kind, _node_importance(node, kind), depth, parent))
            if n > 2 * o.max_tokens:
                for child in node.elements:
                    out.extend(_chunk(p["content"], p["start"], "Element", 0.5, below, here) for p in by_size(child.html(), o))
                return
        for child in node.elements:
            yield visit(child, below, here)

    tree.unrolled(visit(tree.parse(html), 0, None))
    return out


def sections_of(html: str) -> list[dict]:
    """Semantic sections of a page in document order, each with the nearest
    section around it."""
    out: list[dict] = []

    path: list[str] = []

    def visit(node: tree.Node, parent: int | None):
        path.append(tree.path_token(node))
        if node.tag in SECTION_TAGS:
            own = node.html()
            out.append({
                "position": len(out), "parent_position": parent, "tag": node.tag, "depth": len(path), "element_id": node.attrs.get("id"),
                "classes": node.classes, "selector_path": " > ".join(path), "content": own, "text": node.text(" "), "tokens": Options.count(own)})
            parent = len(out) - 1
        for child in node.elements:
            yield visit(child, parent)
        path.pop()

    tree.unrolled(visit(tree.parse(html), None))
    return out


def sections(pages: DataFrame) -> DataFrame:
    return per_page(
        pages, sections_of, "position int, parent_position int, tag string, depth int, element_id string, classes array<string>, "
        "selector_path string, content string, text string, tokens long")


def interactive_marks(html: Column | str) -> Column:
    return F.regexp_count(c(html), F.lit(INTERACTIVE_MARKS))


def is_priority() -> Column:
    path, own = F.col("selector_path"), F.coalesce(F.col("element_id"), F.lit(""))
    hit = F.col("tag").isin("main", "article") | F.array_contains("classes", "content") | F.array_contains("classes", "main-content") | (own == "content")
    for s in PRIORITY:
        hit = hit | path.contains(s)
    return hit


def importance(found: DataFrame) -> DataFrame:
    """The sections with hierarchy, content, interactivity and overall scores."""
    page = Window.partitionBy("page_id")
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    deepest, size = F.max("depth").over(page), F.octet_length("content")
    bonus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TAG_BONUS.items() for x in kv]), F.col("tag")), F.lit(0.0))
    words = lambda x: x.contains("content") | x.contains("main") | x.contains("article")
    by_id = F.when(words(F.coalesce(F.col("element_id"), F.lit(""))), 0.2).otherwise(0.0)
    by_class = F.when(F.exists("classes", words), 0.2).otherwise(0.0)
    hierarchy = clamp(F.when(deepest <= 1, 1.0).otherwise(1 - F.col("depth") / deepest) + bonus + by_id + by_class)
    share = lambda x, top: F.coalesce(F.try_divide(x.cast("double"), top), F.lit(0.0))
    bulk = (share(size, F.max(size).over(page)) + share(F.col("tokens"), F.max("tokens").over(page))) / 2
    content = clamp(0.7 * bulk + 0.3 * share(F.octet_length("text"), size))
    scored = found.withColumns({
        "hierarchy_score": F.round(hierarchy, 6), "content_score": F.round(content, 6),
        "interactivity_score": F.round(1 - 1 / (interactive_marks("content") + 1.0), 6), "is_priority": is_priority()})
    return scored.withColumn("overall_score", overall("hierarchy_score", "content_score", "interactivity_score", "is_priority"))


def overall(h: Column | str, k: Column | str, i: Column | str, priority: Column | str) -> Column:
    raw = 0.4 * c(h) + 0.4 * c(k) + 0.2 * c(i)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c(priority), (raw + 1) / 2).otherwise(raw))), 6)


def by_importance(html: str, o: Options) -> list[dict]:
    """Sections packed from the most important on, each followed by its children
    and siblings that still fit."""
    rows = sections_of(html)
    if not rows:
        return []
    deepest, longest, most = (max(f(r) for r in rows) for f in (lambda r: r["depth"], lambda r: len(r["content"].encode()), lambda r: r["tokens"]))
    clamp = lambda x: max(0.0, min(1.0, x))
    words = ("content", "main", "article")
    for r in rows:
        size = len(r["content"].encode())
        h = clamp((1.0 if deepest <= 1 else 1 - r["depth"] / deepest) + TAG_BONUS.get(r["tag"], 0.0)
                  + 0.2 * any(w in (r["element_id"] or "") for w in words) + 0.2 * any(w in k for k in r["classes"] for w in words))
        k = clamp(0.7 * (size / longest + r["tokens"] / most) / 2 + 0.3 * len(r["text"].encode()) / size)
        n = len(re.findall(INTERACTIVE_MARKS, r["content"]))
        raw = 0.4 * h + 0.4 * k + 0.2 * (1 - 1 / (n + 1))
        priority = r["tag"] in ("main", "article") or r["element_id"] == "content" or not {"content", "main-content"}.isdisjoint(r["classes"]) or any(
            s in r["selector_path"] for s in PRIORITY)
        r["score"] = clamp((raw + 1) / 2 if priority else raw)
    children: dict = {}
    for r in rows:
        children.setdefault(r["parent_position"], []).append(r["position"])
    taken: set[int] = set()
    out: list[dict] = []
    held: list[int] = []
    tokens = 0

    def emit(ids: list[int]) -> None:
        top = max(rows[k]["score"] for k in ids)
        out.append(_chunk("".join(rows[k]["content"] for k in ids), 0, "Semantic", round(top, 6)) | {"ids": list(ids)})

    def add(k: int) -> None:
        nonlocal tokens
        held.append(k)
        taken.add(k)
        tokens += rows[k]["tokens"]

    def relate(k: int) -> None:
        for child in children.get(k, []):
            if child not in taken and tokens + rows[child]["tokens"] <= o.max_tokens:
                add(child)
                relate(child)
        up = rows[k]["parent_position"]
        for other in children.get(up, []) if up is not None else []:
            if other not in taken and tokens + rows[other]["tokens"] <= o.max_tokens:
                add(other)

    for k in sorted(range(len(rows)), key=lambda k: -rows[k]["score"]):
        if k in taken:
            continue
        if rows[k]["tag"] in PRESERVED and rows[k]["tokens"] > o.max_tokens:
            emit([k])
            taken.add(k)
            continue
        if held and tokens + rows[k]["tokens"] > o.max_tokens:
            emit(held)
            held, tokens = [], 0
        add(k)
        relate(k)
    if held:
        emit(held)
    for chunk, following in zip(out, out[1:]):
        room, extra = o.overlap, []
        for k in following["ids"]:
            if rows[k]["tokens"] > room:
                break
            extra.append(rows[k]["content"])
            room -= rows[k]["tokens"]
        if extra:
            chunk["content"] += "\n<!-- Overlap with next chunk -->\n" + "".join(extra)
    return out


STRATEGIES = {"size": by_size, "semantic": by_semantics, "hierarchical": by_hierarchy, "adaptive": by_importance}


def chunks_of(html: str, o: Options) -> list[dict]:
    """Chunks of one page, numbered; an oversize page gives one row with an
    error and no content."""
    n = o.count(html)
    if n > MAX_DOCUMENT:
        return [_chunk("", 0, "Document", 0.0) | {"chunk_index": 0, "tokens": n, "result_kind": "Error", "error": "ContentTooLarge"}]
    if n <= o.max_tokens:
        made, kind = [_chunk(html, 0, "Document", 1.0)], "Single"
    else:
        name = strategy_of(o.strategy)
        made, kind = STRATEGIES[name](html, o), "Tree" if name == "hierarchical" else "Multiple"
    made = made[: o.max_chunks] if o.max_chunks else made
    return [m | {"chunk_index": k, "tokens": o.count(m["content"]), "result_kind": kind, "error": None} for k, m in enumerate(made)]


def chunk(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """One row for each chunk of each page (page_id, html)."""
    found = per_page(
        pages, lambda html: chunks_of(html, options), "chunk_index int, content string, start long, content_type string, importance double, "
        "depth int, parent_index int, tokens long, result_kind string, error string")
    return found.withColumn("chunk_id", F.concat_ws(":", "page_id", "chunk_index"))


def relations(chunks: DataFrame) -> DataFrame:
    """(src, dst, relation) between neighbours, and between parents and children
    of a tree."""
    page = Window.partitionBy("page_id").orderBy("chunk_index")
    pairs = chunks.where("result_kind = 'Multiple'").select("chunk_id", F.lead("chunk_id").over(page).alias("next")).where("next is not null")
    side = lambda s, d, r: pairs.select(F.col(s).alias("src"), F.col(d).alias("dst"), F.lit(r).alias("relation"))
    kids = chunks.where("parent_index is not null").select(
        F.col("chunk_id").alias("src"), F.concat_ws(":", "page_id", "parent_index").alias("dst"), F.lit("Parent").alias("relation"))
    back = kids.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("Child").alias("relation"))
    return side("chunk_id", "next", "Next").unionByName(side("next", "chunk_id", "Previous")).unionByName(kids).unionByName(back)


def heading(html: Column | str) -> Column:
    found = F.trim(strip_tags(F.regexp_extract(c(html), r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>", 1)))
    return F.when(found != "", found)


def summary(text: Column | str, limit: int = 200) -> Column:
    return F.when(F.octet_length(c(text)) > limit, F.concat(clip_bytes(text, limit), F.lit("..."))).otherwise(c(text))


def with_context(chunks: DataFrame, content: str = "content", group: str = "page_id", order: str = "chunk_index", limit: int = 200) -> DataFrame:
    """The chunks with summaries of their neighbours; blank ones are null."""
    row = Window.partitionBy(group).orderBy(order)
    short = F.trim(summary(F.regexp_replace(strip_tags(content), r"(?U)\s+", " "), limit))
    near = chunks.withColumn("_s", F.when(short != "", short))
    return near.withColumns({"preceding_context": F.lag("_s").over(row), "following_context": F.lead("_s").over(row)}).drop("_s")


def contextual_text(title: Column, url: Column, breadcrumbs: Column, before: Column, content: Column, after: Column) -> Column:
    """A chunk as it stands in a prompt; what is null is left out."""
    line = lambda lead, x: F.coalesce(F.concat(F.lit(lead), x, F.lit("\n\n")), F.lit(""))
    path = F.when(F.size(breadcrumbs) > 0, F.array_join(breadcrumbs, " > "))
    return F.concat(
        line("Document Title: ", title), line("Source URL: ", url), line("Location: ", path), line("Previous Content: ", before),
        F.lit("Content:\n"), content, F.lit("\n\n"), line("Following Content: ", after))


def one_line(chunk_id: Column, kind: Column, importance_: Column, tokens: Column, content: Column) -> Column:
    return F.format_string("Chunk %s - Type: %s, Importance: %.2f, Tokens: %d, Content: %s", chunk_id, kind, importance_, tokens, ellipsis(content, 50, 50))
