"""Compact texts that stand for a page."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions import tree
from weftline.functions.css import attr, css
from weftline.functions.pages import per_page
from weftline.functions.text import ellipsis
from weftline.operators.dom import matches

# What is dropped and kept, and the order of elements.
DROPPED = frozenset("script style noscript iframe object embed meta svg canvas head comment template".split())
DROPPED_ATTRIBUTES = re.compile(
    r"^(?:aria-.*|data-.*|onclick|onload|onsubmit|onchange|oninput|style|class|id|role|tabindex|lang|dir|contenteditable|draggable|spellcheck|translate)$")
KEPT_ATTRIBUTES = {
    "a": "href title target rel", "img": "src alt width height", "input": "type name value placeholder required disabled checked",
    "button": "type name value disabled", "form": "action method enctype", "label": "for", "th": "colspan rowspan scope", "td": "colspan rowspan",
}
TABLE_LABELS = {
    "Content Container": "main article section", "Navigation": "nav", "Header": "header", "Footer": "footer", "Sidebar": "aside", "Heading": "h1 h2 h3",
    "Link": "a", "Button": "button input", "Form": "form", "Image": "img", "Video": "video", "Audio": "audio", "List": "ul ol", "Table": "table",
}
TABLE_SELECTORS = "main, article, section, nav, header, footer, aside, h1, h2, h3, a, button, form, input[type=submit], input[type=button], img[alt], video, audio, ul, ol, table"
COUNTED = "div p a img ul ol li table tr td form input button select textarea h1 h2 h3 article section main header footer nav aside".split()
GROUPS = {"interactive": "a button input select textarea", "media": "img video audio canvas svg", "semantic": "article section nav aside header footer main"}
OPEN_GRAPH = "title description type url image site_name".split()
IMPORTANT = (
    "main article section h1 h2 h3 h4 nav menu a button input form select ul ol table img video audio header footer aside figure figcaption details "
    "summary p blockquote pre code").split()
TEXT_BLOCKS = ("p", "ul", "ol", "blockquote", "pre")


def simplified(html: str) -> str:
    """body without what carries no content; attributes only where they help."""

    def render(node: tree.Node):
        if node.tag in DROPPED or node.tag == "link" and node.attrs.get("rel") == "stylesheet":
            return ""
        kept = KEPT_ATTRIBUTES.get(node.tag, "").split()
        attrs = "".join(f' {k}="{v}"' for k, v in node.attrs.items() if k in kept or not DROPPED_ATTRIBUTES.match(k))
        inner = []
        for x in node.children:
            inner.append((yield render(x)) if isinstance(x, tree.Node) else x.strip() if isinstance(x, str) else "")
        return f"<{node.tag}{attrs}>{''.join(inner)}</{node.tag}>"

    return re.sub(r"\s+", " ", tree.unrolled(render(tree.parse(html).find("body"))))


def _clip(text: str, most: int, keep: int) -> str:
    raw = text.encode()
    return text if len(raw) <= most else raw[:keep].decode(errors="ignore") + "..."


def tree_text(html: str, max_depth: int | None = None) -> str:
    """The elements below body as indented lines with the beginning of their text."""
    out: list[str] = []

    def visit(node: tree.Node, depth: int):
        if max_depth is not None and depth > max_depth or node.tag in ("script", "style"):
            return
        attrs = "".join(f' {k}="{v}"' for k, v in node.attrs.items() if not k.startswith("data-"))
        out.append(f"{'  ' * depth}<{node.tag}{attrs}>")
        text = node.text()
        if text.strip():
            first = (_clip(text, 100, 97).splitlines() or [""])[0]
            out.append(f'{"  " * (depth + 1)}"{first}"')
        for k, child in enumerate(node.elements, 1):
            yield visit(child, depth + 1)
            if k >= 10:
                out.append(f"{'  ' * (depth + 1)}... ({len(node.children) - 10} more children)")
                break

    tree.unrolled(visit(tree.parse(html).find("body"), 0))
    return "".join(x + "\n" for x in out)


def outline(nodes: DataFrame) -> DataFrame:
    """(page_id, content): the title, then headings with the text blocks that
    follow them among their siblings."""
    siblings = Window.partitionBy("page_id", "parent_pre").orderBy("pre")
    is_heading, is_block = F.col("tag").rlike("^h[1-6]$"), F.col("tag").isin(*TEXT_BLOCKS)
    found = nodes.where(is_heading | is_block).withColumn("head", F.last(F.when(is_heading, F.col("pre")), True).over(siblings))
    level = F.substring("tag", 2, 1).cast("int")
    line = F.when(is_heading, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "text_concat", F.lit("\n\n"))).when(
        F.trim("text_concat") != "", F.concat("text_concat", F.lit("\n\n")))
    lines = found.where("head is not null").select("page_id", "head", "pre", line.alias("line")).where("line is not null")
    title = nodes.where("tag = 'title'").groupBy("page_id").agg(F.min_by("text_concat", "pre").alias("t"))
    title = title.select("page_id", F.lit(-1).alias("head"), F.lit(-1).alias("pre"), F.concat(F.lit("# "), "t", F.lit("\n\n")).alias("line"))
    rows = lines.unionByName(title).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("head", "pre", "line"))).alias("x"))
    return rows.select("page_id", F.array_join(F.transform("x", lambda s: s["line"]), "").alias("content"))


def element_table(nodes: DataFrame) -> DataFrame:
    """(page_id, content): important elements as a Markdown table."""
    label = reduce(lambda a, kv: a.when(F.col("tag").isin(*kv[1].split()), kv[0]), TABLE_LABELS.items(), F.when(F.lit(False), "")).otherwise("Other")
    named = lambda name, only: F.when(F.col("tag").isin(*only) if only else F.lit(True), F.concat(F.lit(f'{name}="'), attr(name), F.lit('"')))
    attrs = F.concat_ws(", ", named("id", ()), named("class", ()), named("href", ("a",)), named("alt", ("img",)), named("src", ("img",)),
                        named("type", ("input",)), named("name", ("input",)))
    line = F.concat(F.lit("| "), "tag", F.lit(" | "), label, F.lit(" | "), attrs, F.lit(" | "), ellipsis("text", 50, 47), F.lit(" |\n"))
    rows = nodes.where(css(TABLE_SELECTORS)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pre", line.alias("line")))).alias("x"))
    head = "| Element | Type | Attributes | Text Content |\n|---------|------|------------|-------------|\n"
    return rows.select("page_id", F.concat(F.lit(head), F.array_join(F.transform("x", lambda s: s["line"]), "")).alias("content"))


def element_counts(nodes: DataFrame) -> DataFrame:
    """(page_id, element_type, n) of the counted tags and groups, zeros too."""
    every = {t: t for t in COUNTED} | GROUPS
    row = nodes.groupBy("page_id").agg(*[F.count_if(F.col("tag").isin(*tags.split())).alias(f"n_{k}") for k, tags in every.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("element_type"), F.col(f"n_{k}").alias("n")) for k in every])
    return row.select("page_id", F.explode(pairs).alias("x")).select("page_id", "x.*")


def _meta(name: str, key: str = "name") -> Column:
    return F.min_by(F.when((F.col("tag") == "meta") & (attr(key) == name), attr("content")),
                    F.when((F.col("tag") == "meta") & (attr(key) == name), F.col("pre")))


def page_metadata(nodes: DataFrame) -> DataFrame:
    """(page_id, name, value) of title, description, keywords, Open Graph,
    canonical url and element counts."""
    is_title = F.col("tag") == "title"
    canonical = (F.col("tag") == "link") & (attr("rel") == "canonical")
    row = nodes.groupBy("page_id").agg(
        F.min_by(F.when(is_title, F.col("text_concat")), F.when(is_title, F.col("pre"))).alias("title"), _meta("description").alias("description"),
        _meta("keywords").alias("keywords"), *[_meta(f"og:{k}", "property").alias(f"og_{k}") for k in OPEN_GRAPH],
        F.min_by(F.when(canonical, attr("href")), F.when(canonical, F.col("pre"))).alias("url"))
    names = [c for c in row.columns if c != "page_id"]
    long = row.select("page_id", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])).alias("x"))
    counts = element_counts(nodes).select("page_id", F.concat(F.lit("count_"), "element_type").alias("name"), F.col("n").cast("string").alias("value"))
    return long.select("page_id", "x.*").where("value is not null").unionByName(counts)


def page_summary(nodes: DataFrame) -> DataFrame:
    """(page_id, summary): title, structure and headings as lines."""
    has = lambda s: F.count_if(css(s))
    is_title = F.col("tag") == "title"
    row = nodes.groupBy("page_id").agg(
        F.min_by(F.when(is_title, F.col("text_concat")), F.when(is_title, F.col("pre"))).alias("title"), _meta("description").alias("description"),
        has("header").alias("header"), has("nav").alias("nav"), has("main, article, #content, .content").alias("main"),
        has("aside, .sidebar, #sidebar").alias("side"), has("footer").alias("footer"), has("a, button, input, select, textarea").alias("interactive"),
        has("form").alias("form"), has("img").alias("img"), has("table").alias("table"), *[has(f"h{k}").alias(f"h{k}") for k in range(1, 7)])
    line = lambda n, text: F.when(F.col(n) > 0, F.format_string(text, n) if "%d" in text else F.lit(text)).otherwise("")
    text = F.concat(
        F.coalesce(F.concat(F.lit("Title: "), "title", F.lit("\n\n")), F.lit("")), F.coalesce(F.concat(F.lit("Description: "), "description", F.lit("\n\n")), F.lit("")),
        F.lit("Page Structure:\n"), line("header", "- Has header section\n"), line("nav", "- Has navigation menu\n"), line("main", "- Has main content area\n"),
        line("side", "- Has sidebar\n"), line("footer", "- Has footer section\n"), line("interactive", "- Contains %d interactive elements\n"),
        line("form", "- Contains %d forms\n"), line("img", "- Contains %d images\n"), line("table", "- Contains %d tables\n"),
        F.lit("\nHeading Structure:\n"), *[line(f"h{k}", f"- H{k}: %d headings\n") for k in range(1, 7)])
    return row.select("page_id", text.alias("summary"))


def important_elements(nodes: DataFrame) -> DataFrame:
    """(page_id, rank, pre, tag, text): elements in order of importance."""
    found = matches(nodes, IMPORTANT, distinct=True)
    return found.select("page_id", "rank", "pre", "tag", F.trim("text").alias("text"))


def _spaced(node: tree.Node) -> str:
    return " ".join(node.texts()).strip()


def _form_lines(form: tree.Node) -> list[str]:
    labels = {n.attrs["for"]: _spaced(n) for n in form.walk() if n.tag == "label" and "for" in n.attrs}
    out = ["FORM:"]
    for n in form.walk():
        get = lambda k, d="": n.attrs.get(k, d)  # noqa: B023, E731
        label = labels.get(get("id"), "")
        if n.tag == "input":
            out.append(f"INPUT: type={get('type', 'text')}, name={get('name')}, label={label}, placeholder={get('placeholder')}")
        elif n.tag == "textarea":
            out.append(f"TEXTAREA: name={get('name')}, label={label}, placeholder={get('placeholder')}")
        elif n.tag == "select":
            out.append(f"SELECT: name={get('name')}, label={label}")
            options = [_spaced(x) for x in n.walk() if x.tag == "option"]
            if options:
                out.append(f"  OPTIONS: {', '.join(options)}")
        elif n.tag == "button":
            out.append(f"BUTTON: type={get('type', 'button')}, text={_spaced(n)}")
    return [*out, ""]


def _element_lines(n: tree.Node) -> list[str]:
    """The lines that stand for one important element."""
    text = _spaced(n)
    if n.tag in tree.HEADINGS:
        return [f"{'#' * int(n.tag[1])} {text}", ""] if text else []
    if n.tag == "p":
        return [text, ""] if text else []
    if n.tag == "a":
        alone = n.parent is not None and n.parent.tag not in ("p", "li", "td", "div")
        return [f"LINK: {text} ({n.attrs.get('href', '')})"] if alone and text else []
    if n.tag == "img":
        return [f"IMG: {n.attrs.get('alt', '')} ({n.attrs.get('src', '')})"]
    if n.tag in ("ul", "ol"):
        items = [(k, _spaced(x)) for k, x in enumerate((y for y in n.walk() if y.tag == "li"), 1)]
        return ["LIST:" if n.tag == "ul" else "ORDERED LIST:", *((f"- {t}" if n.tag == "ul" else f"{k}. {t}") for k, t in items if t), ""]
    if n.tag == "table":
        heads = [_spaced(x) for x in n.walk() if x.tag == "th"]
        rows = [[_spaced(x) for x in r.walk() if x.tag == "td"] for r in n.walk() if r.tag == "tr"]
        return ["TABLE:", *([f"HEADERS: {' | '.join(heads)}"] if heads else []), *(f"ROW: {' | '.join(r)}" for r in rows if any(r)), ""]
    if n.tag == "form":
        return _form_lines(n)
    if n.tag in ("article", "section", "main"):
        out = [f"{n.tag.upper()}:"]
        out += [f"{'#' * int(h.tag[1])} {_spaced(h)}" for h in n.walk() if h.tag in tree.HEADINGS and _spaced(h)]
        paragraphs = [_spaced(p) for p in n.walk() if p.tag == "p"]
        out += [f"{t[:197]}..." if len(t.encode()) > 200 else t for t in paragraphs[:3] if t]
        return [*out, *(["..."] if len(paragraphs) > 3 else []), ""]
    return []


def token_efficient(html: str) -> str:
    root = tree.parse(html)
    title = root.find("title")
    out = [f"TITLE: {title.text()}"] if title is not None else []
    about = next((n.attrs["content"] for n in root.walk() if n.tag == "meta" and n.attrs.get("name") == "description" and "content" in n.attrs), None)
    out += [f"DESC: {about}"] if about is not None else []
    out.append("")
    nodes = list(root.walk())
    for tag in IMPORTANT:
        for n in nodes:
            if n.tag == tag:
                out += _element_lines(n)
    return "".join(x + "\n" for x in out)


#: Representations made page by page; others may be registered beside them.
GENERATORS = {"simplified_html": simplified, "dom_tree_text": tree_text, "token_efficient": token_efficient}


def register_representation(name: str, fn) -> None:
    """``fn`` maps a page's html to text."""
    GENERATORS[name] = fn


def represent(pages: DataFrame, kinds: tuple[str, ...] = ("simplified_html", "dom_tree_text", "token_efficient")) -> DataFrame:
    """(page_id, rep_type, content, element_count) for each page and kind."""
    chosen = [(k, GENERATORS[k]) for k in kinds]

    def run(html: str):
        n = sum(1 for _ in tree.parse(html).walk())
        return [{"rep_type": k, "content": fn(html), "element_count": n} for k, fn in chosen]

    return per_page(pages, run, "rep_type string, content string, element_count long")
