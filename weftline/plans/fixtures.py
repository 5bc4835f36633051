"""Queries over small pages held here, for what the tables don't contain; their
SQL states the expected rows."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.operators import audit, chunking, dom, markdown, preprocess, prompts, records, represent, usage
from weftline.plans.registry import query
from weftline.sources import files


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]"
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def expected(columns: str, *rows: tuple) -> str:
    """SQL for rows; a column is a name and, after a colon, its type."""
    named = [c.partition(":") for c in columns.split()]
    cast = ", ".join(f"CAST(c{k} AS {kind or 'VARCHAR'}) AS {name}" for k, (name, _, kind) in enumerate(named))
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT {cast} FROM (VALUES {body}) t({', '.join(f'c{k}' for k in range(len(named)))})"


def page_table(spark: SparkSession, *pages: str | None) -> DataFrame:
    return spark.createDataFrame([(k, f"https://e.org/{k}", h) for k, h in enumerate(pages)], "page_id long, url string, html string")


SHOP = (
    '<html lang="en"><head><title>Shop search</title><meta name="a" content="1"><meta name="a" content="2"><meta property="og:type" content="x">'
    '<script type="application/ld+json">{"headline": "H", "n": 3}</script></head><body><header class="site-header"><ul><li><a href="/x">X</a></li></ul></header>'
    '<div id="content" class="main-content post"><p>Some text</p><button class="add-to-cart">Add</button></div><div class="sidebar"><span hidden onclick="f()">s</span></div>'
    '<form id="contact-form"><input type="text"></form></body></html>')


@query(expected("page_id:BIGINT name value", (0, "a", "2"), (0, "og:type", "x"), (0, "jsonld:headline", "H")))
def fx_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.metadata(dom.dom_nodes(page_table(spark, SHOP, None)))


@query(expected(
    "tag element_type element_role is_visible:BOOLEAN is_interactive:BOOLEAN", ("header", "Container", "Header", True, False), ("ul", "Content", "Unknown", True, False),
    ("li", "Content", "Unknown", True, False), ("a", "Interactive", "Link", True, True), ("div", "Container", "Main", True, False), ("p", "Content", "Unknown", True, False),
    ("button", "Interactive", "Button", True, True), ("div", "Container", "Sidebar", True, False), ("span", "Container", "Unknown", False, True), ("form", "Form", "Form", True, False),
    ("input", "Interactive", "Input", True, True)))
def fx_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dom.elements(dom.body_nodes(dom.dom_nodes(page_table(spark, SHOP))).where("tag <> 'body'"))
    return found.select("tag", "element_type", "element_role", "is_visible", "is_interactive")


@query(expected("area selector tag", ("navigation", "header ul", "ul"), ("sidebar", ".sidebar", "div"), ("form", "form", "form"), ("form", "#contact-form", "form"),
                ("interactive", "a", "a"), ("interactive", "[href]", "a"), ("interactive", "button", "button"), ("interactive", "input", "input"), ("interactive", "[onClick]", "span")))
def fx_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.areas(dom.dom_nodes(page_table(spark, SHOP))).select("area", "selector", "tag")


KINDS = (
    SHOP, "<article>a</article>", "<title>Search it</title><p>x", "<form class=contact-form></form>", "<form></form>", "<main>m</main>",
    "<meta property='article:published_time' content='d'><main>m</main>")


@query(expected("page_id:BIGINT page_type", (0, "e-commerce"), (1, "article"), (2, "search-results"), (3, "contact-form"), (4, "form"), (5, "content"), (6, "article")))
def fx_page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.page_types(dom.dom_nodes(page_table(spark, *KINDS)))


@query(expected("page_id:BIGINT selector method", (0, "html > body > section", "heuristic"), (1, "article", "selector"), (2, ".content", "selector")))
def fx_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ("<div class=menu>" + "m" * 300 + "</div><section>" + "s" * 120 + "</section><div>" + "d" * 200 + "</div>", "<div class=main></div><article>x</article>", "<p>x</p><div class=content>y</div>")
    return dom.main_content(dom.dom_nodes(page_table(spark, *pages))).select("page_id", "selector", "method")


AUDITED = (
    "<html lang=en><title>A good title</title><nav>n</nav><main><h1>A</h1><h3>B</h3><p>x<img src=a.png><img alt='' src=logo.png><img alt='Image of x'></main>",
    "<html lang=en><title>A good title</title><main><h1>A</h1><p>x<input placeholder=p aria-label=' '><input title=t><input type=email><label for=i>l</label><input id=i><a href=1></a><a href=2>more</a></main>",
    "<html lang=en><title>A good title</title><main><h1>A</h1><p>x<table><tr><td>1</table><div role=bogus aria-label=z></div><div role=slider aria-valuemin=1 aria-valuemax=2></div><div onclick=f()></div></main>",
)


@query(expected(
    "page_id:BIGINT feature severity description", (0, "Headings", "Warning", "Heading level skipped from h1 to h3"), (0, "AltText", "Error", "Image is missing alt attribute"),
    (0, "AltText", "Warning", "Potentially meaningful image has empty alt text"), (0, "AltText", "Warning", "Image has generic alt text: 'Image of x'"),
    (0, "Aria", "Info", "Document does not use ARIA attributes"), (0, "SkipNavigation", "Warning", "Document has navigation but no skip navigation link"),
    (0, "SemanticStructure", "Info", "Document does not use HTML5 semantic elements"),
    (1, "FormLabels", "Warning", "Input relies only on placeholder for labeling"), (1, "FormLabels", "Warning", "Input relies only on title attribute for labeling"),
    (1, "FormLabels", "Error", "Input element (email type) has no associated label"), (1, "LinkText", "Error", "Link has no text content or accessible name"),
    (1, "LinkText", "Warning", "Link has generic text: 'more'"), (1, "LandmarkRoles", "Info", "Document does not have a navigation landmark"),
    (1, "SemanticStructure", "Info", "Document does not use HTML5 semantic elements"),
    (2, "TableAccessibility", "Error", "Table has no header cells (th) or header section (thead)"), (2, "TableAccessibility", "Warning", "Table is missing a caption"),
    (2, "TableAccessibility", "Info", "Table has no description (caption, summary, or aria-describedby)"), (2, "Aria", "Error", "Invalid ARIA role: 'bogus'"),
    (2, "Aria", "Error", "Missing required ARIA attribute 'aria-valuenow' for role 'slider'"), (2, "KeyboardNavigation", "Error", "Element has onclick event but no keyboard event handlers"),
    (2, "LandmarkRoles", "Info", "Document does not have a navigation landmark"), (2, "SemanticStructure", "Info", "Document does not use HTML5 semantic elements")))
def fx_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.issues(dom.dom_nodes(page_table(spark, *AUDITED))).select("page_id", "feature", "severity", "description")


@query(expected("page_id:BIGINT description", (0, "Element has insufficient contrast ratio: 4.48:1 (minimum should be 4.5:1)"), (2, "Element has insufficient contrast ratio: 1.00:1 (minimum should be 3.0:1)")))
def fx_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ("<p style='color: #777; background-color: #fff'>a", "<h1 style='color:#777;background-color:#fff'>b", "<p style='color: rgb(9,9,9); background-color: #090909; font-size: 30px'>c")
    return audit.issues(dom.dom_nodes(page_table(spark, *pages)), True).where("feature = 'ColorContrast'").select("page_id", "description")


TEXTS = "<title>T</title><body><h1>Hi</h1><p>One <b>two</b></p><ul><li>a<li>b</ul><h2>Sub</h2><table><tr><th>A<th>B<tr><td>1<td>2</table><form><label for=e>Mail</label><input id=e name=m></form><img src=i alt=j></body>"


@query(expected("content", ("# T\n\n# Hi\n\nOne two\n\nab\n\n## Sub\n\n",)))
def fx_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return represent.outline(dom.dom_nodes(page_table(spark, TEXTS))).select("content")


@query(expected("content", (
    "| Element | Type | Attributes | Text Content |\n|---------|------|------------|-------------|\n| h1 | Heading |  | Hi |\n| ul | List |  | a b |\n| h2 | Heading |  | Sub |\n"
    "| table | Table |  | A B 1 2 |\n| form | Form |  | Mail |\n| img | Image | alt=\"j\", src=\"i\" |  |\n",)))
def fx_element_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return represent.element_table(dom.dom_nodes(page_table(spark, TEXTS))).select("content")


@query(expected(
    "rep_type content", ("simplified_html", '<body><h1>Hi</h1><p>One<b>two</b></p><ul><li>a</li><li>b</li></ul><h2>Sub</h2><table><tbody><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></tbody></table>'
     '<form><label for="e">Mail</label><input name="m"></input></form><img src="i" alt="j"></img></body>'),
    ("token_efficient", "TITLE: T\n\n# Hi\n\n## Sub\n\nFORM:\nINPUT: type=text, name=m, label=Mail, placeholder=\n\nLIST:\n- a\n- b\n\nTABLE:\nHEADERS: A | B\nROW: 1 | 2\n\nIMG: j (i)\nOne  two\n\n")))
def fx_representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return represent.represent(page_table(spark, TEXTS), ("simplified_html", "token_efficient")).select("rep_type", "content")


@query(expected("markdown", (
    '---\ntitle: "T"\n---\n\n# [TITLE] Hi\n\nOne **two**\n\n[LIST]\n\n- a\n- b\n\n## [SECTION] Sub\n\n| A   | B   |\n| --- | --- |\n| 1   | 2   |\n\nMail\n\n![j](i) [IMAGE: j]\n',)))
def fx_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.markdown(page_table(spark, TEXTS), markdown.Options(main_content_only=False)).select("markdown")


@query(expected("page_id:BIGINT html", (0, "<html><head></head><body><p><b>x<br></b></p><p><b>y</b></p></body></html>"),
                (1, "<html><head></head><body><ul><li>a</li><li>b</li></ul><p></p>t</body></html>"),
                (2, "<html><head></head><body><table><tbody><tr><td>1</td><td>2</td></tr></tbody></table></body></html>"), (3, "<html><head></head><body></body></html>")))
def fx_fixed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.fix_unclosed(page_table(spark, "<p><b>x<br><p>y", "<ul><li>a<li>b</ul></p>t", "<table><tr><td>1<td>2</table>", None))


@query(expected("page_id:BIGINT html", (0, "<html><head></head><body><main><p>a</p></main></body></html>")))
def fx_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.remove_boilerplate(page_table(spark, "<nav>n</nav><div class='x ad'>c</div><main><p>a</p><div id=sidebar>s</div></main><footer>f</footer>"))


PIECES = "".join(f"<p>{'word ' * 10}{k}</p>" for k in range(4))


@query(expected("chunk_index:INTEGER start:BIGINT tokens:BIGINT result_kind content_type", (0, 0, 30, "Multiple", "Element"), (1, 116, 30, "Multiple", "Element")))
def fx_size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = chunking.Options(strategy="size", max_tokens=32, min_tokens=5, overlap=0)
    return chunking.chunk(page_table(spark, PIECES), options).select("chunk_index", "start", "tokens", "result_kind", "content_type")


@query(expected("src dst relation", ("0:0", "0:1", "Next"), ("0:1", "0:0", "Previous")))
def fx_chunk_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = chunking.Options(strategy="size", max_tokens=32, min_tokens=5, overlap=0)
    return chunking.relations(chunking.chunk(page_table(spark, PIECES), options))


@query(expected("tag is_priority:BOOLEAN hierarchy_score:DOUBLE interactivity_score:DOUBLE parent_position:INTEGER", ("body", False, 0.5, 0.5, None),
                ("main", True, 0.85, 0.5, 0), ("section", True, 0.2, 0.5, 1), ("footer", False, 0.05, 0.0, 0)))
def fx_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = "<body><main id=main><section>" + "a" * 100 + "<a href=1>x</a></section></main><footer>f</footer></body>"
    return chunking.importance(chunking.sections(page_table(spark, page))).select("tag", "is_priority", "hierarchy_score", "interactivity_score", "parent_position")


@query(expected("overall:DOUBLE priority:DOUBLE", (0.64, 0.82)))
def fx_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = [F.lit(0.8), F.lit(0.6), F.lit(0.4)]
    return spark.range(1).select(chunking.overall(*s, F.lit(False)).alias("overall"), chunking.overall(*s, F.lit(True)).alias("priority"))


@query(expected("text", (
    "I need you to help with the following:\n\nN. Focus on completing a checkout process with the provided information.\n\nContext:\nPrevious actions taken:\n\n"
    "Action 1: click on target 'Element 0' with value 'v' - Result: ok\n\n\nCurrent URL: http://u\n\nCurrent progress: 50%\n\nObjective:\nBuy\n\nHTML Content:\n```html\n<p>\n```\n\n"
    "Interactive elements on the page:\n\nElement 0: button - Text: 'Go' - Placeholder: '' - ID: 'b' - Classes: [x, y] - visible - Position: (x:1.0, y:2.0)\n\n\nGuidelines:\n"
    + "\n".join(prompts.NAVIGATION_GUIDELINES + prompts.NAVIGATION_MORE["checkout"]) + "\n\n" + prompts.ACTION_FORMAT,)))
def fx_navigation_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = F.expr("array(named_struct('index', 0, 'tag', 'button', 'text', 'Go', 'placeholder', cast(null as string), 'id', 'b', 'classes', array('x', 'y'), 'visible', true, 'x', 1.0D, 'y', 2.0D))")
    actions = F.expr("array(named_struct('action_type', 'click', 'target', 'Element 0', 'value', 'v', 'result', 'ok'))")
    text = prompts.navigation(F.lit("<p>"), "Buy", elements, actions, "checkout", url=F.lit("http://u"), progress=F.lit(0.5), system="N.")
    return spark.range(1).select(text.alias("text"))


def _sse(event: dict) -> str:
    return "data: " + json.dumps(event)


@query(expected("request_id:BIGINT text model prompt_tokens:BIGINT completion_tokens:BIGINT error", (1, "ab", "m", 3, 7, None), (2, "", None, None, None, "malformed line")))
def fx_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [
        (1, 0, _sse({"type": "message_start", "message": {"model": "m", "usage": {"input_tokens": 3}}})), (1, 2, _sse({"type": "content_block_delta", "delta": {"text": "b"}})),
        (1, 1, _sse({"type": "content_block_delta", "delta": {"text": "a"}})), (1, 1, _sse({"type": "content_block_delta", "delta": {"text": "a"}})),
        (1, 3, _sse({"type": "message_delta", "usage": {"output_tokens": 7}})), (1, 4, "data: [DONE]"), (2, 0, "data: {oops")]
    return usage.replies(usage.sse_events(spark.createDataFrame(lines, "request_id long, seq long, line string"))).drop("finish_reason")


def _times(spark: SparkSession, *seconds: float) -> DataFrame:
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, start + dt.timedelta(seconds=s), "a") for k, s in enumerate(seconds)], "event_id long, ts timestamp, key string")


@query(expected("algorithm event_id:BIGINT allowed:BOOLEAN wait_s:DOUBLE", ("token_bucket", 0, True, 0.0), ("token_bucket", 1, True, 0.0), ("token_bucket", 2, False, 30.0), ("token_bucket", 3, True, 0.0),
                ("fixed_window", 0, True, 0.0), ("fixed_window", 1, True, 0.0), ("fixed_window", 2, False, 60.0), ("fixed_window", 3, False, 30.0),
                ("leaky_bucket", 0, True, 0.0), ("leaky_bucket", 1, False, 30.0), ("leaky_bucket", 2, False, 60.0), ("leaky_bucket", 3, False, 60.0)))
def fx_limiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _times(spark, 0, 0, 0, 30)
    parts = [usage.simulate(events, "key", a, rpm=2, burst=2).select(F.lit(a).alias("algorithm"), "event_id", "allowed", "wait_s") for a in ("token_bucket", "fixed_window", "leaky_bucket")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SCHEMA = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}, "t": {"type": "string", "pattern": "^a"}, "o": {"type": "object", "required": ["z"], "properties": {"z": {"type": "string"}}}}}


@query(expected("id:BIGINT errors:VARCHAR[]", (0, ["n: minimum", "t: pattern", "o.z: required"]), (1, []), (2, ["n: required", "o.z: required"])))
def fx_schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0, '{"n": 0, "t": "b", "o": {}}'), (1, '{"n": 2, "t": "ab", "o": {"z": "q"}}'), (2, "{}")], "id long, j string")
    parsed = rows.select("id", F.from_json("j", records.struct_of(SCHEMA)).alias("v"))
    return parsed.select("id", F.array_compact(F.array(*records.schema_errors(SCHEMA, F.col("v")))).alias("errors"))


@query(expected("format text", ("json", '{"i":1,"s":"a\\"<b"}'), ("csv", '"1","a""<b"'), ("xml", '<item><i>1</i><s>a"&lt;b</s></item>'), ("yaml", '- i: 1\n  s: "a\\"<b"')))
def fx_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 'a"<b')], "i int, s string")
    parts = [files.render(rows, f).select(F.lit(f).alias("format"), "text") for f in ("json", "csv", "xml", "yaml")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
