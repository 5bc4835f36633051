import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from weftline.functions import tree
from weftline.functions.css import css
from weftline.operators import chunking, dom, markdown, preprocess, represent

CASES = {
    "<p><b>x<br><p>y": "<p><b>x<br></b></p><p><b>y</b></p>",
    "<ul><li>a<li>b</ul></p>t": "<ul><li>a</li><li>b</li></ul><p></p>t",
    "<table><thead><tr><th>A</thead><tr><td>1<td>2<tr><td>3</table>": "<table><thead><tr><th>A</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>",
    "<b>one<i>two</b>three</i>": "<b>one<i>two</i></b><i>three</i>",
    "<dl><dt>a<dd>b<dt>c</dl><h1>x<h2>y</h2>": "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl><h1>x</h1><h2>y</h2>",
    "<a href=x>one<a href=y>two</a>": '<a href="x">one</a><a href="y">two</a>',
    "<select><option>1<option>2</select>": "<select><option>1</option><option>2</option></select>",
    "a &amp; b &lt;c": "a &amp; b &lt;c",
    '<div class="x" CLASS=y title=\'q"r\'>z': '<div class="x" title="q&quot;r">z</div>',
    "</div>stray": "stray",
}


def test_tree_builder():
    for source, body in CASES.items():
        assert tree.parse(source).find("body").html() == f"<body>{body}</body>", source
    root = tree.parse('<!DOCTYPE html><html lang=en><title>T &amp; U</title><script>var a="</p>"</script><body class=z>x</body></html>tail')
    assert root.html() == '<html lang="en"><head><title>T &amp; U</title><script>var a="</p>"</script></head><body class="z">xtail</body></html>'
    assert tree.parse(None).html() == "<html><head></head><body></body></html>"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<a href=1>", "</a>", "x", " ", "<br>", "<!-- c", "-->", "<h1>", "</h1>", "<i>", "<"]), max_size=25))
def test_any_input_makes_a_sound_tree(parts):
    rows = tree.rows(tree.parse("".join(parts)))
    assert [r["pre"] for r in rows] == list(range(len(rows)))
    for r in rows:
        below = [x["pre"] for x in rows if r["pre"] in x["ancestors"]]
        assert below == list(range(r["pre"] + 1, r["post"] + 1))
        assert r["n_child_elements"] == sum(x["parent_pre"] == r["pre"] for x in rows)
    again = tree.parse(tree.parse("".join(parts)).html()).html()
    assert tree.parse(again).html() == again


PAGE = """<html lang="en"><head><title>Shop search</title><meta name="a" content="1"><meta name="a" content="2"><meta property="og:type" content="x">
<script type="application/ld+json">{"headline": "H", "n": 3}</script></head>
<body><header class="site-header"><ul><li><a href="/x">X</a></li></ul></header><div id="content" class="main-content post"><p>Some text</p><button class="add-to-cart">Add</button></div>
<div class="sidebar"><span hidden onclick="f()">s</span></div><form id="contact-form"><input type="text"></form></body></html>"""


def nodes(spark, *pages):
    return dom.dom_nodes(spark.createDataFrame([(k, "u", h) for k, h in enumerate(pages)], "page_id long, url string, html string"))


def test_node_table(spark):
    n = nodes(spark, PAGE, None).cache()
    got = {(r.page_id, r.pre): r for r in n.collect()}
    assert got[(0, 0)].tag == "html" and got[(1, 2)].tag == "body"
    assert dom.titles(n).collect()[0].title == "Shop search"
    meta = {r.name: r.value for r in dom.metadata(n).collect()}
    assert meta == {"a": "2", "og:type": "x", "jsonld:headline": "H"}
    main = {r.page_id: r for r in dom.main_content(n).collect()}
    assert main[0].selector == "#content" and main[0].method == "selector" and 1 not in main
    assert {(r.area, r.selector) for r in dom.areas(n).where("area <> 'interactive'").collect()} == {
        ("navigation", "header ul"), ("sidebar", ".sidebar"), ("form", "form"), ("form", "#contact-form")}
    assert {(r.area, r.selector) for r in dom.header_and_footer(n).collect()} == {("header", "header")}
    assert {r.page_id: r.page_type for r in dom.page_types(n).collect()} == {0: "e-commerce", 1: "content"}
    kinds = {(r.tag, r.element_type, r.element_role, r.is_visible, r.is_interactive) for r in dom.elements(n).where("page_id = 0").collect()}
    assert ("div", "Container", "Main", True, False) in kinds and ("span", "Container", "Unknown", False, True) in kinds and ("button", "Interactive", "Button", True, True) in kinds
    stats = dom.statistics(n).where("page_id = 0").first()
    assert stats.element_count == 12
    paths = {r.selector_path for r in n.where("page_id = 0").collect()}
    assert "#content" in paths and "html > body > header.site-header > ul > li > a" in paths


def test_heuristic_main_content(spark):
    n = nodes(spark, "<div class=menu>" + "m" * 300 + "</div><section>" + "s" * 120 + "</section><div>" + "d" * 200 + "</div>")
    assert dom.main_content(n).first().selector == "html > body > section"  # 240 against 200 and 60


def test_selectors(spark):
    n = nodes(spark, '<div id=a class="x y"><p data-k="v-1" aria-label=z></p><ul><li>1<li class=x>2</ul></div><li>o').cache()
    count = lambda s: n.where(css(s)).count()
    assert [count(s) for s in ("li", "#a", ".x", ".x.y", "[data-k]", "[data-k='v-1']", "[data-k^='v']", "[data-k*='-']", "div li", "body > li", "[aria-*]", "p:empty", "li:not(.x)", "li:first-child", "p, li")] == [
        3, 1, 2, 1, 1, 1, 1, 1, 2, 1, 1, 1, 2, 1, 4]


def test_preprocessing(spark):
    html = ('<div><div><div><div>x</div></div></div></div><script>a\nb</script><div class="menu">m</div><input checked="x" onclick="go()"><a href="/p">t</a>'
            '<a href="https://e/">u</a><a href="#f">v</a><svg>q</svg>')
    frame = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    got = frame.select(preprocess.preprocess("html").alias("h")).first().h
    assert got == ('<div>x</div><nav role="navigation">m</nav><input checked data-event-onclick="go()"><a href="https://example.com/p">t</a><a href="https://e/">u</a><a href="#f">v</a>')
    clues = frame.select(preprocess.add_context_clues(F.lit('<nav class=a><a href="x">T</a><a aria-label="q">U</a></nav>')).alias("h")).first().h
    assert clues == '<!-- Begin nav --><nav class=a><a href="x" aria-description="Link to: T">T</a><a aria-label="q">U</a></nav><!-- End nav -->'
    page = spark.createDataFrame([(1, "u", "<nav>n</nav><main><p>a  b<script>z</script></p></main><div class='ad'>c</div>")], "page_id long, url string, html string")
    assert preprocess.html_to_text(page).first().text == "n a b c"
    assert preprocess.remove_boilerplate(page).first().html == "<html><head></head><body><main><p>a  b<script>z</script></p></main></body></html>"
    assert preprocess.main_content_html(page).first().html == "<main><p>a  b<script>z</script></p></main>"


@pytest.mark.parametrize("page", ["<div>" * 1200 + "deep", "<b><ul><li>" * 400 + "deep" + "</i>" * 1200, "<blockquote><p>" * 1100 + "deep", "<section class=content>" * 1100 + "deep"])
def test_no_page_nests_too_deep(page):
    html = f"<body>{page}"
    assert "deep" in markdown.to_markdown(html) and "deep" in represent.simplified(html) and "deep" in represent.tree_text(html)
    options = chunking.Options()
    for cut in (chunking.by_size, chunking.by_semantics, chunking.by_hierarchy):
        assert any("deep" in c["content"] for c in cut(html, options))
    assert all("deep" in c["text"] for c in chunking.sections_of(html))
