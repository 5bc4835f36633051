"""The node table of a page and what can be read off it.

``dom_nodes`` parses each page once; everything else here is a filter, a
projection or an aggregate over its rows.  All rows of a page come from one
task, so that aggregates by page shrink to a row a page before any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions import tree
from weftline.functions.css import attr, css
from weftline.functions.pages import per_page

NODE_FIELDS = (
    "pre int, post int, parent_pre int, depth int, child_index int, tag string, attrs map<string,string>, classes array<string>, "
    "own_text string, text string, text_concat string, n_child_nodes int, n_child_elements int, parent_tag string, path array<string>, "
    "ancestors array<int>, selector_path string"
)

# Selectors in order of preference and classes of elements.
MAIN_CONTENT = "main|article|#main|#content|.main|.content|#main-content|.main-content|[role=main]|.post|.article|.entry|.post-content|.article-content|.entry-content".split("|")
NAVIGATION = "nav|[role=navigation]|#navigation|.navigation|#nav|.nav|#main-nav|.main-nav|#menu|.menu|header ul|.navbar|.menu-container".split("|")
HEADER = "header|#header|.header|.site-header|#site-header|[role=banner]|.masthead|#masthead".split("|")
FOOTER = "footer|#footer|.footer|.site-footer|#site-footer|[role=contentinfo]|.bottom|#bottom".split("|")
SIDEBAR = "aside|#sidebar|.sidebar|.widget-area|#secondary|[role=complementary]|.col-sidebar|#right-sidebar|#left-sidebar".split("|")
FORMS = "form|[role=form]|.form|#form|.contact-form|#contact-form|.search-form|#search-form|.login-form|#login-form".split("|")
INTERACTIVE = (
    "a|button|input|select|textarea|[role=button]|[onClick]|[href]|[role=link]|[role=checkbox]|[role=radio]|[role=tab]|[role=menuitem]|"
    "[role=combobox]|[role=slider]|details").split("|")
BOILERPLATE = (
    "header|footer|nav|.navigation|#header|#footer|#navigation|.sidebar|#sidebar|.menu|#menu|.ad|#ad|.advertisement|.banner|#banner|.share|"
    ".social|.comment-section|.disqus|.related-articles|.recommended|.popular-posts|.newsletter|.subscription|.cookie-notice|.popup|.modal").split("|")
AREAS = {"navigation": NAVIGATION, "sidebar": SIDEBAR, "form": FORMS, "interactive": INTERACTIVE}
TYPE_BY_TAG = {
    "Container": "div span section article main aside header footer nav", "Content": "p h1 h2 h3 h4 h5 h6 blockquote pre code ul ol li",
    "Interactive": "a button input select textarea label option", "Media": "img video audio canvas svg", "Form": "form fieldset legend",
    "Metadata": "meta link title style script", "Layout": "table tr td th thead tbody tfoot",
}
TYPE_BY_ROLE = {
    "Interactive": "button link checkbox radio tab menuitem combobox", "Form": "form", "Navigation": "navigation menu", "Media": "img banner",
}
ROLE_BY_ROLE = {
    "navigation": "Navigation", "main": "Main", "banner": "Header", "contentinfo": "Footer", "complementary": "Sidebar", "form": "Form",
    "article": "Article", "button": "Button", "link": "Link", "textbox": "Input", "searchbox": "Input",
}
ROLE_BY_TAG = {
    "nav": "Navigation", "main": "Main", "header": "Header", "footer": "Footer", "aside": "Sidebar", "form": "Form", "article": "Article",
    "section": "Section", "button": "Button", "a": "Link", "input": "Input", "textarea": "Input", "select": "Input",
}
ROLE_BY_ID = {
    "Navigation": "nav navigation menu navbar", "Main": "main content main-content", "Header": "header site-header page-header",
    "Footer": "footer site-footer page-footer", "Sidebar": "sidebar widget-area",
}
ROLE_BY_CLASS = ROLE_BY_ID | {
    "Form": "form contact-form search-form", "Article": "article post entry", "Section": "section", "Button": "btn button", "Link": "link",
    "Input": "input field",
}


def dom_nodes(pages: DataFrame, max_depth: int | None = None, columns: str | None = None) -> DataFrame:
    """One row for each element of each page (page_id, html); ``max_depth``
    counts from body and leaves deeper elements out.  Python makes only the
    ``columns`` named (all without): Spark can't prune what a function returns."""
    names = None if columns is None else frozenset(columns.split()) | ({"depth"} if max_depth is not None else set())
    kept = ", ".join(f for f in NODE_FIELDS.split(", ") if names is None or f.split()[0] in names)
    nodes = per_page(pages, lambda html: tree.rows(tree.parse(html), names), kept)
    return nodes if max_depth is None else nodes.where(F.col("depth") - 1 <= max_depth)


def body_nodes(nodes: DataFrame) -> DataFrame:
    """body and what lies below it, with the depth counted from body."""
    return nodes.where((F.size("path") >= 2) & (F.get("path", F.lit(1)) == "body")).withColumn("body_depth", F.col("depth") - 1)


def _lookup(value: Column, table: dict[str, str]) -> Column:
    """Value of the table's key equal to ``value``, null if there is none."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), value)


def _inverted(groups: dict[str, str]) -> dict[str, str]:
    return {word: name for name, words in groups.items() for word in words.split()}


def element_type() -> Column:
    by_role = F.coalesce(_lookup(attr("role"), _inverted(TYPE_BY_ROLE)), F.lit("Unknown"))
    return F.coalesce(_lookup(F.col("tag"), _inverted(TYPE_BY_TAG)), by_role)


def element_role() -> Column:
    classes = F.transform("classes", lambda c: _lookup(c, _inverted(ROLE_BY_CLASS)))
    return F.coalesce(
        _lookup(attr("role"), ROLE_BY_ROLE), _lookup(F.col("tag"), ROLE_BY_TAG), F.get(F.array_compact(classes), F.lit(0)),
        _lookup(attr("id"), _inverted(ROLE_BY_ID)), F.lit("Unknown"))


def is_interactive() -> Column:
    return (element_type() == "Interactive") | attr("onclick").isNotNull() | F.col("tag").isin("a", "button", "input", "select", "textarea")


def is_visible() -> Column:
    style = F.coalesce(attr("style"), F.lit(""))
    return attr("hidden").isNull() & ~style.contains("display: none") & ~style.contains("visibility: hidden")


def elements(nodes: DataFrame) -> DataFrame:
    """A readable row for each element."""
    text = F.trim("own_text")
    return nodes.select(
        "page_id", "pre", "tag", "attrs", F.when(text != "", text).alias("text_content"), "classes", element_type().alias("element_type"),
        element_role().alias("element_role"), is_visible().alias("is_visible"), is_interactive().alias("is_interactive"), "selector_path")


def matches(nodes: DataFrame, selectors: list[str], distinct: bool = False) -> DataFrame:
    """The rows that match, once for each selector that they match (or once at
    all), with the selector and its rank."""
    hit = F.array_compact(F.array(*[F.when(css(s), F.struct(F.lit(k).alias("rank"), F.lit(s).alias("selector"))) for k, s in enumerate(selectors)]))
    found = nodes.withColumn("_hit", F.explode(F.slice(hit, 1, 1) if distinct else hit))
    return found.select("*", "_hit.rank", "_hit.selector").drop("_hit")


def areas(nodes: DataFrame) -> DataFrame:
    """(page_id, area, selector, pre, tag, selector_path) of navigation, sidebar,
    form and interactive elements."""
    parts = [matches(nodes, s).select("page_id", F.lit(a).alias("area"), "selector", "pre", "tag", "selector_path") for a, s in AREAS.items()]
    return reduce(DataFrame.unionByName, parts)


def first_match(nodes: DataFrame, selectors: list[str], *columns: str) -> DataFrame:
    """By page, the first element in order of selector, then of document."""
    best = matches(nodes, selectors, distinct=True).groupBy("page_id").agg(
        F.min_by(F.struct("selector", "pre", *columns), F.struct("rank", "pre")).alias("m"))
    return best.select("page_id", "m.*")


def header_and_footer(nodes: DataFrame) -> DataFrame:
    parts = [first_match(nodes, s, "tag", "selector_path").withColumn("area", F.lit(a)) for a, s in (("header", HEADER), ("footer", FOOTER))]
    return parts[0].unionByName(parts[1])


def titles(nodes: DataFrame) -> DataFrame:
    """The first title of each page that has one."""
    return nodes.where("tag = 'title'").groupBy("page_id").agg(F.trim(F.min_by("own_text", "pre")).alias("title"))


def metadata(nodes: DataFrame) -> DataFrame:
    """(page_id, name, value) of meta elements, the last of a name, and of the
    text members of JSON-LD as jsonld:name."""
    named = nodes.where("tag = 'meta'").select(
        "page_id", "pre", F.coalesce(attr("name"), attr("property")).alias("name"), attr("content").alias("value")).where("name is not null and value is not null")
    parsed = F.expr("try_parse_json(own_text)")
    ld = nodes.where((F.col("tag") == "script") & (attr("type") == "application/ld+json")).select(
        "page_id", "pre", F.explode(F.expr("from_json(own_text, 'map<string,string>')")).alias("name", "value"), parsed.alias("j"))
    is_text = F.expr("schema_of_variant(try_variant_get(j, '$.' || name))") == "STRING"
    ld = ld.where(is_text).select("page_id", "pre", F.concat(F.lit("jsonld:"), "name").alias("name"), "value")
    return named.unionByName(ld).groupBy("page_id", "name").agg(F.max_by("value", "pre").alias("value"))


def main_score() -> Column:
    """How much an element below body looks like the main content."""
    length = F.octet_length("text").cast("double")
    by_tag = F.coalesce(_lookup(F.col("tag"), {"main": "3.0", "article": "2.5", "section": "2.0", "div": "1.0"}).cast("double"), F.lit(0.5))
    good = F.array(*map(F.lit, "content main main-content article post".split()))
    bad = F.array(*map(F.lit, "sidebar widget nav menu header footer".split()))
    by_class = F.aggregate("classes", F.lit(1.0), lambda a, c: a * F.when(F.array_contains(good, c), 1.5).when(F.array_contains(bad, c), 0.2).otherwise(1.0))
    role = attr("role")
    by_role = F.when(role == "main", 3.0).when(role == "article", 2.5).when(role.isin("complementary", "navigation", "banner", "contentinfo"), 0.2).otherwise(1.0)
    return length * by_tag * by_class * by_role * F.when(length < 100, 0.5).otherwise(1.0)


def main_content(nodes: DataFrame) -> DataFrame:
    """(page_id, selector, pre, text, method): the first of the known selectors,
    else the best child of body."""
    known = first_match(nodes, MAIN_CONTENT, "text").withColumn("method", F.lit("selector"))
    scored = nodes.where(F.col("parent_tag") == "body").withColumn("score", main_score()).where("score > 0")
    guess = scored.groupBy("page_id").agg(
        F.max_by(F.struct(F.col("selector_path").alias("selector"), "pre", "text"), F.struct("score", -F.col("pre"))).alias("m"))
    guess = guess.select("page_id", "m.*", F.lit("heuristic").alias("method"))
    return known.unionByName(guess.join(known.select("page_id"), "page_id", "left_anti"))


def statistics(nodes: DataFrame) -> DataFrame:
    """Element counts by page and the shares of content and interactive ones."""
    kind = element_type()
    share = lambda c: F.coalesce(F.try_divide(F.count_if(c).cast("double"), F.count("*")), F.lit(0.0))
    return body_nodes(nodes).groupBy("page_id").agg(
        F.count("*").alias("element_count"), share(kind == "Content").alias("content_density"), share(is_interactive()).alias("interactive_density"))


def type_distribution(nodes: DataFrame) -> DataFrame:
    return body_nodes(nodes).groupBy("page_id", element_type().alias("element_type")).agg(F.count("*").alias("n"))


def page_types(nodes: DataFrame) -> DataFrame:
    """(page_id, page_type) by ordered rules."""
    held = lambda selectors: reduce(lambda a, b: a | b, [css(s) for s in selectors])
    inter, form, cls = held(INTERACTIVE), held(FORMS), F.coalesce(attr("class"), F.lit(""))
    shop = inter & (cls.contains("add-to-cart") | cls.contains("buy-now") | F.col("text").contains("Add to Cart") | F.col("text").contains("Buy Now"))
    contact = form & (cls.contains("contact-form") | F.coalesce(attr("id"), F.lit("")).contains("contact-form"))
    published = (F.col("tag") == "meta") & (F.coalesce(attr("name"), attr("property")) == "article:published_time")
    main = held(MAIN_CONTENT) | ((F.col("parent_tag") == "body") & (main_score() > 0))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = nodes.groupBy("page_id").agg(
        any_(shop).alias("shop"), any_(main).alias("main"), any_((F.col("tag") == "article") | published).alias("article"),
        any_((F.col("tag") == "title") & F.lower("own_text").contains("search")).alias("title"),
        any_(inter & cls.contains("search-result")).alias("result"), any_(form).alias("form"), any_(contact).alias("contact"))
    kind = F.when(F.col("shop"), "e-commerce").when(F.col("main") & F.col("article"), "article").when(
        F.col("title") | F.col("result"), "search-results").when(F.col("contact"), "contact-form").when(F.col("form"), "form").otherwise("content")
    return flags.select("page_id", kind.alias("page_type"))


def links(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, href, text) of links, and how many links of the page have
    the same text."""
    same = Window.partitionBy("page_id", "text")
    found = nodes.where((F.col("tag") == "a") & attr("href").isNotNull()).select("page_id", "pre", attr("href").alias("href"), F.trim("text_concat").alias("text"))
    return found.withColumn("same_text", F.count("*").over(same))


def tag_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))
