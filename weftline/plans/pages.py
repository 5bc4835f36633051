"""Queries over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import text as X
from weftline.functions.css import attr
from weftline.operators import audit, chunking, dom, markdown, preprocess, represent
from weftline.plans.registry import query, stored, table

UNESCAPE = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;', '&')"
SPACES = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
TITLE = UNESCAPE.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def nodes(spark: SparkSession, sf_dir: str, columns: str | None = None) -> DataFrame:
    return dom.dom_nodes(pages(spark, sf_dir), columns=columns)


def count(tag: str) -> str:
    return f"CAST(len(regexp_extract_all(html, '<{tag}[ >]')) AS BIGINT)"


@query(f"""
SELECT page_id, {TITLE} AS title, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang,
  regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host, {count('a')} AS links, {count('p')} AS paragraphs,
  {count('h1')} AS h1, length(html) // 4 + 1 AS tokens_chars4, CAST(ceil(strlen(html) / 4.0) AS BIGINT) AS tokens_bytes4,
  CASE WHEN length(html) // 4 + 1 > 100000 THEN 'too large' WHEN length(html) // 4 + 1 <= 8000 THEN 'single' ELSE 'chunks' END AS route
FROM pages""")
def page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = X.tokens_chars4("html")
    unescaped = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        unescaped = F.replace(unescaped, F.lit(a), F.lit(b))
    n = lambda tag: F.regexp_count("html", F.lit(f"<{tag}[ >]")).cast("long")
    return pages(spark, sf_dir).select(
        "page_id", unescaped.alias("title"), F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1).alias("lang"), X.host("url").alias("host"),
        n("a").alias("links"), n("p").alias("paragraphs"), n("h1").alias("h1"), tokens.alias("tokens_chars4"), X.tokens_bytes4("html").alias("tokens_bytes4"),
        F.when(tokens > chunking.MAX_DOCUMENT, "too large").when(tokens <= 8000, "single").otherwise("chunks").alias("route"))


@query(f"SELECT page_id, trim({TITLE}) AS title FROM pages")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.titles(nodes(spark, sf_dir, "pre tag own_text"))


@query("SELECT page_id, element_type, n FROM (" + " UNION ALL ".join(
    f"SELECT page_id, '{k}' AS element_type, {' + '.join(count(t) for t in v.split())} AS n FROM pages"
    for k, v in ({t: t for t in represent.COUNTED} | represent.GROUPS).items()) + ")")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return represent.element_counts(nodes(spark, sf_dir, "tag"))


@query(f"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS x FROM pages),
m AS (SELECT page_id, {UNESCAPE.format("regexp_extract(x, 'href=\"([^\"]*)\"', 1)")} AS href, trim({UNESCAPE.format("regexp_extract(x, '>([^<]*)<', 1)")}) AS text FROM l)
SELECT page_id, href, text, count(*) OVER (PARTITION BY page_id, text) AS same_text FROM m""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.links(nodes(spark, sf_dir, "pre tag attrs text_concat")).drop("pre")


@query(f"""
SELECT page_id, 'article' AS selector, 'selector' AS method, {SPACES.format(UNESCAPE.format("regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')"))} AS text
FROM pages""")
def main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dom.main_content(nodes(spark, sf_dir, "pre tag attrs classes text parent_tag path selector_path"))
    return found.select("page_id", "selector", "method", X.clean_whitespace("text").alias("text"))


@query(f"""
SELECT page_id, 'navigation' AS area, 'nav' AS selector, {count('nav')} AS n FROM pages
UNION ALL SELECT page_id, 'interactive', 'a', {count('a')} FROM pages
UNION ALL SELECT page_id, 'interactive', '[href]', {count('a')} FROM pages""")
def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.areas(nodes(spark, sf_dir, "pre tag attrs classes path selector_path")).groupBy("page_id", "area", "selector").agg(F.count("*").alias("n"))


@query("SELECT page_id, 'footer' AS area, 'footer' AS selector, 'footer' AS tag FROM pages WHERE html LIKE '%<footer%'")
def header_and_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.header_and_footer(nodes(spark, sf_dir, "pre tag attrs classes selector_path")).select("page_id", "area", "selector", "tag")


@query(f"""
SELECT page_id, 'Content' AS element_type, {' + '.join(count(t) for t in 'p h1 ul li'.split())} AS n FROM pages
UNION ALL SELECT page_id, 'Container', {' + '.join(count(t) for t in 'nav div article footer'.split())} FROM pages
UNION ALL SELECT page_id, 'Interactive', {count('a')} FROM pages""")
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.type_distribution(nodes(spark, sf_dir, "tag attrs path depth")).where("element_type <> 'Unknown'")


@query("SELECT page_id, CASE WHEN html LIKE '%<article%' THEN 'article' WHEN lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) LIKE '%search%' THEN 'search-results' ELSE 'content' END AS page_type FROM pages")
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.page_types(nodes(spark, sf_dir, "pre tag attrs classes own_text text parent_tag path"))


@query()
def page_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.statistics(nodes(spark, sf_dir, "tag attrs path depth"))


@query()
def dom_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.elements(nodes(spark, sf_dir, "pre tag attrs classes own_text selector_path")).drop("attrs")


@query("SELECT page_id, 'lang' AS attribute, regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1) AS value FROM pages UNION ALL SELECT page_id, 'charset', regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) FROM pages")
def document_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir, "tag attrs").where(F.col("tag").isin("html", "meta"))
    pair = lambda k: F.struct(F.lit(k).alias("attribute"), attr(k).alias("value"))
    return n.select("page_id", F.explode(F.array(pair("lang"), pair("charset"))).alias("x")).select("page_id", "x.*").where("value is not null")


# Audit --------------------------------------------------------------------

#: What the rules read of a node.
AUDITED = "pre child_index tag attrs classes text text_concat n_child_nodes parent_tag path ancestors"
AUDIT_SQL = f"""
WITH t AS (SELECT page_id, html, trim({TITLE}) AS title FROM pages),
l AS (SELECT page_id, trim({UNESCAPE.format("regexp_extract(unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>')), '>([^<]*)<', 1)")}) AS text FROM pages),
m AS (SELECT page_id, text, count(*) OVER (PARTITION BY page_id, text) AS same FROM l),
issues AS (
  SELECT page_id, 'DocumentTitle' AS feature, 'Error' AS severity, 'Document title is empty' AS description FROM t WHERE title = ''
  UNION ALL SELECT page_id, 'DocumentTitle', 'Warning', 'Document title is very short and may not be descriptive' FROM t WHERE title <> '' AND strlen(title) < 5
  UNION ALL SELECT page_id, 'Aria', 'Info', 'Document does not use ARIA attributes' FROM t
  UNION ALL SELECT page_id, 'LandmarkRoles', 'Warning', 'Document is missing a main landmark' FROM t
  UNION ALL SELECT page_id, 'SkipNavigation', 'Warning', 'Document has navigation but no skip navigation link' FROM t
  UNION ALL SELECT page_id, 'SemanticStructure', 'Warning', 'Document does not use paragraph elements' FROM t WHERE html NOT LIKE '%<p>%'
  UNION ALL SELECT page_id, 'LinkText', 'Warning', 'Multiple links with identical text: ' || chr(39) || text || chr(39) FROM m WHERE text <> '' AND same > 1
  UNION ALL SELECT page_id, 'LinkText', 'Warning', 'Link has generic text: ' || chr(39) || text || chr(39) FROM m
    WHERE lower(text) IN ('click here', 'click', 'here', 'more', 'read more', 'details', 'link', 'this link', 'this page', 'learn more', 'more information', 'info')
  UNION ALL SELECT page_id, 'LinkText', 'Error', 'Link has no text content or accessible name' FROM m WHERE text = '')
"""


@query(AUDIT_SQL + "SELECT page_id, feature, severity, description FROM issues")
def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.issues(stored(nodes(spark, sf_dir, AUDITED), "nodes"))
    return found.select("page_id", "feature", "severity", "description")


@query(AUDIT_SQL + """,
c AS (SELECT page_id, count(*) FILTER (severity = 'Error') AS error, count(*) FILTER (severity = 'Warning') AS warning, count(*) FILTER (severity = 'Info') AS info
  FROM issues GROUP BY page_id),
s AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - 5.0::DOUBLE * error - 2.0::DOUBLE * warning - 0.5::DOUBLE * info)) AS score FROM c)
SELECT page_id, error, warning, info, score, CASE WHEN score >= 95 THEN 'AAA' WHEN score >= 85 THEN 'AA' WHEN score >= 70 THEN 'A' ELSE 'Failing' END AS grade FROM s""")
def audit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = pages(spark, sf_dir)
    found = audit.issues(stored(nodes(spark, sf_dir, AUDITED), "nodes"))
    return audit.scores(source, found).select("page_id", "error", "warning", "info", "score", "grade")


@query(f"""
SELECT page_id, trim({TITLE}) AS title, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS language, {count('a')} AS interactive, {count('img')} AS images, {count('form')} AS forms
FROM pages""")
def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = audit.page_facts(nodes(spark, sf_dir, AUDITED))
    return facts.select("page_id", "title", F.col("lang").alias("language"), "interactive", "images", "forms")


@query()
def audit_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.successes(stored(nodes(spark, sf_dir, AUDITED), "nodes"))


@query()
def audit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = stored(nodes(spark, sf_dir, AUDITED), "nodes")
    return audit.feature_scores(pages(spark, sf_dir), audit.issues(n), audit.successes(n))


@query()
def audit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, n = pages(spark, sf_dir), stored(nodes(spark, sf_dir, AUDITED), "nodes")
    found = audit.issues(n)
    return audit.summaries(audit.scores(source, found), audit.feature_scores(source, found, audit.successes(n)))


# Preprocessing ------------------------------------------------------------

def _nest(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
    return expr


REMOVE = [(f"(?s)<{t}[^>]*>.*?</{t}>", "") for t in preprocess.REMOVED] + [("<link[^>]*rel=[\"'']stylesheet[\"''][^>]*>", "")]
SIMPLIFY = [
    (r"<div[^>]*>\s*<div[^>]*>\s*<div[^>]*>\s*<div[^>]*>(.*?)</div>\s*</div>\s*</div>\s*</div>", r"<div>\1</div>"),
    (r"<span[^>]*>\s*<span[^>]*>\s*<span[^>]*>(.*?)</span>\s*</span>\s*</span>", r"<span>\1</span>")]
ENHANCE = [(f'<div[^>]*class="[^"]*(?:{n})[^"]*"[^>]*>(.*?)</div>', rf"<{t}>\1</{t}>") for t, n in preprocess.SEMANTIC.items()] + [
    ("<main([^>]*)>", r'<main\1 role="main">'), ("<nav([^>]*)>", r'<nav\1 role="navigation">')]
NORMALIZE = [(f'{n}="[^"]*"', n) for n in preprocess.BOOLEAN] + [(f'{n}="([^"]*)"', rf'data-event-{n}="\1"') for n in preprocess.EVENTS] + [
    # RE2 has no look-ahead: what may stay is marked first.
    (r'(href|src)="(http|#|data:)', r'\1=~"\2'), (r'(href|src)="/?([^"]+)"', r'\1="https://example.com/\2"'), (r'(href|src)=~"', r'\1="')]


@query(f"SELECT page_id, md5({_nest('html', REMOVE)}) AS digest FROM pages")
def remove_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.md5(preprocess.remove_elements("html").cast("binary")).alias("digest"))


@query(f"SELECT page_id, md5({_nest('html', NORMALIZE)}) AS digest FROM pages")
def normalize_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.md5(preprocess.normalize_attributes("html").cast("binary")).alias("digest"))


@query(f"SELECT page_id, md5({_nest('html', REMOVE + SIMPLIFY + ENHANCE + NORMALIZE)}) AS digest FROM pages")
def preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.md5(preprocess.preprocess("html").cast("binary")).alias("digest"))


CLUES = [
    (r"<a([^>]*)>([^<]*)</a>", r'<a\1 aria-description="Link to: \2">\2</a>'),
    (r"<(section|article|main|header|footer|nav|aside)([^>]*)>", r"<!-- Begin \1 --><\1\2>"), (r"</(section|article|main|header|footer|nav|aside)>", r"</\1><!-- End \1 -->")]


@query(f"SELECT page_id, md5({_nest('html', CLUES)}) AS digest FROM pages")
def context_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.md5(preprocess.add_context_clues("html").cast("binary")).alias("digest"))


MARKS = "replace(replace({}, '&copy;', chr(169)), '&middot;', chr(183))"


@query(f"SELECT page_id, {SPACES.format(UNESCAPE.format(MARKS.format(_nest('html', [('(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>|(?s)<!--.*?-->', ' '), ('<[^>]+>', ' ')]))))} AS text FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.html_to_text(pages(spark, sf_dir))


@query()
def fixed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.fix_unclosed(pages(spark, sf_dir))


@query("SELECT page_id, html LIKE '%<article%' AS kept, CAST(0 AS BIGINT) AS boilerplate FROM pages")
def without_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = preprocess.remove_boilerplate(pages(spark, sf_dir))
    return left.select("page_id", (F.col("html").contains("<article>")).alias("kept"), F.regexp_count("html", F.lit('<nav|<footer|class="ad"')).cast("long").alias("boilerplate"))


@query()
def main_content_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.main_content_html(pages(spark, sf_dir))


# Representations ----------------------------------------------------------

@query(f"""
SELECT page_id, 'Title: ' || {TITLE} || chr(10) || chr(10) || 'Page Structure:' || chr(10) || '- Has navigation menu' || chr(10) || '- Has main content area' || chr(10)
  || '- Has footer section' || chr(10) || '- Contains ' || {count('a')} || ' interactive elements' || chr(10) || chr(10) || 'Heading Structure:' || chr(10)
  || '- H1: ' || {count('h1')} || ' headings' || chr(10) AS summary
FROM pages""")
def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return represent.page_summary(nodes(spark, sf_dir, "pre tag attrs classes text_concat"))


@query()
def representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return represent.represent(pages(spark, sf_dir))


@query()
def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return represent.outline(nodes(spark, sf_dir, "pre parent_pre tag text_concat"))


@query()
def element_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return represent.element_table(nodes(spark, sf_dir, "pre tag attrs text"))


@query("SELECT page_id, name, value FROM (SELECT page_id, 'title' AS name, " + TITLE + " AS value FROM pages UNION ALL " + " UNION ALL ".join(
    f"SELECT page_id, 'count_{k}', CAST({' + '.join(count(t) for t in v.split())} AS VARCHAR) FROM pages" for k, v in ({t: t for t in represent.COUNTED} | represent.GROUPS).items()) + ")")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return represent.page_metadata(nodes(spark, sf_dir, "pre tag attrs text_concat"))


@query()
def important_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return represent.important_elements(nodes(spark, sf_dir, "pre tag text"))


@query()
def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.markdown(pages(spark, sf_dir))


# Chunks -------------------------------------------------------------------

@query(f"SELECT page_id, CAST(len(regexp_extract_all(html, '{chunking.INTERACTIVE_MARKS}')) AS BIGINT) AS marks FROM pages")
def interactive_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", chunking.interactive_marks("html").cast("long").alias("marks"))


@query()
def section_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.importance(chunking.sections(pages(spark, sf_dir))).drop("content", "text")


def _chunks(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    options = chunking.Options(strategy=strategy, max_tokens=400, min_tokens=100, overlap=50)
    return chunking.chunk(pages(spark, sf_dir), options)


@query()
def size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "size")


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "semantic")


@query()
def hierarchical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "hierarchical")


@query()
def adaptive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "adaptive")


@query()
def chunk_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.relations(_chunks(spark, sf_dir, "size"))


@query(f"SELECT page_id, trim({UNESCAPE.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) AS heading FROM pages")
def chunk_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.heading("html")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        found = F.replace(found, F.lit(a), F.lit(b))
    return pages(spark, sf_dir).select("page_id", F.coalesce(found, F.lit("")).alias("heading"))
