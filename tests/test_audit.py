from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import audit, dom


def run(spark, *pages, contrast=False):
    source = spark.createDataFrame([(k, "u", h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    nodes = dom.dom_nodes(source).cache()
    return source, nodes, audit.issues(nodes, contrast)


def has(found, page, severity, text):
    return any(r.page_id == page and r.severity == severity and text in r.description for r in found)


def test_rules(spark):
    pages = [
        "<html><body><h1>A</h1><h3>B</h3><h2></h2><main><p></p></main>",  # 0: no title, no lang, skipped level, empty heading, main without heading
        '<html lang="e"><title>Abc</title><img src=a.png><img alt="" src=logo.png><img alt="Image of x"><img alt="' + "y" * 101 + '">',
        '<html lang=en><title>Title here</title><label for=a>L</label><input id=a><input placeholder=p><input title=t><input type=email required><input type=hidden><select aria-label=s></select>',
        '<button aria-hidden="true">x</button><div role="bogus" aria-label=z></div><button role=button aria-label=q>b</button><div role=slider aria-valuemin=1></div>',
        '<a href=1></a><a href=2><img alt=i></a><a href=3>click here</a><a href=4>Same</a><a href=5>Same</a><a role=button></a>',
        "<table><tr><td>1</table><table role=presentation></table><table><caption>c</caption><tr><th scope=col>h<td rowspan=2>x</table><table><tr><th>h</table>",
        "<main></main><main></main><div role=banner></div><div role=banner></div><nav></nav>",
        "<ul></ul><div><li>o</li></div><dl><dt>t</dl><div tabindex=5 onclick=f()></div><object></object>",
        "<body><a href='#m'>Skip to main content</a><nav>n</nav><p>x",
        "<p style='color: #777; background-color: #fff'>a<p style='color:#000;background-color:#ffffff'>b<h1 style='color:#777;background-color:#fff'>c",
    ]
    source, nodes, found = run(spark, *pages, contrast=True)
    rows = found.collect()
    for page, severity, text in [
        (0, "Error", "missing a title"), (0, "Error", "missing lang"), (0, "Warning", "from h1 to h3"), (0, "Error", "Empty heading"), (0, "Warning", "no headings"),
        (0, "Info", "1 empty paragraph"), (1, "Warning", "very short"), (1, "Warning", "potentially invalid lang attribute: 'e'"), (1, "Error", "missing alt"),
        (1, "Warning", "Potentially meaningful"), (1, "Warning", "generic alt text: 'Image of x'"), (1, "Warning", "very long alt"), (1, "Warning", "no headings"),
        (2, "Warning", "only on placeholder"), (2, "Warning", "only on title"), (2, "Error", "(email type)"), (2, "Warning", "required fields"),
        (3, "Error", "aria-hidden='true' used"), (3, "Error", "Invalid ARIA role: 'bogus'"), (3, "Warning", "Redundant ARIA role 'button' on <button>"),
        (3, "Error", "'aria-valuemax' for role 'slider'"), (3, "Error", "'aria-valuenow'"), (4, "Error", "Link has no text"), (4, "Warning", "generic text: 'click here'"),
        (4, "Warning", "identical text: 'Same'"), (5, "Error", "no header cells"), (5, "Warning", "without scope"), (5, "Warning", "missing a caption"), (5, "Info", "no description"),
        (5, "Warning", "spanning cells"), (6, "Warning", "multiple main landmarks (2)"), (6, "Warning", "banner landmarks (2)"), (6, "Warning", "no skip navigation"),
        (7, "Warning", "1 empty list"), (7, "Error", "1 list items outside"), (7, "Warning", "Definition list"), (7, "Warning", "1 elements with positive tabindex"),
        (7, "Error", "onclick event"), (7, "Warning", "embedded objects"), (7, "Warning", "paragraph elements"), (9, "Warning", "contrast ratio: 4.48:1"),
    ]:
        assert has(rows, page, severity, text), (page, severity, text)
    assert sum("identical text" in r.description for r in rows) == 2
    assert sum("contrast" in r.description for r in rows) == 1  # large text needs less
    assert not has(rows, 3, "Error", "'aria-valuemin'") and not has(rows, 8, "Warning", "skip") and not has(rows, 2, "Error", "(text type)")
    good = {(r.page_id, r.description) for r in audit.successes(nodes).collect()}
    assert (0, "Document has a single main heading (h1)") in good and (2, "Document has a descriptive title") in good and (8, "Document has a skip navigation link") in good
    assert (5, "Document has properly structured tables with accessibility features") not in good


def test_scores(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id long")
    issues = spark.createDataFrame([(1, "AltText", "Critical"), (1, "FormLabels", "Error"), (2, "Aria", "Info")], "page_id long, feature string, severity string")
    got = {r.page_id: (r.score, r.grade) for r in audit.scores(pages, issues).collect()}
    assert got == {1: (85.0, "A"), 2: (99.5, "AAA"), 3: (100.0, "AAA")}
    none = spark.createDataFrame([], "page_id long, feature string")
    by = {(r.page_id, r.feature): r.feature_score for r in audit.feature_scores(pages, issues, none).collect()}
    assert by[(1, "AltText")] == 80.0 and by[(1, "FormLabels")] == 90.0 and by[(2, "Aria")] == 100.0 and len(by) == 30
    text = {r.page_id: r.summary for r in audit.summaries(audit.scores(pages, issues), audit.feature_scores(pages, issues, none)).collect()}
    assert text[1].startswith("Accessibility Score: 85.0% (Grade: A)\n\nIssues by Severity:\n- Critical: 1\n") and text[1].rstrip().endswith("- AltText: 80.0%")


def test_colours(spark):
    row = spark.range(1).select(
        F.round(X.contrast(X.rgb(F.lit("#777")), X.rgb(F.lit("#fff"))), 6).alias("a"), X.contrast(X.rgb(F.lit("black")), X.rgb(F.lit("rgb(255, 255, 255)"))).alias("b"),
        X.rgb(F.lit("rgba(1,2,3,.5)")).alias("c"), X.rgb(F.lit("#01020380")).alias("d"), X.rgb(F.lit("nope")).alias("e"), X.rgb(F.lit("rgb(300,0,0)")).alias("f"),
        X.style_value(F.lit("background-color: red; color : Blue"), "color").alias("g"), X.is_large_text(F.lit("font-size: 24px"), F.lit("p")).alias("h"),
        X.is_large_text(F.lit("font-size: 17pt"), F.lit("h1")).alias("i"), X.is_large_text(F.lit(""), F.lit("h2")).alias("j")).first()
    assert row.a == 4.478089 and abs(row.b - 21) < 1e-9 and tuple(row.c) == (1, 2, 3) == tuple(row.d) and row.e is None and row.f is None
    assert row.g == "Blue" and row.h and not row.i and row.j
