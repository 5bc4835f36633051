"""Accessibility audit over the node table.

Rules about the page as a whole come from one aggregate by page, rules about an
element from a projection of its row; only duplicate link texts and heading
order need the rows of a page together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions import text as X
from weftline.functions.css import attr, css

# Names, references and word lists of the rules.
SEVERITIES = ("Info", "Warning", "Error", "Critical")
SCORED_FEATURES = (
    "Aria", "Headings", "AltText", "FormLabels", "KeyboardNavigation", "ColorContrast", "SemanticStructure", "LinkText", "TableAccessibility",
    "LandmarkRoles")
GENERIC_LINKS = "click here|click|here|more|read more|details|link|this link|this page|learn more|more information|info".split("|")
ROLES = (
    "alert alertdialog application article banner button cell checkbox columnheader combobox complementary contentinfo definition dialog "
    "directory document feed figure form grid gridcell group heading img link list listbox listitem log main marquee math menu menubar "
    "menuitem menuitemcheckbox menuitemradio navigation none note option presentation progressbar radio radiogroup region row rowgroup "
    "rowheader scrollbar search searchbox separator slider spinbutton status switch tab table tablist tabpanel term textbox timer toolbar "
    "tooltip tree treegrid treeitem").split()
REDUNDANT_ROLES = (
    "button:button a:link h1:heading h2:heading h3:heading h4:heading h5:heading h6:heading img:img ul:list ol:list li:listitem "
    "nav:navigation main:main aside:complementary header:banner footer:contentinfo").split()
REQUIRED_ARIA = {
    "checkbox": ["aria-checked"], "switch": ["aria-checked"], "combobox": ["aria-expanded"],
    "slider": ["aria-valuemin", "aria-valuemax", "aria-valuenow"], "spinbutton": ["aria-valuemin", "aria-valuemax", "aria-valuenow"],
}
LANDMARKS = "[role='banner'], [role='navigation'], [role='main'], [role='complementary'], [role='contentinfo'], nav, main, header, footer, aside"
TITLED, LANG, INFO = "2.4.2 Page Titled (Level A)", "3.1.1 Language of Page (Level A)", "1.3.1 Info and Relationships (Level A)"
LABELS, HEADS = "2.4.6 Headings and Labels (Level AA)", "1.3.1 Info and Relationships (Level A), 2.4.6 Headings and Labels (Level AA)"
NON_TEXT, ROLE_VALUE = "1.1.1 Non-text Content (Level A)", "4.1.2 Name, Role, Value (Level A)"
INSTRUCTED = "1.3.1 Info and Relationships (Level A), 3.3.2 Labels or Instructions (Level A)"
LINK, BYPASS = "2.4.4 Link Purpose (In Context) (Level A)", "1.3.1 Info and Relationships (Level A), 2.4.1 Bypass Blocks (Level A)"

ISSUE = ("feature", "severity", "description", "element_path", "wcag_reference")


def _text(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


def _issue(when: Column, feature: str, severity: str, description, path, wcag) -> Column:
    values = (feature, severity, description, path, wcag)
    return F.when(when, F.struct(*[_text(v).alias(n) for n, v in zip(ISSUE, values, strict=True)]))


def _rows(frame: DataFrame, issues: list[Column]) -> DataFrame:
    found = frame.select("page_id", F.explode(F.array_compact(F.array(*issues))).alias("i"))
    return found.select("page_id", "i.*")


def _path() -> Column:
    own = F.get("classes", F.lit(0))
    return F.when(attr("id").isNotNull(), F.concat("tag", F.lit("#"), attr("id"))).when(
        own.isNotNull(), F.concat("tag", F.lit("."), own)).otherwise(F.col("tag"))


def _inside(tag: str) -> Column:
    return F.array_contains(F.slice("path", 1, F.size("path") - 1), tag)


def _any_aria() -> Column:
    return css("[aria-*]")


def _label_needed() -> Column:
    return css("input, select, textarea") & ~F.coalesce(attr("type"), F.lit("text")).isin("hidden", "submit", "button", "reset", "image")


def page_facts(nodes: DataFrame) -> DataFrame:
    """One row a page: the counts that rules about whole pages need."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    of = lambda s: n(css(s))
    title, lang = F.col("tag") == "title", F.when(F.col("tag") == "html", attr("lang"))
    text = F.lower("text_concat")
    skip = (F.col("tag") == "a") & F.coalesce(attr("href").startswith("#"), F.lit(False)) & (F.col("child_index") == 0) & (
        text.contains("skip") | text.contains("jump") | text.contains("main content"))
    keyed = attr("onkeydown").isNotNull() | attr("onkeypress").isNotNull() | attr("onkeyup").isNotNull()
    native = F.col("tag").isin("a", "button", "input", "select", "textarea")
    return nodes.groupBy("page_id").agg(
        n(title).alias("titles"), F.min_by(F.when(title, F.trim("text_concat")), F.when(title, F.col("pre"))).alias("title"),
        F.max(lang).alias("lang"), n((F.col("tag") == "html") & attr("lang").isNotNull()).alias("has_lang"),
        n(attr("lang").isNotNull() & (F.col("tag") != "html")).alias("other_lang"),
        of("h1, h2, h3, h4, h5, h6").alias("headings"), of("h1").alias("h1"), of("main, [role='main']").alias("main"),
        n(css("h1, h2, h3, h4, h5, h6") & (_inside("main"))).alias("main_headings"), of("nav, [role='navigation']").alias("nav"),
        of("[role='banner']").alias("banner"), of("[role='contentinfo']").alias("contentinfo"), of(LANDMARKS).alias("landmarks"),
        n(_any_aria()).alias("aria"), of("article, section, aside, figure, figcaption, time, mark, details, summary").alias("semantic"),
        of("ul").alias("ul"), of("ol").alias("ol"), of("dl").alias("dl"), of("ul:empty, ol:empty, dl:empty").alias("empty_lists"),
        of("body > li, div > li, p > li").alias("orphans"), of("p").alias("p"), of("p:empty").alias("empty_p"),
        n(attr("tabindex").try_cast("int") > 0).alias("tabindex"), of("object, embed, applet").alias("embedded"),
        n(attr("onclick").isNotNull() & ~keyed & ~native).alias("click_only"),
        n(attr("onclick").isNotNull()).alias("onclick"), n(attr("onkeydown").isNotNull()).alias("onkeydown"),
        n(attr("onkeypress").isNotNull()).alias("onkeypress"), n(attr("onkeyup").isNotNull()).alias("onkeyup"),
        n(skip).alias("skip"), n(css("input[required], [aria-required='true']")).alias("required"),
        n((F.col("tag") == "form") & F.col("text").contains("*") | _inside("form") & css(".required, .mandatory, .asterisk")).alias("explained"),
        of("a, button, [role='button'], input, select, textarea, [tabindex]").alias("interactive"), of("img").alias("images"),
        of("form").alias("forms"), F.max(F.when(F.col("tag") == "body", F.col("n_child_nodes"))).alias("body_child_nodes"),
    )


def _page_issues(facts: DataFrame) -> DataFrame:
    f = F.col
    title_bytes, lists = F.octet_length("title"), f("ul") + f("ol") + f("dl")
    lang_bytes = F.octet_length("lang")
    told = lambda template, *cols: F.format_string(template, *cols)
    marked = f("landmarks") > 0
    return _rows(facts, [
        _issue(f("titles") == 0, "DocumentTitle", "Error", "Document is missing a title", "html > head", TITLED),
        _issue(f("titles") > 1, "DocumentTitle", "Warning", "Document has multiple title elements", "html > head", TITLED),
        _issue((f("titles") == 1) & (f("title") == ""), "DocumentTitle", "Error", "Document title is empty", "html > head > title", TITLED),
        _issue((f("titles") == 1) & (title_bytes > 0) & (title_bytes < 5), "DocumentTitle", "Warning",
               "Document title is very short and may not be descriptive", "html > head > title", TITLED),
        _issue(f("has_lang") == 0, "LanguageSpecification", "Error", "HTML element is missing lang attribute", "html", LANG),
        _issue((f("has_lang") > 0) & (F.trim("lang") == ""), "LanguageSpecification", "Warning", "HTML element has empty lang attribute", "html", LANG),
        _issue((f("has_lang") > 0) & (F.trim("lang") != "") & ((lang_bytes < 2) | (lang_bytes > 35)), "LanguageSpecification", "Warning",
               F.concat(F.lit("HTML element has potentially invalid lang attribute: '"), "lang", F.lit("'")), "html", LANG),
        _issue(f("headings") == 0, "Headings", "Warning", "Document has no headings", "body", HEADS),
        _issue((f("headings") > 0) & (f("h1") == 0), "Headings", "Error", "Document has no main heading (h1)", "body", HEADS),
        _issue(f("h1") > 1, "Headings", "Warning", told("Document has multiple main headings (%d)", "h1"), "h1", INFO),
        _issue((f("headings") > 0) & (f("main") > 0) & (f("main_headings") == 0), "Headings", "Warning", "Main content area has no headings", "main", INFO),
        _issue((f("required") > 0) & (f("explained") == 0), "FormLabels", "Warning",
               "Form has required fields but no explanation of required field indicators", "form", "3.3.2 Labels or Instructions (Level A)"),
        _issue(f("aria") == 0, "Aria", "Info", "Document does not use ARIA attributes", "document", None),
        _issue(~marked, "LandmarkRoles", "Warning", "Document does not use landmark roles or semantic elements", "body", BYPASS),
        _issue(marked & (f("main") == 0), "LandmarkRoles", "Warning", "Document is missing a main landmark", "body", BYPASS),
        _issue(marked & (f("nav") == 0), "LandmarkRoles", "Info", "Document does not have a navigation landmark", "body", INFO),
        _issue(f("banner") > 1, "LandmarkRoles", "Warning", told("Document has multiple banner landmarks (%d)", "banner"),
               "header[role='banner'], [role='banner']", INFO),
        _issue(f("main") > 1, "LandmarkRoles", "Warning", told("Document has multiple main landmarks (%d)", "main"), "main, [role='main']", INFO),
        _issue(f("contentinfo") > 1, "LandmarkRoles", "Warning", told("Document has multiple contentinfo landmarks (%d)", "contentinfo"),
               "footer[role='contentinfo'], [role='contentinfo']", INFO),
        _issue(f("semantic") == 0, "SemanticStructure", "Info", "Document does not use HTML5 semantic elements", "body", INFO),
        _issue((lists > 0) & (f("empty_lists") > 0), "SemanticStructure", "Warning", told("Document has %d empty list elements", "empty_lists"),
               "ul:empty, ol:empty, dl:empty", INFO),
        _issue((lists > 0) & (f("orphans") > 0), "SemanticStructure", "Error", told("Document has %d list items outside of a list container", "orphans"),
               "body > li, div > li, p > li", INFO),
        _issue(f("p") == 0, "SemanticStructure", "Warning", "Document does not use paragraph elements", "body", INFO),
        _issue(f("empty_p") > 0, "SemanticStructure", "Info", told("Document has %d empty paragraph elements", "empty_p"), "p:empty", None),
        _issue(f("tabindex") > 0, "KeyboardNavigation", "Warning", told("Document has %d elements with positive tabindex values", "tabindex"),
               "[tabindex]", "2.4.3 Focus Order (Level A)"),
        _issue(f("embedded") > 0, "KeyboardNavigation", "Warning", "Document contains embedded objects that may create keyboard traps",
               "object, embed, applet", "2.1.2 No Keyboard Trap (Level A)"),
        _issue((f("skip") == 0) & (f("nav") > 0), "SkipNavigation", "Warning", "Document has navigation but no skip navigation link", "body",
               "2.4.1 Bypass Blocks (Level A)"),
    ])


def _element_issues(nodes: DataFrame, contrast_check: bool) -> DataFrame:
    tag, alt, src = F.col("tag"), F.trim(attr("alt")), F.coalesce(attr("src"), F.lit(""))
    path = _path()
    img, low = tag == "img", F.lower(F.trim(attr("alt")))
    generic = low.contains("image of") | low.contains("picture of") | low.isin("image", "photo")
    heading = tag.rlike("^h[1-6]$")
    role = attr("role")
    aria = _any_aria()
    hidden = aria & (attr("aria-hidden") == "true") & (tag.isin("a", "button", "input", "select", "textarea") | attr("tabindex").isNotNull())
    open_ = aria & ~F.coalesce(hidden, F.lit(False)) & role.isNotNull()
    valid = role.isin(ROLES)
    same_input = (tag == "input") & ((role == "textbox") & (F.coalesce(attr("type"), F.lit("text")) == "text") | role.isin("checkbox", "radio") & (attr("type") == role))
    redundant = F.concat_ws(":", "tag", role).isin(REDUNDANT_ROLES) | F.coalesce(same_input, F.lit(False))
    keyed = attr("onkeydown").isNotNull() | attr("onkeypress").isNotNull() | attr("onkeyup").isNotNull()
    issues = [
        _issue(img & alt.isNull(), "AltText", "Error", "Image is missing alt attribute", path, NON_TEXT),
        _issue(img & (alt == "") & (src.contains("logo") | src.contains("banner") | src.contains("icon")), "AltText", "Warning",
               "Potentially meaningful image has empty alt text", path, NON_TEXT),
        _issue(img & (alt != "") & generic, "AltText", "Warning", F.concat(F.lit("Image has generic alt text: '"), alt, F.lit("'")), path, NON_TEXT),
        _issue(img & ~generic & (F.octet_length(alt) > 100), "AltText", "Warning", "Image has very long alt text", path, NON_TEXT),
        _issue(heading & (F.trim("text_concat") == ""), "Headings", "Error", "Empty heading found", path, LABELS),
        _issue(hidden, "Aria", "Error", "aria-hidden='true' used on focusable element", path, ROLE_VALUE),
        _issue(open_ & ~valid, "Aria", "Error", F.concat(F.lit("Invalid ARIA role: '"), role, F.lit("'")), path, ROLE_VALUE),
        _issue(open_ & valid & redundant, "Aria", "Warning", F.concat(F.lit("Redundant ARIA role '"), role, F.lit("' on <"), "tag", F.lit("> element")), path, None),
        _issue(attr("onclick").isNotNull() & ~keyed & ~tag.isin("a", "button", "input", "select", "textarea"), "KeyboardNavigation", "Error",
               "Element has onclick event but no keyboard event handlers", path, "2.1.1 Keyboard (Level A)"),
    ]
    for name, required in REQUIRED_ARIA.items():
        issues += [_issue(open_ & (role == name) & attr(r).isNull(), "Aria", "Error", f"Missing required ARIA attribute '{r}' for role '{name}'", path, ROLE_VALUE)
                   for r in required]
    if contrast_check:
        style = attr("style")
        ratio = X.contrast(X.rgb(X.style_value(style, "color")), X.rgb(X.style_value(style, "background-color")))
        least = F.when(X.is_large_text(style, "tag"), 3.0).otherwise(4.5)
        text = F.format_string("Element has insufficient contrast ratio: %.2f:1 (minimum should be %.1f:1)", ratio, least)
        issues.append(_issue(ratio < least, "ColorContrast", "Warning", text, path, "1.4.3 Contrast (Minimum) (Level AA)"))
    return _rows(nodes, issues)


def _children_flags(nodes: DataFrame, of: str, flags: dict[str, Column]) -> DataFrame:
    """For each ``of`` element, whether any element below it has each flag."""
    inner = nodes.where(reduce(lambda a, b: a | b, flags.values())).select(
        "page_id", F.explode("ancestors").alias("pre"), *[c.alias(k) for k, c in flags.items()])
    inner = inner.groupBy("page_id", "pre").agg(*[F.bool_or(k).alias(k) for k in flags])
    own = nodes.where(F.col("tag") == of).select("page_id", "pre", "tag", "attrs", "classes")
    found = own.join(inner, ["page_id", "pre"], "left")
    return found.select("page_id", "pre", "tag", "attrs", "classes", *[F.coalesce(k, F.lit(False)).alias(k) for k in flags])


def _tables(nodes: DataFrame) -> DataFrame:
    flags = {
        "th": css("th"), "thead": css("thead"), "no_scope": (F.col("tag") == "th") & attr("scope").isNull(), "caption": css("caption"),
        "spans": css("th[rowspan], th[colspan], td[rowspan], td[colspan]"), "ids": css("th[id], td[headers]"),
    }
    found = _children_flags(nodes, "table", flags)
    return found.where(~F.coalesce(attr("role").isin("presentation", "none"), F.lit(False)))


def _table_issues(tables: DataFrame) -> DataFrame:
    f, path, kind = F.col, _path(), "TableAccessibility"
    described = attr("summary").isNotNull() | attr("aria-describedby").isNotNull()
    return _rows(tables, [
        _issue(~f("th") & ~f("thead"), kind, "Error", "Table has no header cells (th) or header section (thead)", path, INFO),
        _issue(f("no_scope") & f("th"), kind, "Warning", "Table has header cells (th) without scope attribute", path, INFO),
        _issue(~f("caption"), kind, "Warning", "Table is missing a caption", path, INFO),
        _issue(~f("caption") & ~described, kind, "Info", "Table has no description (caption, summary, or aria-describedby)", path, INFO),
        _issue(f("spans") & ~f("ids"), kind, "Warning", "Complex table (with spanning cells) does not use id/headers attributes", path, INFO),
    ])


def _definition_issues(nodes: DataFrame) -> DataFrame:
    lists = _children_flags(nodes, "dl", {"dt": css("dt"), "dd": css("dd")})
    return _rows(lists, [_issue(~F.col("dt") | ~F.col("dd"), "SemanticStructure", "Warning",
                                "Definition list is missing term (dt) or description (dd) elements", _path(), INFO)])


def _labelled(nodes: DataFrame) -> DataFrame:
    """Form inputs with how they are labelled: good, placeholder, title or none."""
    labels = nodes.where((F.col("tag") == "label") & attr("for").isNotNull()).select("page_id", attr("for").alias("id"), F.lit(True).alias("named")).distinct()
    inputs = nodes.where(_label_needed()).withColumn("id", attr("id"))
    kind = (
        F.when(F.col("named") | (F.trim(attr("aria-label")) != "") | attr("aria-labelledby").isNotNull(), "good")
        .when(F.trim(attr("placeholder")) != "", "placeholder").when(F.trim(attr("title")) != "", "title").otherwise("none"))
    return inputs.join(labels, ["page_id", "id"], "left").withColumn("label_kind", kind)


def _label_issues(inputs: DataFrame) -> DataFrame:
    kind, path = F.col("label_kind"), _path()
    only = "Input relies only on {} for labeling".format
    return _rows(inputs, [
        _issue(kind == "placeholder", "FormLabels", "Warning", only("placeholder"), path, INSTRUCTED),
        _issue(kind == "title", "FormLabels", "Warning", only("title attribute"), path, INSTRUCTED),
        _issue(kind == "none", "FormLabels", "Error",
               F.concat(F.lit("Input element ("), F.coalesce(attr("type"), F.lit("text")), F.lit(" type) has no associated label")), path, INSTRUCTED),
    ])


def _heading_steps(nodes: DataFrame) -> DataFrame:
    """Headings with the highest level number before them."""
    level = F.substring("tag", 2, 1).cast("int")
    before = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    found = nodes.where(F.col("tag").rlike("^h[1-6]$")).withColumn("level", level)
    return found.withColumn("before", F.max("level").over(before))


def _heading_issues(steps: DataFrame) -> DataFrame:
    skipped = F.col("level") > F.col("before") + 1
    return _rows(steps, [_issue(skipped, "Headings", "Warning", F.format_string("Heading level skipped from h%d to h%d", "before", "level"), _path(), INFO)])


def _links(nodes: DataFrame) -> DataFrame:
    """Links with their text, how many links share it and what stands in for it."""
    alt = nodes.where((F.col("tag") == "img") & attr("alt").isNotNull()).select("page_id", F.explode("ancestors").alias("pre"), F.lit(True).alias("img")).distinct()
    text = F.trim("text_concat")
    found = nodes.where(F.col("tag") == "a").withColumn("link", text).withColumn("same", F.count("*").over(Window.partitionBy("page_id", "link")))
    named = (F.trim(attr("aria-label")) != "") | (attr("aria-label").isNull() & (F.trim(attr("title")) != "")) | (
        attr("aria-label").isNull() & attr("title").isNull() & F.col("img"))
    found = found.where(~F.coalesce(attr("role") == "button", F.lit(False))).join(alt, ["page_id", "pre"], "left")
    kind = (
        F.when(F.col("link") != "", F.when(F.lower("link").isin(GENERIC_LINKS), "generic").otherwise("good"))
        .when(F.coalesce(named, F.lit(False)), "good")
        .when(attr("aria-label").isNull() & attr("title").isNull(), "empty").otherwise("blank"))
    return found.withColumn("link_kind", kind)


def _link_issues(links: DataFrame) -> DataFrame:
    kind, path = F.col("link_kind"), _path()
    quoted = lambda lead: F.concat(F.lit(f"{lead}: '"), "link", F.lit("'"))
    return _rows(links, [
        _issue(kind == "empty", "LinkText", "Error", "Link has no text content or accessible name", path, LINK),
        _issue(kind == "generic", "LinkText", "Warning", quoted("Link has generic text"), path, f"{LINK}, 2.4.9 Link Purpose (Link Only) (Level AAA)"),
        _issue((F.col("link") != "") & (F.col("same") > 1), "LinkText", "Warning", quoted("Multiple links with identical text"), path, LINK),
    ])


def issues(nodes: DataFrame, contrast_check: bool = False) -> DataFrame:
    """(page_id, feature, severity, description, element_path, wcag_reference)."""
    parts = [
        _page_issues(page_facts(nodes)), _element_issues(nodes, contrast_check), _heading_issues(_heading_steps(nodes)), _link_issues(_links(nodes)),
        _label_issues(_labelled(nodes)), _table_issues(_tables(nodes)), _definition_issues(nodes)]
    return reduce(DataFrame.unionByName, parts)


def successes(nodes: DataFrame) -> DataFrame:
    """(page_id, feature, description, element_reference) of rules that hold."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    alt, low = F.trim(attr("alt")), F.lower(F.trim(attr("alt")))
    bad_alt = low.contains("image of") | low.contains("picture of") | low.isin("image", "photo") | (F.octet_length(alt) > 100)
    src = F.coalesce(attr("src"), F.lit(""))
    plain = (alt == "") & attr("src").isNotNull() & ~src.contains("logo") & ~src.contains("banner") & ~src.contains("icon")
    role = attr("role")
    hidden = (attr("aria-hidden") == "true") & (F.col("tag").isin("a", "button", "input", "select", "textarea") | attr("tabindex").isNotNull())
    images = nodes.groupBy("page_id").agg(
        n((F.col("tag") == "img") & alt.isNull()).alias("no_alt"), n((F.col("tag") == "img") & (alt != "") & ~bad_alt).alias("good_alt"),
        n((F.col("tag") == "img") & plain).alias("decorative"),
        n(_any_aria() & ~F.coalesce(hidden, F.lit(False)) & (role.isNull() | role.isin(ROLES))).alias("good_aria"))
    count = lambda frame, column, *kinds: frame.groupBy("page_id").agg(*[n(F.col(column) == k).alias(f"{column}_{k}") for k in kinds])
    described = attr("summary").isNotNull() | attr("aria-describedby").isNotNull()
    good_table = F.col("th") & (F.col("caption") | described) & (~F.col("spans") | F.col("ids"))
    facts = (
        page_facts(nodes).join(images, "page_id")
        .join(count(_links(nodes), "link_kind", "empty", "generic", "good"), "page_id", "left")
        .join(count(_labelled(nodes), "label_kind", "none", "good"), "page_id", "left")
        .join(_tables(nodes).groupBy("page_id").agg(n(good_table).alias("good_tables")), "page_id", "left")
        .join(_heading_steps(nodes).groupBy("page_id").agg(n(F.col("level") > F.col("before") + 1).alias("skipped")), "page_id", "left"))
    f = F.col
    lists = f("ul") + f("ol") + f("dl")

    def good(when: Column, feature: str, description: str, reference: Column | str) -> Column:
        return F.when(when, F.struct(F.lit(feature).alias("feature"), F.lit(description).alias("description"), _text(reference).alias("element_reference")))

    told = F.format_string
    found = [
        good((f("titles") == 1) & (F.octet_length("title") >= 5), "DocumentTitle", "Document has a descriptive title",
             F.concat(F.lit('Title: "'), "title", F.lit('"'))),
        good((f("has_lang") > 0) & (F.trim("lang") != "") & F.octet_length("lang").between(2, 35), "LanguageSpecification",
             "Document language is specified", F.concat(F.lit("Language: "), "lang")),
        good(f("other_lang") > 0, "LanguageSpecification", "Document uses lang attributes for content in different languages",
             told("%d elements with language specifications", "other_lang")),
        good(f("h1") == 1, "Headings", "Document has a single main heading (h1)", "h1"),
        good((f("headings") > 0) & (f("skipped") == 0), "Headings", "Document has a proper heading hierarchy without skipped levels",
             told("%d headings", "headings")),
        good((f("no_alt") == 0) & (f("good_alt") > 0), "AltText", "All images have alt attributes",
             told("%d images with good alt text, %d decorative images", "good_alt", "decorative")),
        good((f("label_kind_none") == 0) & (f("label_kind_good") > 0), "FormLabels", "All form inputs have associated labels",
             told("%d inputs with labels", "label_kind_good")),
        good((f("aria") > 0) & (f("good_aria") > 0), "Aria", "Document uses ARIA attributes to enhance accessibility",
             told("%d elements with ARIA attributes", "good_aria")),
        good((f("link_kind_empty") == 0) & (f("link_kind_generic") == 0) & (f("link_kind_good") > 0), "LinkText", "All links have descriptive text",
             told("%d links with descriptive text", "link_kind_good")),
        good(f("good_tables") > 0, "TableAccessibility", "Document has properly structured tables with accessibility features",
             told("%d accessible tables", "good_tables")),
        good((f("main") > 0) & (f("nav") > 0), "LandmarkRoles", "Document uses landmark roles to define page regions",
             told("%d landmarks identified", "landmarks")),
        good(f("semantic") > 0, "SemanticStructure", "Document uses HTML5 semantic elements", "article, section, aside, etc."),
        good((lists > 0) & (f("orphans") == 0), "SemanticStructure", "Document uses proper list structures",
             told("%d lists (UL: %d, OL: %d, DL: %d)", lists, "ul", "ol", "dl")),
        good(f("skip") > 0, "KeyboardNavigation", "Document has a skip navigation link", "Skip to content link"),
        good((f("click_only") == 0) & (f("tabindex") == 0) & (f("embedded") == 0), "KeyboardNavigation", "Document has good keyboard navigation support",
             told("%d keyboard-accessible interactive elements", f("onclick") + f("onkeydown") + f("onkeypress") + f("onkeyup"))),
    ]
    return facts.select("page_id", F.explode(F.array_compact(F.array(*found))).alias("s")).select("page_id", "s.*")


def scores(pages: DataFrame, found: DataFrame) -> DataFrame:
    """By page of ``pages``: issue counts by severity, score and grade."""
    n = lambda s: F.count_if(F.col("severity") == s)
    counts = found.groupBy("page_id").agg(*[n(s).alias(s.lower()) for s in SEVERITIES])
    full = pages.select("page_id").join(counts, "page_id", "left").na.fill(0)
    points = 100.0 - 10.0 * F.col("critical") - 5.0 * F.col("error") - 2.0 * F.col("warning") - 0.5 * F.col("info")
    full = full.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), points)))
    none = F.col("critical") == 0
    grade = F.when((F.col("score") >= 95) & none, "AAA").when((F.col("score") >= 85) & none, "AA").when(F.col("score") >= 70, "A").otherwise("Failing")
    return full.withColumn("grade", grade)


def feature_scores(pages: DataFrame, found: DataFrame, good: DataFrame) -> DataFrame:
    """(page_id, feature, feature_score) for each scored feature of each page."""
    every = pages.select("page_id", F.explode(F.array(*map(F.lit, SCORED_FEATURES))).alias("feature"))
    bad = found.groupBy("page_id", "feature").agg(
        F.sum(F.when(F.col("severity") == "Critical", 20.0).when(F.col("severity") == "Error", 10.0).when(F.col("severity") == "Warning", 5.0).otherwise(0.0)).alias("lost"))
    won = good.groupBy("page_id", "feature").agg((2.0 * F.count("*")).alias("won"))
    joined = every.join(bad, ["page_id", "feature"], "left").join(won, ["page_id", "feature"], "left")
    points = 100.0 - F.coalesce("lost", F.lit(0.0)) + F.coalesce("won", F.lit(0.0))
    return joined.select("page_id", "feature", F.greatest(F.lit(0.0), F.least(F.lit(100.0), points)).alias("feature_score"))


def summaries(scored: DataFrame, by_feature: DataFrame) -> DataFrame:
    """(page_id, summary): the report as text, features by score, then by name."""
    lines = by_feature.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("feature_score")).alias("k"), "feature"))).alias("fs"))
    text = F.concat(
        F.format_string("Accessibility Score: %.1f%% (Grade: %s)\n\nIssues by Severity:\n- Critical: %d\n- Error: %d\n- Warning: %d\n- Info: %d\n\nFeature Scores:\n",
                        "score", "grade", "critical", "error", "warning", "info"),
        F.array_join(F.transform("fs", lambda s: F.format_string("- %s: %.1f%%\n", s["feature"], -s["k"])), ""))
    return scored.join(lines, "page_id").select("page_id", text.alias("summary"))
