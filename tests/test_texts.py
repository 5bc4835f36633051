from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import chunking, markdown, prompts, represent

PAGE = ('<html lang=en><title>T</title><meta name=description content="d"><body><nav>x</nav><main><h1>Hi</h1><p>One <b>two</b> <a href="/a?b=1">link</a> H<sub>2</sub></p>'
        '<ul><li>a<ul><li>b</ul><li>c</ul><ol start=3><li>x<li>y</ol><table><thead><tr><th>A<th align=right>B</thead><tr><td>1<td>2</table>'
        '<pre><code class=language-py>x=1</code></pre><blockquote><p>q</p></blockquote><figure><img src=i.png alt=pic><figcaption>cap</figcaption></figure></main>')


def test_markdown():
    got = markdown.to_markdown(PAGE)
    assert got.startswith('---\ntitle: "T"\ndescription: "d"\n---\n\n# [TITLE] Hi\n\nOne **two** [link](/a) H~2~\n')
    for part in ("[LIST]\n\n- a\n  - b\n- c\n", "[ORDERED_LIST]\n\n3. x\n4. y\n", "| A   | B   |\n| --- | --: |\n| 1   | 2   |\n", "```py\nx=1\n```", "[QUOTE]\n\n> q", "[FIGURE]\n\n![pic](i.png) [IMAGE: pic]\n\n[CAPTION] cap"):
        assert part in got
    plain = markdown.to_markdown(PAGE, markdown.Options(semantic_labels=False, reference_links=True, metadata_level="none", heading_ids=True, post_process=str.upper))
    assert plain.startswith("# HI {#HI}") and "[LINK][L]" in plain and "[L]: /A" in plain and "[TITLE]" not in plain
    assert markdown.wrap("aa bb cc", 5) == "aa bb\ncc" and markdown.to_markdown("") == "\n"
    assert markdown.to_markdown("<p>x <abbr title=y>z</abbr> <kbd>k</kbd>", markdown.Options(metadata_level="none", custom_handlers={"kbd": "<{text}>"})) == "x z (y) <k>\n"


def test_representations(spark):
    assert represent.simplified("<body><p class=a style=b>x  y<script>z</script><a href=u onclick=v>l</a><img src=s>") == '<body><p>x y<a href="u">l</a><img src="s"></img></p></body>'
    lines = represent.tree_text("<ul>" + "<li>i</li>" * 12 + "</ul>").splitlines()
    assert lines[0] == "<body>" and lines[-1] == "    ... (2 more children)" and sum("<li>" in x for x in lines) == 10
    text = represent.token_efficient(PAGE)
    assert text.startswith("TITLE: T\nDESC: d\n\nMAIN:\n# Hi\n") and "HEADERS: A | B\nROW: 1 | 2\n" in text and "IMG: pic (i.png)" in text
    form = represent.token_efficient("<form><label for=e>Mail</label><input id=e name=m><select name=s><option>1<option>2</select><textarea name=t></textarea><button>Go</button></form>")
    assert "INPUT: type=text, name=m, label=Mail, placeholder=\n" in form and "  OPTIONS: 1, 2\n" in form and "BUTTON: type=button, text=Go\n" in form
    from weftline.operators import dom

    pages = spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string")
    n = dom.dom_nodes(pages)
    assert represent.outline(n).first().content.startswith("# T\n\n# Hi\n\nOne two link H2\n\n")
    assert represent.element_table(n).first().content.splitlines()[2].startswith("| nav | Navigation |  | x |")
    assert "- Contains 1 tables\n" in represent.page_summary(n).first().summary
    counts = {r.element_type: r.n for r in represent.element_counts(n).collect()}
    assert counts["li"] == 5 and counts["interactive"] == 1 and counts["div"] == 0
    represent.register_representation("size", lambda html: str(len(html)))
    assert {r.rep_type: r.content for r in represent.represent(pages, ("size", "simplified_html")).collect()}["size"] == str(len(PAGE))


def test_chunks(spark):
    o = chunking.Options(strategy="size", max_tokens=30, min_tokens=5, overlap=4)
    html = "".join(f"<p>{'word ' * 10}{k}</p>" for k in range(6))
    made = chunking.chunks_of(html, o)
    assert [c["chunk_index"] for c in made] == list(range(len(made))) and all(c["tokens"] <= 30 for c in made) and "".join(c["content"] for c in made) == html
    assert chunking.chunks_of("<p>x", chunking.Options())[0]["result_kind"] == "Single"
    assert chunking.chunks_of("x" * 500_000, chunking.Options())[0]["error"] == "ContentTooLarge"
    windows = chunking.by_characters("abc def. " * 60, chunking.Options(max_tokens=20, overlap=5))
    assert windows[0]["start"] == 0 and windows[-1]["content"].endswith("def. ") and all(b["start"] > a["start"] for a, b in zip(windows, windows[1:]))
    assert len(chunking.by_characters("é" * 200, chunking.Options(max_tokens=1, overlap=50))) >= 50  # always goes on
    assert chunking.balance("<div><p class=a>x</p><b>") == "<div><p class=a>x</p><b></b></div>"
    tree = chunking.by_hierarchy("<main id=main><section>" + "a" * 200 + "</section><section>" + "b" * 200 + "</section></main>", chunking.Options(max_tokens=60, min_tokens=20, overlap=0))
    kinds = [(c["content_type"], c["depth"], c["parent_index"]) for c in tree]
    assert kinds[0] == ("Document", 0, None) and all(p == 0 and d == 1 for _, d, p in kinds[1:]) and len(kinds) > 2
    sections = chunking.by_semantics("<header>h</header><div><article>a</article><p>loose</p></div>", chunking.Options(max_tokens=8, min_tokens=1, overlap=0))
    assert [c["content_type"] for c in sections][:2] == ["Header", "MainContent"]
    adaptive = chunking.by_importance("<nav>" + "n" * 80 + "</nav><article>" + "a" * 80 + "</article>", chunking.Options(max_tokens=40, min_tokens=1, overlap=100))
    assert "aaa" in adaptive[0]["content"]
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    rows = chunking.chunk(pages, o)
    n = rows.count()
    assert chunking.relations(rows).count() == 2 * (n - 1)
    around = chunking.with_context(rows).orderBy("chunk_index").collect()
    assert around[0].preceding_context is None and around[0].following_context.startswith("word word")


def test_importance(spark):
    row = spark.range(1).select(
        chunking.overall(F.lit(0.8), F.lit(0.6), F.lit(0.4), F.lit(False)).alias("a"), chunking.overall(F.lit(0.8), F.lit(0.6), F.lit(0.4), F.lit(True)).alias("b")).first()
    assert row.a == 0.64 and row.b == 0.82
    page = "<body><main id=main><section>" + "a" * 100 + "<a href=1>x</a></section></main><footer>f</footer></body>"
    got = {r.tag: r for r in chunking.importance(chunking.sections(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))).collect()}
    assert got["main"].is_priority and got["section"].parent_position == got["main"].position and got["footer"].overall_score < got["main"].overall_score
    assert got["section"].interactivity_score == 0.5


def test_texts(spark):
    one = lambda *cols: spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()
    samples = {
        "This is a simple test sentence.": (8, 8, 14, 12), "Text with special characters: !@#$%^&*()_+{}|:<>?~`;',.": (14, 14, 68, 37),
        "This is a test sentence with exactly ten words.": (12, 12, 20, 18)}
    for text, want in samples.items():
        assert tuple(one(*[fn(F.lit(text)) for fn in X.TOKEN_COUNTERS.values()])) == want
    got = one(X.slug(F.lit("Héllo, World! 2")), X.host(F.lit("https://a.b:8/c?d")), X.without_query(F.lit("/a?b?c")), X.price(F.lit("$1,234.50")), X.half_steps(F.lit(3.3)),
              X.first_number(F.lit("about 12.5 cm")), X.clip_bytes(F.lit("aéé"), 4), X.ellipsis(F.lit("ab" * 30), 50, 47), X.clean_whitespace(F.lit(" a  b\n")))
    assert tuple(got) == ("héllo-world-2", "a.b:8", "/a", 1234.5, 3.5, 12.5, "aé", "ab" * 23 + "a...", "a b")


def test_prompts(spark):
    one = lambda *cols: spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()
    html = "<div><p>Test paragraph</p><span>Text</span></div>"
    got = one(prompts.truncate_html(F.lit(html), 100), prompts.truncate_html(F.lit(html), 5), prompts.truncate_html(F.lit("plain text without tags at all"), 2))
    assert got[0] == html and got[1] == f"<div><p></p></div>\n{prompts.TRUNCATED}" and got[2] == "plain te<!-- HTML content truncated -->"
    examples = F.array(F.struct(F.lit("i").alias("input"), F.lit("o").alias("output"), F.lit(None).cast("string").alias("explanation")))
    text = one(prompts.extraction(F.lit("<p>Product: Widget</p>"), "Find products", "table", system="S.", examples=examples))[0]
    for part in ("I need you to help with the following:\n\nS. Focus on extracting tabular data", "HTML Content:\n```html\n<p>Product: Widget</p>\n```", "Instructions:\nFind products", "Extract the requested information",
                 "Input:\ni\n\nOutput:\no", "Specific Instructions:\nExtract the data as a table", "6. Identify and use proper column headers"):
        assert part in text
    elements = F.array(F.struct(F.lit(0).alias("index"), F.lit("button").alias("tag"), F.lit("Go").alias("text"), F.lit(None).cast("string").alias("placeholder"), F.lit("b").alias("id"),
                                F.array(F.lit("x"), F.lit("y")).alias("classes"), F.lit(True).alias("visible"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y")))
    actions = F.array(F.struct(F.lit("click").alias("action_type"), F.lit("Element 0").alias("target"), F.lit("v").alias("value"), F.lit("ok").alias("result")))
    text = one(prompts.navigation(F.lit("<p>"), "Buy", elements, actions, "checkout", url=F.lit("http://u"), progress=F.lit(0.5), variation="gpt", system="N."))[0]
    for part in ("System: N. Focus on completing a checkout", "Element 0: button - Text: 'Go'", "Classes: [x, y] - visible", "Action 1: click on target 'Element 0' with value 'v' - Result: ok", "Current URL: http://u",
                 "Current progress: 50%", "Objective:\nBuy", "ACTION: [action type"):
        assert part in text
    text = one(prompts.analysis(F.lit("<p>"), "Look", "general_structure"))[0]
    assert "Analysis Objective:\nLook" in text and '"pageStructure"' in text
    sizes = one(prompts.extraction_tokens(F.lit("x" * 40), "abcd", "efgh"), prompts.navigation_tokens(F.lit("x" * 40), "abcd", n_elements=2), prompts.analysis_tokens(F.lit("x" * 40), "abcd"))
    assert tuple(sizes) == (212, 411, 311)
    assert tuple(one(prompts.provider_of(F.lit("gpt")), prompts.provider_of(F.lit("claude")))) == ("openai", "anthropic")


def test_steps(spark):
    from weftline.plans.steps import Registry, Steps

    rows = spark.range(3)
    double = lambda d, c: d.withColumn("x", F.col("id") * c["k"])
    broken = lambda d, c: d.select("nothing")
    steps = Steps("continue").add("double", double).add("broken", broken)
    assert [r.x for r in steps.run(rows, {"k": 2}).orderBy("id").collect()] == [0, 2, 4] and list(steps.failed) == ["broken"]
    assert steps.remove("broken").run(rows, {"k": 1}).columns == ["id", "x"]
    try:
        Steps("retry").add("broken", broken).run(rows)
        raise AssertionError("no error")
    except Exception as error:
        assert "nothing" in str(error)
    found = Registry().register("a", 1).register("b", 2)
    assert (found.get(), found.get("b"), found.get("c"), found.names()) == (1, 2, None, ["a", "b"])
