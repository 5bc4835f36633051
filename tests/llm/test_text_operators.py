import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from weftline.llm import bpe, html, quality, toxicity
from weftline.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(*vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "\t", "é", " ", "　", "'s", "'", "12", "!?", "日本", "😀", "\x85", "\x1c", "xyz"]), max_size=60), st.sampled_from([1, 2, 5, 16, 64]))
def test_tree_equals_the_whole(codec, parts, leaf):
    codec.leaf = leaf
    text = "".join(parts)
    ids = codec.encode(text)
    assert ids == codec.base.encode_ordinary(text) and codec.decode(ids) == text.encode()
    codec.leaf = bpe.LEAF


def test_bpe_rows(spark):
    texts = [None, "", "Hello  world's\n\n test", "x" * 50_000, "été " * 20_000, "Hello  world's\n\n test"]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS)
    ranks, pattern = vocabulary()
    codec = bpe.Codec(ranks, pattern)
    rows = {r.doc_id: r for r in bpe.encode(docs, ranks, pattern, ("n_tokens", "ids", "ids_sha256", "decoded_sha256")).collect()}
    for k, t in enumerate(texts):
        want = codec.base.encode_ordinary(t or "")
        assert rows[k].n_tokens == len(want) and list(rows[k].ids) == want
        assert rows[k].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in want)).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern).collect()
    assert {r.doc_id: bytes(r.text).decode() for r in back} == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.encode(spark.createDataFrame([], DOCS), ranks, pattern).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>no</article>";</script></head><body class="has-sidebar">
<header>Site head</header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="ad">Buy this now, it is a long advert text for you.</div>
<article class="post"><header><h1>Title &amp; more</h1></header><p><b>First   paragraph&nbsp;here.<br>Second line.<p>Short.</p><form>mail <input></form>
<div class="share">Share me</div><p>Last &lt;words&gt;.</p></article><aside>Side text</aside><section id="comments"><p>I disagree with all of this.</p></section>
<div class="cookie-notice">We use cookies</div><footer>&copy; foot</footer>"""


def test_main_text():
    assert html.main_text(PAGE) == "Title & more\nFirst paragraph here. Second line.\nShort.\nLast <words>."
    assert html.main_text(None) == "" and html.main_text("") == "" and html.main_text("<nav>x</nav>") == ""
    assert html.main_text("only text, no tags") == "only text, no tags"
    assert html.main_text("<p>one<p>two") == "one\ntwo"
    plain = "<div><a href=1>Home</a> <a href=2>News</a></div><div>" + "A long main paragraph of plain text. " * 5 + "</div><p>Another one that follows it.</p><div class=sidebar>aside</div>"
    assert html.main_text(plain) == ("A long main paragraph of plain text. " * 5).strip() + "\nAnother one that follows it."
    assert html.main_text("<article><p>a<!-- never ends") == "a"
    boxed = "<div id=top>Site name</div><div class='content wide'><h2>T</h2><p>Short.</p><div class=comments>c</div></div><div class=bottom>Imprint</div>"
    assert html.main_text(boxed) == "T\nShort."
    assert html.main_text("<article><p>x</p><p>y</p></article><div class=related>z</div><article class=comment>no</article>") == "x\ny"


def test_articles_below_what_looks_aside():
    body = "<article><h1>T</h1><p>First words of it.</p></article>"
    want = "T\nFirst words of it."
    assert html.main_text(f"<html><head><title>x</title><meta name=a><body>{body}</body></html>") == want
    assert html.main_text(f"<html><head><title>x</title>{body}") == want
    assert html.main_text("<head><title>x</title>bare text") == "bare text"
    assert html.main_text(f"<body><form id=aspnetForm action=x><div>{body}</div><input></form></body>") == want
    for wrap in ("class='layout sidebar-right'", "id='modal-wrap'"):
        assert html.main_text(f"<body><div>Site</div><div {wrap}>{body}<aside>Side</aside></div></body>") == want
    assert html.main_text("<form><div id=content><p>Some text.</p></div></form>") == "Some text."
    # What is aside in earnest stays so.
    assert html.main_text(f"{body}<div class=sidebar><article>Newest</article></div><div class=related><article>{want * 9}</article></div>") == want
    assert html.main_text(f"<div hidden>{body}</div><aside>{body}</aside><div class=layout-sidebar><article class=teaser>t</article></div>") == ""
    assert html.main_text(f"<form class=comment-form>{body}</form><form><article>A<div class=ad>buy</div></article></form>") == "A"


def test_asides_part_lines_but_lose_no_main_text():
    long, ad = "Plain words of the story. " * 24, "<div class=ad>Buy this</div>"
    want = long.strip()
    assert html.main_text(f"<h1>Short title</h1>{ad}<p>{long}</p>") == f"Short title\n{want}"
    assert html.main_text(f"<div><p>{long}</p>{ad}<p>A closing paragraph of about forty signs.</p></div>") == f"{want}\nA closing paragraph of about forty signs."
    assert html.main_text(f"<p>{long}</p>{ad}<p>Short.</p>{ad}<h2>Next</h2>{ad}<p>{long}</p>") == f"{want}\nShort.\nNext\n{want}"
    assert html.main_text(f"<div><h1>Title</h1></div>{ad}<div><p>{long}</p></div>{ad}<div>Imprint</div>") == f"Title\n{want}"
    assert html.main_text(f"<p>{long}</p><footer>Foot</footer><p>Below</p>") == want


def test_windows_decide_in_a_marked_part(monkeypatch):
    long, ad = "Plain words of the story. " * 24, "<div class=ad>Buy this</div>"
    page = f"<article><h1>Title</h1>{ad}<section><p>{long}</p><p>End.</p></section>{ad}<div><span>Ok.</span></div></article>"
    want = f"Title\n{long.strip()}\nEnd."
    assert html.main_text(page) == want
    monkeypatch.setattr(html, "MARKED_PART", 0)
    assert html.main_text(page) == want + "\nOk."
    monkeypatch.setattr(html, "MARKED_PART", 9)
    monkeypatch.setattr(html, "SURGE_CHARS", 10**9)
    assert html.main_text(page) == ""


def test_nested_and_stray_tags_take_linear_time():
    n = 100_000
    for page in ("<b>" * n + "<p>x" + "</i>" * n, "<div>" * n + "x", "<div>x" * n, "<b>x</i>" * n, "<p><b>" * n + "x", "<article>" + "<li>x</b>" * n, "<form>" * n + "<article>x"):
        start = time.process_time()
        assert "x" in html.main_text(page)
        assert time.process_time() - start < 12
    assert html.main_text("</div></p>" * n + "<p>one<p>two") == "one\ntwo"


def test_pages(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, None), (2, None, None, None), (3, "v", "<p>" + "word " * 100_000, None)]
    got = html.extract(spark.createDataFrame(rows, schema)).collect()
    assert [(r.page_id, r.n_chars) for r in got][:3] == [(1, len(html.main_text(PAGE)))] * 2 + [(2, 0)] and got[3].n_chars == 499_999
    assert html.extract(spark.createDataFrame([], schema)).count() == 0


def labelled(n, seed):
    rng = random.Random(seed)
    plain = ["the", "and", "river", "stone", "light", "garden", "window", "paper", "morning", "letter", "music", "winter"] + [f"{a}{b}" for a in ("ba", "lo", "mi", "tu") for b in ("ren", "sta", "ver", "kin")]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(15, 60))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "wretched", "vermin", "grumblefrotz", "grumblewick", "grumbletang"]))
        docs.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, 1, int(bad)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(1500, 1)
    extra = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "x" * 30_000, "en", "s", 1)]
    d, y = spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels + [(9001, None, None)], LABELS)
    model = toxicity.fit(d, y)
    scores = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    truth = {k: t for k, _, t in labels}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum((scores[k] >= 0.5) == bool(truth[k]) for k in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in scores.values()) and scores[9000] == scores[9001] < 0.5
    left = toxicity.drop_toxic(d, model)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {k for k, s in scores.items() if s < 0.5}


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs, labels = labelled(400, 2)
    d = spark.createDataFrame(docs, DOCS)
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    a, b = (toxicity.fit(d, spark.createDataFrame(y, LABELS)) for y in (labels, flipped))
    assert (a.weights, a.bias, a.common, a.ordinary, a.toxic) == (b.weights, b.bias, b.common, b.ordinary, b.toxic)


def coded(run):
    """Each byte of a run and the print of the run's beginning up to it, one by one."""
    out, h = b"", 0
    for byte in run:
        h = (h * 0x9E3779B1 + byte + 1) & 0xFFFFFFFF
        h ^= h >> 15
        out += (byte | (h * 0x85EBCA6B & 0xFFFFFF00)).to_bytes(4, "little")
    return out


def saved(model, window):
    plain, toxic = model.sides()
    return len(plain.compress(window)) - len(toxic.compress(window))


def test_toxicity_against_brute_force():
    docs, labels = labelled(700, 4)
    rows = [(text.encode(), y) for (_, text, *_), (_, _, y) in zip(docs, labels)]
    model = toxicity.train(rows[:500], rows[500:])
    assert model.toxic and len(model.toxic) >= len(model.ordinary) > 0
    mixed = rows[0][0] + b" (Vermin, scoundrel-like grumblewick!\n\xc3\xa9t\xc3\xa9 " + b"x" * 70 + b" vermin"
    for text in (*(t for t, _ in rows[:20]), mixed, b"one", b"", b"  \t"):
        words = [w[k : k + 32] for w in text.lower().split() for k in range(0, len(w), 32)]
        content, begin, end = toxicity.wide(text)
        assert len(begin) == len(words)
        for w, i, j in zip(words, begin, end):
            runs = re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]", w)
            assert content[i:j] == b"".join(coded(r) if r[0] >= 128 or r.isalnum() else bytes([r[0], 0, 0, 0]) for r in runs)
        starts = range(0, max(len(words) - 1, min(1, len(words))), 2)
        want = [saved(model, content[begin[k] : end[min(k + 2, len(words) - 1)]]) for k in starts]
        assert model.gains(text).tolist() == want
        long = sorted(set(re.findall(rb"[0-9a-z\x80-\xff]{12,}", text.lower())))
        inner = []
        for r in long:
            at = [n for n in range(1, len(r) - 3) if r[n] & 0xC0 != 0x80]
            inner.append(max([0, *(saved(model, coded(r[n : n + 12])) for n in at)]))
        assert sorted(model.inner_gains(text).tolist()) == sorted(inner)
        x = [math.log1p(sum(g >= n for g in want)) for n in toxicity.GAINS] + [math.log1p(sum(g >= n for g in inner)) for n in toxicity.INNER_GAINS]
        z = model.bias + sum(w * v for w, v in zip(model.weights, [*x, math.log1p(len(want)) / 10], strict=True))
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))


def test_toxicity_of_many_texts_at_once(monkeypatch):
    """Texts are compressed together, and none changes the score of another."""
    docs, labels = labelled(700, 4)
    rows = [(text.encode(), y) for (_, text, *_), (_, _, y) in zip(docs, labels)]
    model = toxicity.train(rows[:500], rows[500:])
    odd = [b"", b"  \t", b"one", b"one two", b"vermin \xe2", b"\x80\x80 scoundrel", b"\xc2", b"-- vermin --", b"x" * 70, b"grumblewick " * 20_000, b"\n"]
    texts = [*(t for t, _ in rows[:200]), *odd, rows[0][0], *odd[::-1]]
    alone = [model.score(t) for t in texts]
    assert [model.gains(t).tolist() for t in texts] == [model._gains(*toxicity.windows([b"scoundrel", t, b"x"])[:2]).tolist()[1:-1] for t in texts]
    monkeypatch.setattr(toxicity, "AT_ONCE", 1 << 30)
    assert model.scores(texts) == alone and len(set(alone)) > 100
    monkeypatch.setattr(toxicity, "AT_ONCE", 4096)
    assert model.scores(iter(texts)) == alone and model.scores([]) == [] and toxicity.Model().scores([b"a", b""]) == [toxicity.Model().score(b"a")] * 2
    calls, gains = [], model._gains
    monkeypatch.setattr(toxicity, "AT_ONCE", 128 * 1024)
    monkeypatch.setattr(model, "_gains", lambda *a: calls.append(1) or gains(*a))
    few = texts[:200]
    model.scores(few)
    assert len(calls) <= 2 * (1 + sum(map(len, few)) // (64 * 1024))


def test_toxic_terms_are_seen_wherever_they_stand():
    docs, labels = labelled(1500, 3)
    rows = [(text.encode(), y) for (_, text, *_), (_, _, y) in zip(docs, labels)]
    model = toxicity.train(rows[:1000], rows[1000:])
    alone = model.gains(b"scoundrel").max()
    assert alone > 8
    for text in ['"scoundrel"', "(scoundrel", "*scoundrel*", "you-scoundrel", "l'scoundrel", "l\u2019scoundrel", "\u201escoundrel\u201c", "_scoundrel"]:
        assert model.gains(text.encode()).max() >= alone / 2, text
    assert model.inner_gains(b"volscoundrel").max() >= alone / 2
    assert model.inner_gains(("\u6f22\u5b57" * 51 + "scoundrel" + "\u6f22\u5b57" * 30).encode()).max() >= alone / 3
    plain = "the garden window paper and a letter of music in winter light baren losta miver tukin"
    clean, bad = model.score(plain.encode()), model.score((plain + ' (scoundrel, "wretched" and you-vermin').encode())
    assert clean < 0.5 < bad


def test_toxic_text_without_spaces_is_learnt():
    rng = random.Random(7)
    signs = [chr(0x4E00 + k) for k in range(300)]
    rows = []
    for k in range(600):
        text = [rng.choice(signs) for _ in range(rng.randint(40, 120))]
        if k % 3 == 0:
            text.insert(rng.randrange(len(text)), "\u9f98\u9f99\u9f9a")
        rows.append(("".join(text).encode(), int(k % 3 == 0)))
    model = toxicity.train(rows[:300], rows[300:450])
    assert sum((model.score(t) >= 0.5) == bool(y) for t, y in rows[450:]) >= 145


def test_toxic_phrases_of_ordinary_words():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "tu") for b in ("ren", "sta", "ver", "kin")] + ["go", "away"]
    rows = []
    for k in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(20, 40))]
        text = [w for w, x in zip(text, text[1:]) if (w, x) != ("go", "away")] + ["miver"]
        if k % 3 == 0:
            at = rng.randrange(len(text))
            text[at:at] = ["go", "away"]
        rows.append((" ".join(text).encode(), int(k % 3 == 0)))
    model = toxicity.train(rows[:300], rows[300:450])
    assert sum((model.score(t) >= 0.5) == bool(y) for t, y in rows[450:]) >= 145


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a b", "en", "s", 1)], DOCS)
    assert toxicity.score(d, toxicity.fit(d, spark.createDataFrame([], LABELS))).first().score < 0.5
    assert toxicity.score(spark.createDataFrame([], DOCS), toxicity.Model()).count() == 0


def junk_and_prose(n=600):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "bdfglmnprst" for b in ("an", "er", "ion", "o", "ist")]
    docs, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(40)]
        bad = k % 6 == 0
        text = " ".join(w + rng.choice(["***", "$$$"]) if bad else w for w in text) + "."
        docs.append((k, text, "en", "s", 1))
        if k % 2 == 0 or bad:
            labels.append((k, int(not bad), 0))
    return docs, labels


def test_quality_draws_the_good(spark):
    docs, labels = junk_and_prose()
    docs += [(9000, None, None, None, None), (9001, "", "en", "s", 0)]
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    share = quality.target_share(y)
    assert share == pytest.approx(2 / 3 + (2 / 9 / 300) ** 0.5)
    good = {k for k in range(600) if k % 6}
    kept = {r.doc_id for r in quality.select(d, y, share=501 / 602).collect()}
    assert len(kept) == 501 and len(good - kept) <= 3 and len(kept & set(range(0, 600, 6))) <= 3
    assert {r.doc_id for r in quality.drop_rejected(d, y, share=501 / 602).collect()} == kept
    assert quality.drop_rejected(d, y).count() == quality.select(d, y).count() == math.ceil(share * 602)
    assert quality.drop_rejected(d, spark.createDataFrame([], LABELS)).count() == len(docs)
    assert quality.drop_rejected(spark.createDataFrame([], DOCS), y).count() == 0


def grams_by_hand(text):
    """The n-grams of a text as pairs of a kind and what identifies them."""
    tokens = re.findall(r"[0-9A-Za-z]+|[^\s0-9A-Za-z]+", text)
    words = [t.lower() for t in tokens]
    shapes = []
    for k, t in enumerate(tokens):
        kind = "digits" if t.isdigit() else "upper" if t.isupper() else "lower" if t.islower() else "title" if t.istitle() else "mixed"
        shapes.append((f"{kind}{min(len(t), 24) // 8}" if t.isalnum() else t, words[k] in words[max(0, k - 2) : k]))
    first = [("w", w) for w in words] + [("w", *p) for p in zip(words, words[1:])]
    return first, [("s", x) for x in shapes] + [("s", *p) for p in zip(shapes, shapes[1:])] + [("s", *p) for p in zip(shapes, shapes[1:], shapes[2:])]


def test_quality_weights_against_brute_force(spark, monkeypatch):
    """Both models and all weights, with n-grams counted by hand; buckets are so
    many that none holds two n-grams."""
    monkeypatch.setattr(quality, "WORD_BITS", 44)
    docs, labels = junk_and_prose(60)
    docs[7] = (7, "One 12 ONE one-two!! (iPad) one one", "en", "s", 1)
    tokens, bucket = quality._Tokens(), {}
    for _, text, *_ in docs:
        own = quality.grams(text.encode(), tokens)
        for gram, at in zip([g for part in grams_by_hand(text) for g in part], own.tolist(), strict=True):
            assert bucket.setdefault(gram, at) == at
    monkeypatch.undo()
    assert len({b for g, b in bucket.items() if g[0] == "w"}) == sum(g[0] == "w" for g in bucket)
    rows = {r.doc_id: r for r in quality.weigh(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    good, at = {k for k, q, _ in labels if q}, quality._Tokens()
    raw, target = Counter(), Counter()
    for k, text, *_ in docs:
        raw.update(quality.grams(text.encode(), at).tolist())
        if k in good:
            target.update(quality.grams(text.encode(), at).tolist())
    for k, text, *_ in docs:
        want = 0.0
        own = quality.grams(text.encode(), at).tolist()
        for b in own:
            low, high = (0, quality.WORD_BUCKETS) if b < quality.WORD_BUCKETS else (quality.WORD_BUCKETS, quality.BUCKETS)
            n = high - low
            r = (raw[b] + 0.5) / (sum(c for x, c in raw.items() if low <= x < high) + 0.5 * n)
            t = (target[b] + n * r) / (sum(c for x, c in target.items() if low <= x < high) + n)
            want += math.log(t / r)
        assert rows[k].log_weight == pytest.approx(want / len(own) / quality.TEMPERATURE, abs=1e-9)


def test_quality_seeds_change_the_draw_by_weight(spark):
    docs, labels = junk_and_prose(1200)
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    draws = [{r.doc_id: r.log_weight for r in quality.select(d, y, share=0.25, seed=k).collect()} for k in (1, 2, 3)]
    assert all(len(x) == 300 for x in draws)
    # A quarter of good rows with nearly equal weights: sets overlap as chance has it.
    assert all(len(a.keys() & b.keys()) < 160 for a, b in zip(draws, draws[1:]))
    assert sum(k % 6 == 0 for x in draws for k in x) <= 3
    usual = [{r.doc_id for r in quality.select(d, y, seed=k).collect()} for k in (1, 2)]
    assert usual[0] != usual[1]


def test_gumbel_top_k_takes_exactly_k(spark):
    rows = spark.createDataFrame([(k, float(k % 7), float(k % 7)) for k in range(200)], "doc_id long, log_weight double, key double")
    for k in (0, 1, 28, 57, 200):
        got = quality.resample(rows, k).collect()
        assert len(got) == k
        if 0 < k < 200:
            assert min(r.key for r in got) >= sorted((r.key for r in rows.collect()), reverse=True)[k - 1]


def test_gumbel_draws_in_proportion(spark):
    rows = spark.range(20_000).select((quality.F.col("id")).alias("doc_id")).withColumn("log_weight", quality.F.when(quality.F.col("doc_id") % 2 == 0, 1.0).otherwise(0.0))
    rows = rows.withColumn("key", quality.F.col("log_weight") + quality.gumbel(quality.F.col("doc_id")))
    even = quality.resample(rows, 1000).where("doc_id % 2 = 0").count()
    assert 680 < even < 780  # e / (1 + e) of the first draws
