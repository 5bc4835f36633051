import math
import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from weftline.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=11):
    """Documents with what is wrong with each: junk, toxic, copy or nothing."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bdfglmnprst" for b in ("an", "er", "ion", "o", "ist", "ael", "ume")]
    docs, kinds, labels = [], {}, []
    for k in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(30, 60))]
        kind = "junk" if k % 7 == 0 else "toxic" if k % 5 == 0 else "good"
        if kind == "junk":
            text = [w + rng.choice(["***", "$$$", "&&&"]) for w in text]
        if kind == "toxic":
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["scoundrel", "wretched", "vermin", "numbskull"]))
        if kind == "good" and k % 4 == 1 and docs:
            old = next((d for d in reversed(docs) if kinds[d[0]] == "good"), None)
            if old:
                text, kind = old[1].split(), "copy"
                text[-1] = "changed"
        docs.append((k, " ".join(text), "en", f"s{k % 4}" if k % 11 else None, 1))
        kinds[k] = kind
        if k % 2 == 0:
            labels.append((k, int(kind != "junk"), int(kind == "toxic")))
    return docs, kinds, labels


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def first_of_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i for i in root if find(i) == i}


def passes(rows):
    """How often the mix takes each document, the last time of a source whole."""
    import hashlib

    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + weight[s] * level > 2 * sizes[s]}
        for s in full or set(open_):
            add = 2 * sizes[s] - target[s] if full else weight[s] * level
            target[s] += add
            left -= add
        if not full:
            break
        open_ -= full
    out, at = Counter(), Counter()
    for i, t, s in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
        n = len(t.split())
        for k in range(2):
            out[i] += min(n, round(target[s]) - k * sizes[s] - at[s]) > 0
        at[s] += n
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, kinds, labels = corpus()
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return folder, docs, kinds


def test_stages_against_brute_force(spark, tables):
    folder, docs, kinds = tables
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    by = {d[0]: d for d in docs}
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "mixing", "tokens"]
    kept = {}
    for name, stage in pipeline.STAGES[:4]:
        rows = stage(spark, rows, folder)
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = f"{folder}/{name}"
        rows.write.parquet(path)
        rows = spark.read.parquet(path)
        kept[name] = Counter(r.doc_id for r in rows.collect())
    # The share of good labels and a standard error of all rows are drawn.
    known = [kinds[k] != "junk" for k in by if k % 2 == 0]
    share = sum(known) / len(known)
    drawn = math.ceil((share + (share * (1 - share) / len(known)) ** 0.5) * len(docs))
    clean = {k for k, x in kinds.items() if x != "junk"}
    assert len(kept["quality"]) == drawn and len(clean - set(kept["quality"])) <= 5
    assert set(kept["toxicity"]) == {k for k in kept["quality"] if kinds[k] != "toxic"}
    assert set(kept["near_duplicates"]) == first_of_groups([(k, by[k][1]) for k in kept["toxicity"]])
    assert kept["mixing"] == +passes([(k, by[k][1], by[k][3]) for k in kept["near_duplicates"]])
    ranks, pattern = vocabulary()
    from weftline.llm.bpe import Codec

    plain = Codec(ranks, pattern).base
    for r in pipeline.STAGES[4][1](spark, rows, folder).collect():
        assert list(r.ids) == plain.encode_ordinary(by[r.doc_id][1]) and r.n_tokens == len(r.ids)


def test_run_equals_the_stages(spark, tables):
    folder, *_ = tables
    got = Counter(r.doc_id for r in pipeline.run(spark, folder).collect())
    assert got == Counter(r.doc_id for r in spark.read.parquet(f"{folder}/mixing").collect())


def test_stages_on_odd_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], LABELS).write.parquet(f"{folder}/labels.parquet")
    schema = DOCS + ", `_copy` long, `_rejected` long, mix_id long, mix_position string, `key` string"
    odd = spark.createDataFrame([(1, None, None, None, None, 1, 1, 1, "x", "k"), (None, "", "en", None, 1, 2, 2, 2, None, None), (2, "a b c d e f", "en", "s", 1, 3, 3, 3, "y", "k"),
                                 (2, "a b c d e f", "en", "s", 1, 3, 3, 3, "y", "k")], schema)
    for rows in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, rows, folder)
            out.collect()
            if name != "tokens":
                assert out.columns == odd.columns, name
