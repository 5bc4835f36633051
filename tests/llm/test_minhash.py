import random

import pytest

from weftline.llm import minhash
from weftline.llm.minhash import drop_duplicates, near_duplicates

SCHEMA = "doc_id long, text string, source string"


def sets_of(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute(rows, width, percent=80):
    sets = [(i, sets_of(t, width)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(3, 80))]
        for _ in range(rng.randint(1, 12)):
            copy = [w if rng.random() > 0.04 else rng.choice(words) for w in text]
            rows.append((len(rows) * 3 + 1, " ".join(copy), f"s{base}"))
    rng.shuffle(rows)
    return rows


def result(spark, rows, **options):
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found}


def test_equals_brute_force(spark):
    for seed, width in ((1, 2), (2, 5)):
        rows = corpus(seed)
        assert result(spark, rows, width=width) == brute(rows, width)


@pytest.mark.parametrize("seed", [4, 5])
def test_groups_of_many_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(120):
        text = list(base)
        for at in rng.sample(range(60), (1, 3, 5)[k % 3]):
            text[at] = f"x{k}_{at}"
        rows.append((k, " ".join(text), "s"))
    assert result(spark, rows, width=2) == brute(rows, 2)


def test_strays_of_a_large_group_meet_all_of_it_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 50)
    seen = spark.sparkContext.accumulator(0)
    base = [f"b{k}" for k in range(40)]
    texts = {k: " ".join([*base, f"x{k}"]) for k in range(2000)} | {5000: " ".join([*base[:39], "y", "z"]), 5001: "q r s"}
    members = spark.createDataFrame([(1, i, 1 if i < 5000 else i, 41) for i in texts], "g long, id long, comp long, size long")

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    shipped = spark.createDataFrame([(i, t.encode()) for i, t in texts.items()], "id long, text binary")
    real = minhash.DataFrame.mapInArrow
    monkeypatch.setattr(minhash.DataFrame, "mapInArrow", lambda df, run, schema: real(df, lambda it: run(count(it)), schema))
    found = minhash._search_groups(members, shipped, 2, 80).collect()
    assert {x for r in found for x in (r.src, r.dst)} >= {5000, *range(2000)}
    assert not any(5001 in r for r in found)
    assert seen.value <= 2 * len(texts)


def test_template_with_a_hub(spark):
    # All share a passage, few pairs reach the threshold: stars alone miss some.
    rng = random.Random(3)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(150):
        text = list(base)
        for at in rng.sample(range(60), 3):
            text[at] = f"x{k}_{at}"
        rows.append((k, " ".join(text), "s"))
    assert result(spark, rows, width=2) == brute(rows, 2)


def test_edges(spark):
    rows = [(1, None, None), (2, "", "s"), (3, " \t\n", "s"), (4, "one", "s"), (5, "ONE", "s"), (6, "É x", "s"), (7, "é x", "s"), (8, "a b", "s"), (8, "a b", "s")]
    got = result(spark, rows, width=2)
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False)
    assert got[6] == (1, 6, True) and got[7] == (1, 7, True)  # only A-Z change
    assert got[8] == (1, 8, True)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert result(spark, [(1, "word " * 50_000, "s"), (2, "word " * 40_000, "s")], width=2) == {1: (1, 1, True), 2: (1, 1, False)}


def test_drop_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "q r s", None), (3, "q r s", None), (None, None, None)], SCHEMA)
    left = drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3]


def test_stars_need_no_round_and_components_are_exact(spark):
    from weftline.llm._shared import connected_components

    schema = "src long, dst long"
    stars = [(5, 1), (1, 9), (3, 2), (4, 2), (7, 7)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(stars, schema), max_rounds=1).collect()}
    assert got == {(5, 1), (9, 1), (1, 1), (3, 2), (4, 2), (2, 2)}
    assert not connected_components(spark.createDataFrame([], schema), max_rounds=1).collect()

    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + stars
    parent = {x: x for pair in edges for x in pair}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    named = {x for a, b in edges if a != b for x in (a, b)}
    rows = connected_components(spark.createDataFrame(edges, schema)).collect()
    assert len(rows) == len(named) and {r.node: r.component for r in rows} == {x: parent[x] for x in named}
