import numpy as np
from pyspark.sql import functions as F

from weftline.llm.embdedup import duplicates
from weftline.llm.topk import cell_top, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def rows_of(vectors, labels):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], label, "x") for i, (v, label) in enumerate(zip(vectors, labels, strict=True))]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(230, 16)).astype(np.float32) / 4
    v[100:120] = v[0]  # ties
    rows = rows_of(v, [0] * len(v)) + [(500, None, 0, "x"), (550, [float("nan")] * 16, 0, "x"), (600, [None] * 16, 0, "x")]
    got = top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    q = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 230, 50):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(230) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(order)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_cells_prune_without_loss():
    rng = np.random.default_rng(2)
    c = np.floor(rng.normal(size=(900, 32)) * 100)
    c[::7] *= 3
    q = c[:40]
    for i, j, s in cell_top(np.arange(40), q, np.arange(900), c, 5):
        for row in range(40):
            exact = q[row] @ c.T
            order = sorted((-int(exact[k]), k) for k in range(900) if k != row)[:5]
            assert [(-int(a), int(b)) for a, b in zip(s[i == row], j[i == row])] == order


def test_large_components_touch_no_other_rows(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(160, 8))
    for row, (at, x) in enumerate([(1, 1e14), (2, 1e30), (3, -1e300), (0, 1e30), (1, -1e14), (2, 3e7), (4, 1e5), (1, 1.7e308)]):
        v[[3, 50, 51, 52, 60, 61, 70, 100][row], at] = x
    v[0, 3] = 0  # a query whose other scores must stay as they are
    v[62], v[63] = v[61], v[50]
    schema = "vec_id long, embedding array<double>"
    got = top_k(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], schema), F.col("vec_id") % 50 == 0).collect()
    whole = lambda x: int(np.floor(256 * x)) if abs(x) < 1e300 else int(x) * 256
    held = [[max(-(2**500), min(2**500, whole(x))) for x in row] for row in v.tolist()]
    limit = 2**63 - 1
    want = []
    for i in range(0, 160, 50):
        scores = [(-max(-limit, min(limit, sum(a * b for a, b in zip(held[i], held[j], strict=True)))), j) for j in range(160) if j != i]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(sorted(scores)[:5])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert any(s == limit for *_, s in want) and any(0 < s < limit for *_, s in want)


def test_top_k_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert top_k(empty, F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0], 0, "a"), (50, [1.0], 0, "b"), (7, [0.5, 0.0], None, None)], SCHEMA)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(few, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(0, 1): (50, 65536), (0, 2): (7, 32768), (50, 1): (0, 65536), (50, 2): (7, 32768)}


def brute_links(rows, least=0.98):
    ok = []
    for i, v, label, _ in rows:
        good = v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append((i, np.array(v, dtype=np.float64) if good else None, label))
    links, root = {i: 0 for i, *_ in ok}, {i: i for i, *_ in ok}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x, p) in enumerate(ok):
        for j, y, q in ok[a + 1 :]:
            if x is not None and y is not None and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (links[i], find(i), find(i) == i) for i in links}


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = np.repeat(base, 25, axis=0) + rng.normal(size=(300, 64)) * 0.012
    near[10:14] = near[10]
    labels = [k % 2 for k in range(300)]
    rows = rows_of(near, labels) + [(900, None, 0, "x"), (901, [0.0] * 64, 0, "x"), (902, [float("inf")] + [1.0] * 63, 0, "x"), (903, [1.0] * 64, None, "x"), (904, [1.0, None], 1, "x")]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y, e) for i, v, y, e in rows]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute_links(rows)
    found, true = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert found >= 0.98 * true and all(got[i][0] <= want[i][0] for i in want)
    assert {i: x[1:] for i, x in got.items()} == {i: x[1:] for i, x in want.items()}


def test_hot_bucket_in_blocks(spark, monkeypatch):
    import weftline.llm.embdedup as module

    monkeypatch.setattr(module, "BLOCK", 40)
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    v = (base + rng.normal(size=(150, 64)) * 0.02).astype(np.float32)
    rows = rows_of(v, [1] * 150)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_links(rows)


def test_embedding_edges(spark):
    assert duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    same = spark.createDataFrame([(5, [1.0, 0.0], 1, "a"), (6, [1.0, 0.0], 1, "a"), (6, [1.0, 0.0], 1, "a"), (7, [2.0, 0.0], 1, "a"), (8, [1.0], 1, "a")], SCHEMA)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in duplicates(same).collect())
    assert got == [(5, 3, 5, True), (6, 3, 5, False), (6, 3, 5, False), (7, 3, 5, False), (8, 0, 8, True)]
