import zlib
from math import log

import pytest
import xxhash

from weftline.llm import mixing, sharding, warc

DOCS = "doc_id long, text string, lang string, source string, position double"


def docs_of(spark, sizes, extra=()):
    rows = [(k, " ".join(["w"] * n), "en", s, 0.0) for k, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows + list(extra), DOCS)


def fill(sizes, weights, total, cap=2):
    """Share by weight, stop at the cap, share the excess again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_ and total > 1e-9:
        level = total / sum(weights[s] for s in open_)
        full = {s for s in open_ if target[s] + weights[s] * level > cap * sizes[s]}
        for s in open_ if not full else full:
            add = cap * sizes[s] - target[s] if full else weights[s] * level
            target[s] += add
            total -= add
        if not full:
            break
        open_ -= full
    return target


def test_mix_reaches_the_targets(spark):
    sizes = [("a", 5 + k % 40) for k in range(300)] + [("b", 1 + k % 9) for k in range(60)] + [("c", 30) for _ in range(40)] + [(None, 3) for _ in range(50)]
    docs = docs_of(spark, sizes, [(999, None, "en", "a", None), (None, "x y", None, "b", None)])
    rows = mixing.assign(docs).collect()
    by = {}
    for r in rows:
        s = by.setdefault(r.source_size, [0, 0, r.target])
        s[0] += r.size
        s[1] += r.taken
        assert 0 <= r.taken <= 2 * r.size and all(0 <= p <= 1 for p in r.positions)
    real = {"a": sum(n for s, n in sizes if s == "a"), "b": sum(n for s, n in sizes if s == "b") + 2, "c": 1200, None: 150}
    want = fill(real, {"a": 3, "b": 1, "c": 2, None: 3}, 1.5 * sum(real.values()))
    assert sorted(by) == sorted(real.values())
    for s, n in real.items():
        assert by[n][0] == n and abs(by[n][2] - want[s]) < 1e-6 and abs(by[n][1] - want[s]) <= 1
    again = {(r.doc_id, r.taken, tuple(r.positions)) for r in mixing.assign(docs).collect()}
    assert again == {(r.doc_id, r.taken, tuple(r.positions)) for r in rows}


def test_curriculum_follows_the_schedule(spark):
    docs = docs_of(spark, [("a", 10)] * 400 + [("b", 10)] * 400)
    plan = mixing.assign(docs, weights=(1, 1), share=1.0, slopes=(0.8, -0.8)).collect()
    early = {s: sum(p < 0.5 for r in plan for p in r.positions if (r.doc_id < 400) == (s == "a")) for s in "ab"}
    assert abs(early["a"] - 400 * 0.3) < 10 and abs(early["b"] - 400 * 0.7) < 10  # integrals of 1 +- 0.8 (2t - 1) to one half
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns and out.count() == sum(len(r.positions) for r in mixing.assign(docs).collect())


def test_mix_edges(spark):
    assert mixing.assign(spark.createDataFrame([], DOCS)).count() == 0
    none = mixing.assign(spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", None)], DOCS)).collect()
    assert {(r.size, r.taken, len(r.positions)) for r in none} == {(0, 0, 0)}


def spark_hash(key, name):
    first = xxhash.xxh64(key.encode(), seed=42).intdigest()
    return xxhash.xxh64(name.encode(), seed=first).intdigest()


def descend(key, node, path=""):
    best = None
    for name, child in node.items():
        u = ((spark_hash(key, f"{path}/{name}") >> 12) + 0.5) / 2**52
        draw = (-log(u) / sharding._weight(child), name, child)
        best = draw if len(node) == 1 or best is None or draw[0] < best[0] else best
    return descend(key, best[2], f"{path}/{best[1]}") if isinstance(best[2], dict) else best[1]


def test_shards(spark):
    rows = [(k * 7, f"tëxt {k % 90}" if k % 11 else None, "en", "s", 0.0) for k in range(3000)] + [(None, "x", None, None, None), (21, "tëxt 3", "en", "s", 0.0)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by_shard, text = {}, {}
    for i, t, *_ in rows:
        text.setdefault(i, t)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == descend(key, sharding.TREE) and r.grown_shard == descend(key, sharding.GROWN)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
        body = (text[r.doc_id] or "").encode()
        assert r.size == len(body) + 1 and r.text_crc32 == zlib.crc32(body)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert set(by_shard) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(300 < len(s) < 450 for s in by_shard.values()) and 250 < sum(r.grown_shard == 8 for r in got) < 420
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


def test_a_heavier_subtree_takes_only_into_itself(spark):
    keys = spark.range(2000).select(mixing.F.col("id").cast("string").alias("k"))
    heavy = sharding.TREE | {"r1": {"k0": {4: 1.0, 5: 1.0}, "k1": {6: 1.0, 7: 3.0}}}
    rows = keys.select(sharding.descend(mixing.F.col("k"), sharding.TREE).alias("a"), sharding.descend(mixing.F.col("k"), heavy).alias("b")).where("a <> b").collect()
    assert rows and all(r.b in (4, 5, 6, 7) for r in rows) and all(r.b in (6, 7) for r in rows if r.a in (4, 5))


PAGES = "page_id long, url string, html string, payload string"


def test_archive_round_trip(spark):
    big, other = "<p>é" * 400, "<q>x" * 400
    rows = [(1, "http://a/", big, "x"), (5, "http://b/\r\nX: y", big, "x"), (3, None, big, None), (7, "u", "tiny", "x"), (8, "u", "tiny", "x"), (9, "u", None, "x"), (10, "u", other, "x"), (10, "u", other, "x")]
    path = warc.write_archive(spark.createDataFrame(rows, PAGES))
    records = warc.read_archive(spark, path).collect()
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in records)
    assert got == [(1, "revisit", 5), (3, "revisit", 5), (5, "response", None), (7, "response", None), (8, "response", None), (9, "response", None), (10, "response", None), (10, "response", None)]
    body = {i: (h or "").encode() for i, _, h, _ in rows}
    for r in records:
        assert bytes(r.payload) == body[r.page_id]
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        names = [x.split(b": ", 1)[0] for x in head.split(b"\r\n")[1:]]
        length = int(next(x.split(b": ")[1] for x in head.split(b"\r\n") if x.startswith(b"Content-Length")))
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and len(names) == len(set(names)) and b"X" not in names
        assert block[length:] == b"\r\n\r\n"
        if r.record_type == "response":
            assert block[:length].endswith(body[r.page_id])
    assert spark.read.parquet(f"{path}/payloads").count() == 4  # each payload once
    empty = warc.write_archive(spark.createDataFrame([], PAGES))
    assert warc.read_archive(spark, empty).count() == 0


def test_damaged_archive_is_an_error(spark, tmp_path):
    path = warc.write_archive(spark.createDataFrame([(1, "u", "a" * 10, "x")], PAGES), str(tmp_path / "w"))
    held = spark.read.parquet(f"{path}/payloads").withColumn("payload", mixing.F.lit("b" * 10).cast("binary")).collect()
    spark.createDataFrame(held, spark.read.parquet(f"{path}/payloads").schema).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, path).collect()
