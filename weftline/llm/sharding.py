"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child draws
``-ln(u) / weight`` with a u in (0, 1) hashed from the row's id and the child's
name, and the smallest draw wins, so that a child gets rows in proportion to
its weight (the sum of its shards').  If a weight grows, rows move only into
the subtree that grew; a new shard in a region of its own takes rows from all
others and only into itself.

Slots number the rows of a shard without gaps.  They go through bins of the
hash of id and text checksum, so that an id of very many rows fills many bins:
counts of (shard, bin) give each bin's first slot, and only a bin is numbered as
one group.

Cases: a null text has size 1 and the checksum of the empty string; a null id is
hashed as the empty string and goes where its draws lead; repeated rows share a
shard and have slots of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.llm._shared import materialise

#: region -> rack -> shard -> weight
TREE = {
    "r0": {"k0": {0: 1.0, 1: 1.0}, "k1": {2: 1.0, 3: 1.0}},
    "r1": {"k0": {4: 1.0, 5: 1.0}, "k1": {6: 1.0, 7: 1.0}},
}
#: The same with one more shard, in a region of its own.
GROWN = TREE | {"r2": {"k0": {8: 1.0}}}
BINS = 4096


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _uniform(key: Column, name: str) -> Column:
    """In the open interval (0, 1), from 52 bits of the hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def descend(key: Column, node: dict, path: str = "") -> Column:
    """The shard in ``node`` that ``key`` (a string) belongs to."""
    children = [(f"{path}/{name}", child) for name, child in node.items()]
    leaf = lambda where, child: F.lit(int(where.rpartition("/")[2])) if not isinstance(child, dict) else descend(key, child, where)
    if len(children) == 1:
        return leaf(*children[0])
    draws = [-F.log(_uniform(key, where)) / F.lit(_weight(child)) for where, child in children]
    best, choice = F.least(*draws), None
    for draw, (where, child) in zip(draws, children, strict=True):
        choice = (F if choice is None else choice).when(draw == best, leaf(where, child))
    return choice


def shard(docs: DataFrame, tree: dict = TREE, grown: dict = GROWN, bins: int = BINS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row
    of ``docs(doc_id, text)``."""
    key, body = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    slot = F.xxhash64(key, F.crc32(body.cast("binary")), F.lit("slot"))
    rows = docs.select(
        "doc_id", (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        descend(key, tree).alias("shard"), descend(key, grown).alias("grown_shard"),
        F.pmod(slot, F.lit(bins)).cast("int").alias("bin"),
    )
    rows = materialise(rows, "shards")
    counts = rows.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bin", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32", "size")
    return rows.join(counts, ["shard", "bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("ahead") + F.row_number().over(inside) - 1).cast("long").alias("slot"), "grown_shard",
    )
