"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds the hashes of its distinct word shingles.  Instead of
drawing fresh minhashes for every table, a few *collections* of ``rows``
minhashes each are drawn; every pair of collections keys one table.  Twenty
collections would key 190 tables, so the number of minhashes is about the
square root of what independent tables need.  Two documents meet in a table
if they agree in two collections or more.

1. Equal sets collapse into one representative (smallest id).
2. Each table bucket links its members to the bucket's smallest one (a star,
   linear in the bucket); all distinct links are confirmed on full sets.
3. A bucket of three or more whose members still lie in several components may
   hide links that its star lacks.  These members are compared fully, in
   blocks of bounded size, and again confirmed on full sets.
4. Components of all confirmed links.

Cases: a null text, or one without words, has an empty set, is kept and linked
with nothing; fewer words than ``width`` make one shingle; repeated texts share
a component; ids are unique but for repeated rows, and a row without id is kept
and names no component; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.functions.pages import spread
from weftline.llm._shared import (
    WordHashes, connected_components, free_column, materialise, mix64, shingle_hashes,
)

#: Documents compared at once with as many others when buckets are searched.
#: Smaller blocks even out the tasks and ship more texts: a group's texts are
#: sent once for each of its blocks.
BLOCK = 384
BLOCK_SHINGLES = 1_000_000
_SEED = 20240229


@cache
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower() changes A-Z only, and
    bytes.split() splits at ASCII white space only."""
    words = text.lower().split() if text else []
    return np.unique(shingle_hashes(hashes.of(words), width))


def signatures(docs: DataFrame, width: int, collections: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit print of the set and one hash for each
    collection."""
    schema = "doc_id long, n_shingles long, p0 long, p1 long, " + ", ".join(f"c{k} long" for k in range(collections))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        mul, add = _family(collections * rows)
        for batch in batches:
            out = np.zeros((batch.num_rows, 3 + collections), dtype=np.uint64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = _set(text, width, hashes)
                if not len(own):
                    continue
                out[i, 0], out[i, 1], out[i, 2] = len(own), own.sum(), mix64(own ^ np.uint64(_SEED)).sum()
                least = np.full(len(mul), np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(own), 4096):  # bounded memory for very long texts
                    part = own[at : at + 4096, None] * mul + add
                    least = np.minimum(least, (part ^ (part >> np.uint64(31))).min(0))
                key = np.zeros(collections, dtype=np.uint64)
                for r in range(rows):
                    key = mix64(key + least[r::rows] + np.uint64(r + 1))
                out[i, 3:] = key
            cols = [batch.column(0).cast(pa.int64())] + [pa.array(out[:, k].view(np.int64)) for k in range(out.shape[1])]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))).mapInArrow(run, schema)


def _needed_texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the documents that take part in any comparison."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    return materialise(texts.join(ids.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"]), "minhash-texts")


def _similar(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those (src, dst) whose full sets reach the similarity."""
    both = (
        pairs.join(texts.withColumnsRenamed({"id": "src", "text": "a"}), "src")
        .join(texts.withColumnsRenamed({"id": "dst", "text": "b"}), "dst")
        .select("src", "dst", "a", "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        seen: tuple[int | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                dst = batch.column(1)[i].as_py()
                if seen[0] != dst:  # rows of one dst often follow each other
                    seen = (dst, _set(batch.column(3)[i].as_py(), width, hashes))
                x, y = _set(batch.column(2)[i].as_py(), width, hashes), seen[1]
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, type=pa.int64()))

    return both.mapInArrow(run, "src long, dst long")


def _postings(sets: list, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token number, set number) of the tokens in ``names``, by token."""
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
    known = names[at] == tokens
    order = np.argsort(at[known], kind="stable")
    return at[known][order], owner[known][order]


def _common(left: list, right: list) -> np.ndarray:
    """Sizes of all intersections between two lists of sets."""
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    names = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not len(names):
        return common
    (t_l, d_l), (t_r, d_r) = _postings(left, names), _postings(right, names)
    n_l, n_r = np.bincount(t_l, minlength=len(names)), np.bincount(t_r, minlength=len(names))
    # Tokens that many sets share go through a dense product, the others
    # through their postings.
    dense = n_l * n_r > max(64, common.size // 256)
    heavy = np.flatnonzero(dense)
    for at in range(0, len(heavy), 2048):
        place = np.full(len(names), -1)
        place[heavy[at : at + 2048]] = np.arange(len(heavy[at : at + 2048]))
        sides = []
        for t, d, n in ((t_l, d_l, len(left)), (t_r, d_r, len(right))):
            side = np.zeros((n, len(heavy[at : at + 2048])), dtype=np.float32)
            hit = place[t] >= 0
            side[d[hit], place[t][hit]] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    start = np.concatenate([[0], np.cumsum(n_r)])
    light = ~dense[t_l]
    t_l, d_l, flat = t_l[light], d_l[light], common.reshape(-1)
    for at in range(0, len(t_l), 4096):
        t, d = t_l[at : at + 4096], d_l[at : at + 4096]
        reps = n_r[t]
        step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        np.add.at(flat, np.repeat(d, reps) * len(right) + d_r[np.repeat(start[t], reps) + step], np.float32(1))
    return common


def _block_links(left: list, right: list | None, comp_l: np.ndarray, comp_r: np.ndarray, percent: int) -> np.ndarray:
    """(i, j) of similar sets of different components; right None: within left."""
    other = left if right is None else right
    common = _common(left, other).astype(np.float64)
    total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in other])[None, :]
    good = (100 * common >= percent * (total - common)) & (comp_l[:, None] != comp_r[None, :])
    return np.argwhere(np.triu(good, 1) if right is None else good)


def _search_groups(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """All links (src, dst) between members (g, id, comp, size) of one group
    that lie in different components, compared in blocks of about ``BLOCK``
    documents and ``BLOCK_SHINGLES`` shingles.  The members of a large group's
    largest component have blocks of their own, which meet those of the others
    only: what few strays need grows with the group, not with its square."""
    blocks_of = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    parts = members.groupBy("g", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", "size", "comp"))
    sizes = parts.groupBy("g").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), most.alias("most")).where(blocks_of(F.col("n"), F.col("size")) > 1)
    # Written first, so that Spark can split the join for a very large group.
    sizes = materialise(sizes.select(
        "g", F.col("most.comp").alias("major"), blocks_of(F.col("most.n"), F.col("most.size")).alias("nb_major"),
        blocks_of(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("nb")), "minhash-sizes")
    blocks = members.join(sizes, "g", "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("nb_major", F.coalesce("nb_major", F.lit(0)))
    major = F.coalesce(F.col("comp") == F.col("major"), F.lit(False))
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    blocks = blocks.withColumn("b", F.when(major, F.col("nb") + block(F.col("nb_major"))).otherwise(block(F.col("nb"))))
    partners = F.when(major, F.col("nb")).otherwise(F.col("nb") + F.col("nb_major"))
    cells = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), partners - 1))).select(
        F.xxhash64("g", F.least("b", "o"), F.greatest("b", "o")).alias("cell"), "g",
        F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "id", "comp",
    )
    rows = cells.join(texts, "id").repartition("cell").sortWithinPartitions("g", "lo", "hi", "b", "id")

    def pairs_of(key, rows, hashes):
        lo, hi = key[1], key[2]
        if len({r[2] for r in rows}) == 1:
            return []
        ids = [r[1] for r in rows]
        sets = [_set(r[3], width, hashes) for r in rows]
        comp = np.array([r[2] for r in rows], dtype=np.int64)
        if lo == hi:
            found = _block_links(sets, None, comp, comp, percent)
            return [(ids[i], ids[j]) for i, j in found]
        cut = sum(r[0] == lo for r in rows)
        if not cut or cut == len(rows):
            return []
        found = _block_links(sets[:cut], sets[cut:], comp[:cut], comp[cut:], percent)
        return [(ids[i], ids[cut + j]) for i, j in found]

    def thin(links):
        """A spanning forest of the links: as good for components, and short."""
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in links:
            x, y = find(a), find(b)
            if x != y:
                root[x] = y
                yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        key, held = None, []

        def out(links):
            links = list(thin(links))
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["src", "dst"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for g, lo, hi, b, i, comp, text in zip(*cols, strict=True):
                if key != (g, lo, hi):
                    if len(held) > 1:
                        yield out(pairs_of(key, held, hashes))
                    key, held = (g, lo, hi), []
                held.append((b, i, comp, text))
        if len(held) > 1:
            yield out(pairs_of(key, held, hashes))

    return rows.select("g", "lo", "hi", "b", "id", "comp", "text").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, collections: int = 14, rows: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of
    ``docs(doc_id, text)``.

    With the defaults a pair exactly at the threshold agrees in fewer than two
    of the 14 collections, and so has no table in common, with probability
    below 0.001 (0.512 is the chance that one collection agrees).
    """
    features = materialise(signatures(docs, width, collections, rows), "minhash")
    names = [f"c{k}" for k in range(collections)]
    reps = features.groupBy("p0", "p1", "n_shingles").agg(
        F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in names]
    )
    reps = materialise(reps, "minhash-reps")
    # A set smaller than this is similar to no other set but its equal.
    least = -(-percent // (100 - percent)) if percent < 100 else 2**62
    keys = F.array(*[F.xxhash64(F.lit(i * collections + j), names[i], names[j]) for i, j in combinations(range(collections), 2)])
    entries = reps.where(F.col("n_shingles") >= least).select("rep", F.explode(keys).alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("top"), F.count("*").alias("n"))
    shared = buckets.where("lead < top").select("bucket", "lead", "n")
    stars = materialise(
        entries.join(shared, "bucket").where("rep <> lead").select("bucket", "rep", "lead", "n"), "minhash-stars")
    pairs = stars.select(F.col("rep").alias("src"), F.col("lead").alias("dst")).distinct()
    ids = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    texts = _needed_texts(ids, docs)
    links = materialise(_similar(pairs, texts, width, percent), "minhash-links")

    found = connected_components(links)
    known = lambda frame, col, out: frame.join(
        found.withColumnsRenamed({"node": col, "component": out}), col, "left").withColumn(out, F.coalesce(out, col))
    large = known(known(stars.where("n > 2"), "rep", "comp"), "lead", "lead_comp")
    mixed = large.groupBy("bucket").agg(
        F.min(F.least("comp", "lead_comp")).alias("x"), F.max(F.greatest("comp", "lead_comp")).alias("y")
    ).where("x <> y").select("bucket")
    open_ = materialise(large.join(mixed, "bucket").select("lead", "rep", "comp").distinct(), "minhash-open")
    members = open_.join(reps.select("rep", F.col("n_shingles").alias("size")), "rep").select(
        F.col("lead").alias("g"), F.col("rep").alias("id"), "comp", "size")
    extra = materialise(_search_groups(members, texts, width, percent), "minhash-extra")

    # The stars found stand for their links; without extra ones they are the result.
    joined = connected_components(found.withColumnsRenamed({"node": "src", "component": "dst"}).unionByName(extra))
    labels = reps.select("p0", "p1", "n_shingles", "rep").join(
        joined.withColumnsRenamed({"node": "rep", "component": "c"}), "rep", "left"
    ).select("p0", "p1", "n_shingles", F.coalesce("c", "rep").alias("component_id"))
    out = features.join(labels, ["p0", "p1", "n_shingles"])
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without those whose component has an earlier one.
    Of repeated rows of one id one stays; rows without id all stay."""
    found, copy = near_duplicates(docs, **options), free_column(docs, "copy")
    copies = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias(copy)).distinct()
    left = docs.join(copies.hint("shuffle_hash"), F.col("doc_id") == F.col(copy), "left_anti")
    ids = docs.where("doc_id is not null").agg(F.count("doc_id").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    if ids.n == ids.d:
        return left
    named = left.where("doc_id is not null").dropDuplicates(["doc_id"])
    return named.unionByName(left.where("doc_id is null"))
