"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by pseudo-random rotations (three rounds of random signs and
a fast Hadamard transform); its nearest vertex of the cross-polytope, the
coordinate of largest size and its sign, is one hash.  ``HASHES`` of them key a
bucket in each of ``TABLES`` tables.  Beside its own bucket a vector probes the
``PROBES`` - 1 buckets that the smallest loss of size leads to.  Vectors of one
label that share a bucket are compared by cosine in double precision.

Buckets larger than ``BLOCK`` are compared in pairs of blocks, each a task's
group of bounded size.  A pair that shares several buckets counts in the first
of them alone, so that links are counted without a row for each.  Equal vectors
collapse beforehand and count by their number.

Cases: a null label or id, and a vector that is null, zero, or holds null or
non-finite components, links with nothing and is kept; vectors of different
length don't link; repeated rows link with each other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from weftline.functions.pages import spread
from weftline.llm._shared import connected_components, materialise, mix64
from weftline.llm._vectors import list_rows, matrix

TABLES, HASHES, PROBES = 8, 2, 3
BLOCK = 2048
#: Groups up to this size are compared many at a time.
SMALL = 32
#: Pairs held at once.
PAIRS = 200_000
_SEED = 41


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of each row, up to scale; the width is a power of 2."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return x


def bucket_keys(x: np.ndarray, group: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """(rows, tables * probes) keys of the buckets of the unit vectors ``x``."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rng = np.random.default_rng(_SEED)
    rows = np.arange(len(x))
    out = np.empty((len(x), tables, probes), dtype=np.uint64)
    for t in range(tables):
        codes, losses = [], []  # of the best and second vertex of each hash
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
            size = np.abs(y)
            two = np.argpartition(-size, 1, axis=1)[:, :2]
            swap = size[rows, two[:, 0]] < size[rows, two[:, 1]]
            two[swap] = two[swap][:, ::-1]
            at = [two[:, 0], two[:, 1]]
            codes.append([(2 * a + (y[rows, a] < 0)).astype(np.uint64) for a in at])
            losses.append(size[rows, at[0]] - size[rows, at[1]])
        order = np.argsort(np.stack(losses, 1), axis=1, kind="stable")
        for p in range(probes):
            key = mix64(group + np.uint64(t * 1_000_003 + 17))
            for h in range(hashes):
                other = (order[:, p - 1] == h) if p else np.zeros(len(x), bool)
                key = mix64(key * np.uint64(31) + np.where(other, codes[h][1], codes[h][0]) + np.uint64(1))
            out[:, t, p] = key
    return out.reshape(len(x), tables * probes)


def _features(vectors: DataFrame) -> DataFrame:
    """vec_id, label and, for vectors that take part, a print of the vector
    together with its label, and its unit vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, unit = [], [], []
            for i, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), list_rows(batch.column(2)), strict=True):
                top = np.abs(v).max(initial=0) if v is not None else 0
                if i is None or label is None or not top > 0 or not np.isfinite(v).all():
                    hi.append(None), lo.append(None), unit.append(None)
                    continue
                v = v / top
                v = v / np.sqrt(v @ v)
                print_ = xxhash.xxh3_128_intdigest(v.tobytes() + str(label).encode())
                hi.append((print_ >> 64) - 2**63), lo.append(print_ % 2**64 - 2**63), unit.append(v.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(unit, pa.binary())],
                names=["vec_id", "label", "p0", "p1", "unit"])

    return spread(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")).mapInArrow(
        run, "vec_id long, label string, p0 long, p1 long, unit binary")


def _hashed(reps: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(3).to_pylist()
            sizes = np.array([len(u) for u in units])
            group = np.array([xxhash.xxh3_64_intdigest(f"{x}/{n}".encode()) for x, n in zip(batch.column(2).to_pylist(), sizes, strict=True)], dtype=np.uint64)
            keys = np.empty((len(units), tables * probes), dtype=np.uint64)
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                keys[own] = bucket_keys(matrix([units[i] for i in own], np.float64), group[own], tables, hashes, probes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))],
                names=["rep", "weight", "unit", "keys"])

    return reps.select("rep", "weight", "label", "unit").mapInArrow(run, "rep long, weight long, unit binary, keys array<long>")


def _first_shared(a: np.ndarray, b: np.ndarray, here: np.ndarray, probes: int) -> np.ndarray:
    """Whether ``here`` is the first bucket that the rows of a and b share."""
    first = np.ones(len(a), bool)
    open_ = np.ones(len(a), bool)  # not yet past the table of ``here``
    for t in range(0, a.shape[1], probes):
        at = np.zeros(len(a), bool)
        for p in range(t, t + probes):
            at |= a[:, p] == here
        for p in range(t, t + probes):
            for r in range(t, t + probes):
                same = (a[:, p] == b[:, r]) & open_
                first &= ~(same & (~at | (a[:, p] < here)))
        open_ &= ~at
    return first


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of n rows by the links (i, j)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(start: np.ndarray, cut: np.ndarray, unit: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of linked rows of each group start[g]:start[g + 1]; rows from
    cut[g] on, if it is inside, are compared with those before it only."""
    sizes = np.diff(start)
    whole = cut >= start[1:]
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = whole & (sizes <= SMALL)
    inside = small[group]
    for d in range(1, min(SMALL, int(sizes[small].max(initial=0)))):
        i = np.flatnonzero(inside[: len(group) - d] & (group[: len(group) - d] == group[d:]))
        for at in range(0, len(i), PAIRS):
            part = i[at : at + PAIRS]
            good = np.einsum("ij,ij->i", unit[part], unit[part + d]) >= least
            yield part[good], part[good] + d
    for g in np.flatnonzero(~small):
        a, b = start[g], start[g + 1]
        mid = b if whole[g] else cut[g]
        for at in range(a, mid, 256):
            left = slice(at, min(at + 256, mid))
            right = slice(left.start, b) if whole[g] else slice(mid, b)
            i, j = np.nonzero(unit[left] @ unit[right].T >= least)
            i, j = i + left.start, j + right.start
            yield i[i < j], j[i < j]


def duplicates(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of
    ``vectors(vec_id, embedding, label)``."""
    if probes > hashes + 1:
        raise ValueError("there are only hashes + 1 probes")
    rows = materialise(_features(vectors), "embeddings")
    same = ["p0", "p1"]
    reps = rows.where("p0 is not null").groupBy(*same).agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    reps = materialise(reps, "embeddings-reps")
    hashed = materialise(_hashed(reps, tables, hashes, probes), "embeddings-hashed")
    entries = hashed.select("rep", F.explode("keys").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(
        "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    met = entries.join(buckets, "bucket").withColumn("b", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "bucket", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "rep")
    cells = met.join(hashed, "rep").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "b", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(part):
            bucket, lo, hi, b, rep, weight = (part.column(k).to_numpy() for k in range(6))
            if not len(bucket):
                return
            keys = part.column(7).combine_chunks().flatten().to_numpy().reshape(len(bucket), -1)
            unit = matrix(part.column(6).to_pylist(), np.float64)
            new = np.r_[True, (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
            start = np.r_[np.flatnonzero(new), len(bucket)]
            size = np.diff(start)
            in_low = np.add.reduceat((b == lo).astype(np.int64), start[:-1])
            # A cell that got rows of one block only has nothing to compare.
            split = np.where(in_low == size, start[:-1], start[:-1] + in_low)
            cut = np.where(lo[start[:-1]] == hi[start[:-1]], start[1:], split)
            count = np.zeros(len(bucket), dtype=np.int64)
            ends = []
            for i, j in _links(start, cut, unit, least):
                for at in range(0, len(i), PAIRS):
                    a, c = i[at : at + PAIRS], j[at : at + PAIRS]
                    good = _first_shared(keys[a], keys[c], bucket[a], probes)
                    a, c = a[good], c[good]
                    np.add.at(count, a, weight[c])
                    np.add.at(count, c, weight[a])
                    ends.append((a, c))
            i, j = (np.concatenate([e[s] for e in ends]) if ends else np.zeros(0, np.int64) for s in (0, 1))
            root = _roots(len(bucket), i, j)
            linked = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[root[linked]]), pa.array(count[linked])], names=["rep", "root", "n"])

        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            last = tuple(held.column(k)[-1].as_py() for k in range(3))
            first = tuple(held.column(k)[0].as_py() for k in range(3))
            if first == last or held.num_rows < 4096:
                continue
            n = held.num_rows
            ids = [held.column(k).to_numpy() for k in range(3)]
            done = int(np.flatnonzero((ids[0] != last[0]) | (ids[1] != last[1]) | (ids[2] != last[2]))[-1]) + 1
            yield from out(held.slice(0, done).combine_chunks())
            held = held.slice(done, n - done)
        if held is not None:
            yield from out(held.combine_chunks())

    found = cells.select("bucket", "lo", "hi", "b", "rep", "weight", "unit", "keys").mapInArrow(run, "rep long, root long, n long")
    found = materialise(found, "embeddings-links")
    labels = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = reps.select(*same, "rep", "weight").join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        *same, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    result = rows.drop("unit", "label").join(known, same, "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
