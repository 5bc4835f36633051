"""Exact top-k search by multi-resolution segment statistics.

Vectors are quantised to integers, ``floor(scale * x)``.  At each resolution a
vector is cut into segments of which only sum and centred norm are kept; the
Cauchy-Schwarz inequality inside each segment gives an upper bound of the inner
product (a lower bound of the distance, as |q - x|^2 = |q|^2 + |x|^2 - 2 q.x).
Going from coarse to fine, candidates whose bound is below the k-th best exact
score known so far are dropped; exact scores are computed for the survivors.

Queries and candidates meet in cells of a bounded number of rows: every
candidate is sent to each block of queries, every query to each block of
candidates, and a cell returns at most 2 k rows for each of its queries.

Cases: a vector that is null or holds a null or non-finite component takes no
part, neither does one without id; shorter vectors count as padded with zeros;
any finite component is taken as it is up to 2**500, and held there beyond;
scores are exact where they fit 64 bits and otherwise held at ``+-LIMIT``, for
the pairs concerned alone (ties there, too, go to the smaller vec_id);
rows that share the query's id are not its candidates; ties go to the smaller
vec_id; repeated rows are results of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions.pages import spread
from weftline.llm._shared import materialise
from weftline.llm._vectors import list_rows

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
SEGMENTS = (1, 4, 16)
#: Queries of a cell whose bounds are held at once.
CHUNK = 128
#: Components of either side that are multiplied at once.
DOT_COMPONENTS = 1 << 22
#: Vectors of smaller norms have exact inner products in double precision.
PLAIN_NORM = 2.0**26
#: The largest score, and negated the smallest.
LIMIT = 2**63 - 1


def _pack(v: np.ndarray) -> bytes:
    """A vector of integers (as doubles) in the narrowest of three types, after
    the type's code."""
    largest = np.abs(v).max(initial=0)
    code = "h" if largest < 2.0**15 else "i" if largest < 2.0**31 else "d"
    return code.encode() + v.astype(code).tobytes()


def _unpack(rows: list[bytes]) -> np.ndarray:
    vectors = [np.frombuffer(r, chr(r[0]), offset=1) for r in rows]
    out = np.zeros((len(rows), max(map(len, vectors), default=0)))
    for own, v in zip(out, vectors, strict=True):
        own[: len(v)] = v
    return out


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and the packed integer vector of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, v in zip(batch.column(0).to_pylist(), list_rows(batch.column(1)), strict=True):
                if i is not None and v is not None and np.isfinite(v).all():
                    ids.append(i)
                    with np.errstate(over="ignore"):
                        rows.append(_pack(np.clip(np.floor(scale * v), -(2.0**500), 2.0**500)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["vec_id", "v"])

    return spread(vectors.select(F.col("vec_id").cast("long"), "embedding")).mapInArrow(run, "vec_id long, v binary")


def _bounds(x: np.ndarray, segments: int) -> np.ndarray:
    """Features whose inner products bound those of the vectors from above; the
    last one covers rounding."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1])))
    out = np.empty((len(x), 2 * len(parts) + 1))
    for k, own in enumerate(parts):
        if not len(own):
            out[:, 2 * k : 2 * k + 2] = 0
            continue
        mean = x[:, own].mean(1)
        out[:, 2 * k] = mean * np.sqrt(len(own))
        out[:, 2 * k + 1] = np.sqrt(((x[:, own] - mean[:, None]) ** 2).sum(1))
    out[:, -1] = 3e-5 * np.linalg.norm(x, axis=1)
    return out


def _dots(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of ``q`` and j of ``c``, pair by pair."""
    out, step = np.empty(len(i), q.dtype), max(1, DOT_COMPONENTS // max(1, q.shape[1]))
    for at in range(0, len(i), step):
        own = slice(at, at + step)
        out[own] = np.einsum("ij,ij->i", q[i[own]], c[j[own]])
    return out


def _best(i: np.ndarray, j: np.ndarray, exact: np.ndarray, c_ids: np.ndarray, k: int):
    """The k best pairs of each i, ties to the smaller id."""
    order = np.lexsort((c_ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], j[best], exact[best]


def _plain_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """``cell_top`` for norms below ``PLAIN_NORM``: bounds, then exact scores."""
    levels = [(_bounds(q, s), _bounds(c, s)) for s in SEGMENTS]
    for at in range(0, len(q), CHUNK):
        rows = slice(at, at + CHUNK)
        own = q_ids[rows, None] == c_ids[None, :]
        bound = levels[0][0][rows] @ levels[0][1].T
        bound[own] = -np.inf
        seeds = min(4 * k, len(c))
        first = np.argpartition(-bound, seeds - 1, axis=1)[:, :seeds]
        scores = _dots(q[rows], c, np.repeat(np.arange(len(first)), seeds), first.ravel()).reshape(first.shape)
        scores[np.take_along_axis(own, first, 1)] = -np.inf
        least = np.sort(scores, axis=1)[:, ::-1][:, k - 1] if seeds >= k else np.full(len(scores), -np.inf)
        least = least - 1e-6
        left = bound >= least[:, None]
        left &= ~own
        for qb, cb in levels[1:]:
            i, j = np.nonzero(left)
            if len(i) * 4 > left.size:
                left &= qb[rows] @ cb.T >= least[:, None]
            else:
                keep = _dots(qb[rows], cb, i, j) >= least[i]
                left[i[~keep], j[~keep]] = False
        i, j = np.nonzero(left)
        exact = (q[rows] @ c.T)[i, j] if len(i) * 4 > left.size else _dots(q[rows], c, i, j)
        i, j, exact = _best(i, j, exact.astype(np.int64), c_ids, k)
        yield i + at, j, exact


def _modulo(x: np.ndarray) -> np.ndarray:
    """Integers held as doubles, modulo 2**64."""
    rest = np.fmod(x, 2.0**64)
    size = np.abs(rest).astype(np.uint64)
    return np.where(rest < 0, np.uint64(0) - size, size)


def _wide_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """``cell_top`` for any norms.  Double precision with its error tells which
    scores may be among the k best and which are beyond 64 bits; those that fit
    are computed modulo 2**64, which is exact for them."""
    qm, cm, q_norm, c_norm = _modulo(q), _modulo(c), np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    for at in range(0, len(q), CHUNK):
        rows = slice(at, at + CHUNK)
        near = q[rows] @ c.T
        error = (q.shape[1] + 8) * 2.0**-52 * q_norm[rows, None] * c_norm[None, :]
        left = q_ids[rows, None] != c_ids[None, :]
        low = np.where(left, np.clip(near - error, -(2.0**63), 2.0**63), -np.inf)
        if k <= len(c):
            left &= near + error >= np.partition(low, len(c) - k, axis=1)[:, len(c) - k, None]
        i, j = np.nonzero(left)
        near, error = near[i, j], error[i, j]
        exact = _dots(qm[rows], cm, i, j).view(np.int64)
        exact = np.maximum(exact, -LIMIT)
        exact[near - error >= 2.0**63] = LIMIT
        exact[near + error <= -(2.0**63)] = -LIMIT
        for n in np.nonzero(np.abs(np.abs(near) - 2.0**63) <= error)[0]:  # too close to the limit for doubles
            whole = sum(int(x) * int(y) for x, y in zip(q[at + i[n]], c[j[n]], strict=True))
            exact[n] = max(-LIMIT, min(LIMIT, whole))
        i, j, exact = _best(i, j, exact, c_ids, k)
        yield i + at, j, exact


def cell_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """(query's row, candidate's row, score): the k best candidates of each
    query, and perhaps further ones.  ``q`` and ``c`` hold integers as doubles."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, c))
    kinds = [[np.nonzero(own)[0] for own in (plain, ~plain)] for plain in (np.linalg.norm(m, axis=1) < PLAIN_NORM for m in (q, c))]
    (q_plain, q_wide), (c_plain, c_wide) = kinds
    for top, qs, cs in ((_plain_top, q_plain, c_plain), (_wide_top, q_plain, c_wide), (_wide_top, q_wide, np.arange(len(c)))):
        if len(qs) and len(cs):
            for i, j, exact in top(q_ids[qs], q[qs], c_ids[cs], c[cs], k):
                yield qs[i], cs[j], exact


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of
    each row of ``vectors(vec_id, embedding)`` for which ``is_query`` (over
    vec_id) holds."""
    rows = materialise(quantised(vectors, scale), "vectors")
    found = rows.agg(F.count("*").alias("c"), F.count(F.when(is_query, 1)).alias("q")).first()
    n_q, n_c = max(1, -(-found.q // QUERY_BLOCK)), max(1, -(-found.c // CANDIDATE_BLOCK))
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "v", F.lit(False).alias("query"), block(n_c, "c").alias("cb"), every(n_q).alias("qb"))
    queries = rows.where(is_query).select("vec_id", "v", F.lit(True).alias("query"), block(n_q, "q").alias("qb"), every(n_c).alias("cb"))
    cells = candidates.unionByName(queries).withColumn("cell", F.col("qb").cast("long") * n_c + F.col("cb"))
    cells = cells.repartition("cell").sortWithinPartitions("cell").select("cell", "query", "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def out():
            q = [(i, v) for is_q, i, v in held if is_q]
            c = [(i, v) for is_q, i, v in held if not is_q]
            if not q or not c:
                return
            q_ids, c_ids = np.array([x[0] for x in q], np.int64), np.array([x[0] for x in c], np.int64)
            for i, j, s in cell_top(q_ids, _unpack([x[1] for x in q]), c_ids, _unpack([x[1] for x in c]), k):
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(c_ids[j]), pa.array(s)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for key, *row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if key != cell:
                    yield from out()
                    cell, held = key, []
                held.append(row)
        yield from out()

    best = cells.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
