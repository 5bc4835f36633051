"""Quality by importance resampling.

Text is turned into hashed n-grams: words, pairs of words, and runs of one to
three token shapes (case and length class, digits, punctuation, whether a word
repeats one of the two before).  Two generative models give each bucket a
probability, one for target text (labelled good) and one for raw text (all
documents).  A document's log importance weight is the mean log ratio of its
n-grams divided by ``TEMPERATURE``.  Adding Gumbel noise, hashed from id and seed,
and keeping the k largest draws k documents in proportion to their weights without
replacement: another seed draws another set.

k is fixed before any document is weighed: the share of good labels, and one
standard error more so that clean documents are rather kept, of all rows; or the
share the caller names.

The raw model counts every document.  The target model uses a bounded sample of
rows labelled good (``SAMPLE``, chosen by hash), smoothed towards the raw model.

Cases: a null or empty text has no n-grams and weight 0, that of text the models
don't tell apart, and is drawn as such; a null id has the noise of the empty string;
repeated rows get equal keys; without labels of both classes, and for an empty
table, nothing is rejected; ``drop_rejected`` keeps rows without id; other columns
pass through ``resample`` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.pages import spread
from weftline.llm._shared import WORD_CACHE, free_column, materialise, radix_threshold

SAMPLE = 4000
WORD_BITS, SHAPE_BITS = 14, 12
WORD_BUCKETS, SHAPE_BUCKETS = 1 << WORD_BITS, 1 << SHAPE_BITS
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
#: Observations of the raw model, by bucket, that the target model starts with.
SMOOTHING = 1.0
SEED = 7
#: Nats of mean log ratio that weigh as much as one unit of Gumbel noise.
TEMPERATURE = 0.1

_TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


class _Tokens(dict):
    """token -> its row in ``word`` and ``shape``, two hashes of the token."""

    def __init__(self) -> None:
        super().__init__()
        self.word = np.zeros(1 << 16, dtype=np.uint64)
        self.shape = np.zeros(1 << 16, dtype=np.uint64)

    def __missing__(self, token: bytes) -> int:
        at = self[token] = len(self)
        if at >= len(self.word):
            self.word, self.shape = np.resize(self.word, 2 * at), np.resize(self.shape, 2 * at)
        text = token.decode("utf-8", "replace")
        if text[0].isalnum():
            kind = "digits" if text.isdigit() else "upper" if text.isupper() else "lower" if text.islower() else "title" if text.istitle() else "mixed"
            shape = f"{kind}{min(len(text), 24) // 8}"
        else:
            shape = text
        self.word[at], self.shape[at] = xxhash.xxh3_64_intdigest(token.lower()), xxhash.xxh3_64_intdigest(shape.encode())
        return at


def _bucket(x: np.ndarray, bits: int) -> np.ndarray:
    """The highest bits of a product that depends on all bits of ``x``."""
    return (((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def grams(text: bytes, tokens: _Tokens) -> np.ndarray:
    """The bucket of each n-gram of ``text``."""
    if len(tokens) > WORD_CACHE:
        tokens.clear()
    found = _TOKENS.findall(text)
    at = np.fromiter(map(tokens.__getitem__, found), dtype=np.int64, count=len(found))
    word, shape = tokens.word[at], tokens.shape[at]
    again = np.zeros(len(word), dtype=bool)
    again[1:] = word[1:] == word[:-1]
    again[2:] |= word[2:] == word[:-2]
    shape = shape + again.astype(np.uint64)
    pair = word[:-1] * np.uint64(3) + word[1:]
    two = shape[:-1] * np.uint64(5) + shape[1:]
    three = two[:-1] * np.uint64(7) + shape[2:]
    words = _bucket(np.concatenate([word, pair]), WORD_BITS)
    return np.concatenate([words, _bucket(np.concatenate([shape, two, three]), SHAPE_BITS) + WORD_BUCKETS])


def _counts(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Two rows of counts by bucket: of all documents, and of the sample's.  Each
    task sends one row for a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = _Tokens(), np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            own = [grams(text.as_py() or b"", tokens) for text in batch.column(0)]
            good = [g for g, y in zip(own, batch.column(1).to_pylist(), strict=True) if y]
            for row, part in enumerate((own, good)):
                if part:
                    total[row] += np.bincount(np.concatenate(part), minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "raw", "target"])

    rows = spread(docs.select("doc_id", "text")).join(F.broadcast(sample), "doc_id", "left").select(F.col("text").cast("binary").alias("text"), F.coalesce("good", F.lit(False)).alias("good"))
    sums = rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    out = np.zeros((2, BUCKETS), dtype=np.int64)
    for bucket, raw, target in sums.collect():  # at most BUCKETS rows
        out[:, bucket] = raw, target
    return out


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the two models' probabilities by bucket, each kind of n-gram
    normalised for itself."""
    out = np.zeros(BUCKETS)
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, BUCKETS)):
        r = (raw[part] + 0.5) / (raw[part] + 0.5).sum()
        prior = SMOOTHING * len(r)
        out[part] = np.log((target[part] + prior * r) / (target[part].sum() + prior) / r)
    return out


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)), 12)
    return -F.log(-F.log((bits.cast("double") + 0.5) / F.lit(float(2**52))))


def _known(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").dropDuplicates(["doc_id"])


def label_sample(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, good): at most ``size`` rows labelled good."""
    return _known(labels).where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).select("doc_id", F.lit(True).alias("good"))


def target_share(labels: DataFrame) -> float:
    """The share of documents to keep: that of good labels and a standard error;
    1 without labels of both classes."""
    n, good = _known(labels).agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < good < n:
        return 1.0
    share = good / n
    return min(1.0, share + (share * (1 - share) / n) ** 0.5)


def weigh(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, key) of each row of ``docs(doc_id, text)``."""
    known = materialise(label_sample(labels, sample), "quality-sample")
    raw, target = _counts(docs, known)
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(raw, target) / TEMPERATURE if target.any() else np.zeros(BUCKETS))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, by_bucket = _Tokens(), ratios.value
        for batch in batches:
            weights = []
            for t in batch.column(1):
                own = grams(t.as_py() or b"", tokens)
                weights.append(float(by_bucket[own].mean()) if len(own) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.float64())], names=["doc_id", "log_weight"])

    rows = spread(docs.select("doc_id", F.col("text").cast("binary").alias("text"))).mapInArrow(run, f"doc_id {kind}, log_weight double")
    return materialise(rows.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "quality-weights")


def _ordered(value: Column) -> Column:
    """A non-negative long that orders as the double ``value`` does: its steps
    of 2**-20, within 2**42."""
    bound = F.lit(float(2**42))
    return F.floor((F.least(F.greatest(value, -bound), bound) + bound) * F.lit(float(2**19))).cast("long")


def resample(weighted: DataFrame, k: int) -> DataFrame:
    """The k rows of (doc_id, log_weight, key) with the largest keys, ties to
    the smaller doc_id's hash order, and all rows of an id that ties at the end."""
    rows = weighted.withColumn("_rank", _ordered(F.col("key")))
    least, ties = radix_threshold(rows, "_rank", k)
    if least is None:
        return weighted if k > 0 else weighted.limit(0)
    edge = rows.where(F.col("_rank") == least).withColumn(
        "_tie", F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1))
    last, _ = radix_threshold(edge, "_tie", ties)
    return rows.where(F.col("_rank") > least).unionByName(edge.where(F.col("_tie") >= F.lit(last)).drop("_tie")).drop("_rank")


def select(docs: DataFrame, labels: DataFrame, share: float | None = None, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, key) of the documents that the resampling draws: the
    given share of all, else ``target_share``."""
    share = target_share(labels) if share is None else share
    rows = weigh(docs, labels, sample, seed)
    return rows if share >= 1 else resample(rows, ceil(share * rows.count()))


def drop_rejected(docs: DataFrame, labels: DataFrame, share: float | None = None, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the resampling draws; rows without id stay."""
    share = target_share(labels) if share is None else share
    if share >= 1:
        return docs
    rows = weigh(docs, labels, sample, seed)
    kept = resample(rows, ceil(share * rows.count())).select("doc_id").distinct()
    name = free_column(docs, "rejected")
    rejected = rows.select("doc_id").distinct().join(kept, "doc_id", "left_anti").select(F.col("doc_id").alias(name))
    return docs.join(rejected.hint("shuffle_hash"), F.col("doc_id") == F.col(name), "left_anti")
