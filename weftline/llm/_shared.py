"""Helpers that several operators of this subpackage share.

Nothing here keeps data on the driver beyond a few bounded aggregates.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Word pattern of the corpus operators: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A word cache of this many entries is emptied before the next batch.
WORD_CACHE = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where
    a local session names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither
    recompute it nor depend on an executor that may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_column(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the name with underscores that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, computed once for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORD_CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit (wraps modulo 2**64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; the whole sequence as one run if
    there are fewer; nothing for no words."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        out = mix64(out + words[k : len(words) - width + 1 + k] + np.uint64(0x9E3779B97F4A7C15))
    return out


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of the distinct ``edges(u, v)``, u > v, either hangs on
    one other or has others hung on it: v is then the smallest node reachable."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("n")).where("n > 1").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that ``edges(src, dst)`` names, where
    component is the smallest node reachable.

    Alternates the two star operations: each node's larger (then smaller)
    neighbours are hung on its smallest neighbour until only stars are left,
    which takes no round for edges that are stars already.  Each
    step pre-aggregates a minimum for a node and writes it before the join that
    applies it: that join's sides are then plain exchanges, which Spark can split
    for a node with very many neighbours.
    """
    edges = edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct()
    edges = materialise(edges, "cc")
    for _ in range(max_rounds):
        if _are_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc-least")
        large = (
            both.where("v > u").join(least, "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = materialise(large, "cc-large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "cc")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def radix_threshold(df: DataFrame, key: str, want: int) -> tuple[int | None, int]:
    """The ``want``-th largest value t of the non-negative long column ``key``
    and how many rows equal to t belong to the top ``want``.

    Four counting passes over 16 bits each bring at most 65,536 counts to the
    driver, whatever the number of rows; nothing is sorted.
    """
    if want <= 0:
        return None, 0
    prefix, shift = 0, 48
    rows = df.select(F.col(key).alias("k"))
    while True:
        digit = F.shiftright("k", shift).bitwiseAND(F.lit(0xFFFF)).alias("d")
        counts = dict(rows.groupBy(digit).count().collect())
        for d in sorted(counts, reverse=True):
            if want <= counts[d]:
                break
            want -= counts[d]
        else:
            return None, 0
        prefix |= d << shift
        if shift == 0:
            return prefix, want
        rows = rows.where(F.shiftright("k", shift).bitwiseAND(F.lit(0xFFFF)) == d)
        shift -= 16


def modest_batches(spark: SparkSession, records: int = 500) -> None:
    """Batches of at most ``records`` rows for Python, as texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= records:
        spark.conf.set(key, str(records))
