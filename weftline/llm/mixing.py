"""Mixing sources to target weights along a time-varying curriculum.

Sources take turns at the given weights and share ``share`` times all words;
no source is asked for more than ``cap`` times its own words, and what it can't
give is shared anew by weight (water filling, solved in closed form).

Each source's weight changes over the training time t in [0, 1]; its schedule
``1 + b (2t - 1)`` integrates to the cumulative demand
``target * ((1 - b) t + b t^2)``.  A source's documents are laid out along its
token axis in a fixed pseudo-random order, as often as the target asks for, and
the demand is inverted at each start: that is the training position.  Documents
are then range-sorted by position.

Only DataFrame functions are used.  The running sums inside a source go through
``BINS`` bins of the order's hash, so that a source that holds most rows is
many small windows.

Cases: a null or empty text has size 0 and is never taken; a null source is a
source of its own, the last one; rows without id are ordered by their texts'
checksums, so that many of them fill many bins;
repeated rows are taken each for itself; an empty table gives an empty result;
other columns pass through ``curriculum`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.llm._shared import WORD, free_column, materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Slopes b of the schedules, dealt out to the sources like the weights.
SLOPES = (0.5, 0.0, -0.5)
#: Hexadecimal digits of the order's hash that make a bin: 4,096 bins.
BIN_DIGITS = 3


def _key(source: str = "source") -> Column:
    """Orders as the source does, null last, and is never null itself."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", _key().alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("string"))).cast("binary")).alias("turn"),
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, slopes=SLOPES) -> DataFrame:
    """(key, source_size, target, slope) from one row (key, source_size) a source."""
    cycle = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("turn_no") % len(values) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("turn_no", F.row_number().over(every.orderBy("key")) - 1)
    ranked = ranked.withColumn("w", cycle(weights).cast("double")).withColumn("slope", cycle([float(b) for b in slopes]))
    ranked = ranked.withColumn("limit", F.lit(cap) * F.col("source_size")).withColumn("total", F.sum("source_size").over(every))
    by_ratio = every.orderBy(F.col("limit") / F.col("w"), "key")
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("level", (F.lit(share) * F.col("total") - before) / weight_left)
    # The level is right where no source above it is full; of those it is the highest.
    level = F.max(F.when(F.col("w") * F.col("level") <= F.col("limit"), F.col("level"))).over(every)
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("w") * level, F.col("limit").cast("double")))
    return filled.select("key", "source_size", target.alias("target"), "slope")


def assign(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, slopes=SLOPES) -> DataFrame:
    """One row for each of ``docs(doc_id, text, source)``: doc_id, turn, size,
    source_size, target, taken, and positions, one for each time that the
    document is taken (the last time of a source's last document may be in
    part)."""
    rows = materialise(_measured(docs), "mix").withColumn("bin", F.substring("turn", 1, BIN_DIGITS))
    bins = rows.groupBy("key", "bin").agg(F.sum("size").alias("words"))
    sources = source_targets(bins.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, cap, slopes)
    ahead = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.join(sources, "key").withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    inside = Window.partitionBy("key", "bin").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.join(bins, ["key", "bin"]).withColumn(
        "start", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    goal = F.round("target").cast("long")
    part = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), goal - F.lit(k) * F.col("source_size") - F.col("start")))
    laid = laid.withColumn("taken", sum((part(k) for k in range(1, cap)), part(0)).cast("long"))

    def position(k: int) -> Column:
        u = F.least(F.lit(1.0), (F.lit(k) * F.col("source_size") + F.col("start")) / F.col("target"))
        b = F.col("slope")
        return 2 * u / ((1 - b) + F.sqrt((1 - b) * (1 - b) + 4 * b * u))

    times = F.array(*[F.when(part(k) > 0, position(k)) for k in range(cap)])
    return laid.select("doc_id", "turn", "size", "source_size", "target", "taken", F.array_compact(times).alias("positions"))


def by_position(rows: DataFrame, position: str, tie: str = "doc_id") -> DataFrame:
    """Range-sorted; rows of one position, or of none, are told apart by ``tie``."""
    return rows.repartitionByRange(position, tie).sortWithinPartitions(position, tie)


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, in the order of
    training; a partial last time counts as a whole one here.  Documents are
    told apart by id; the rows of one id share one fate."""
    plan = assign(docs, **options)
    id_, at = free_column(docs, "mix_id"), free_column(docs, "mix_position")
    times = plan.groupBy("doc_id").agg(F.max("positions").alias(at)).withColumnRenamed("doc_id", id_)
    taken = docs.join(times, F.col("doc_id").eqNullSafe(F.col(id_))).drop(id_)
    return by_position(taken.withColumn(at, F.explode(at)), at).drop(at)
