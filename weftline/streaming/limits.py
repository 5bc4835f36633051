"""Usage and quotas over a stream of requests, and pages as they arrive."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.functions.text import epoch_s
from weftline.operators import usage

WATERMARK = "2 minutes"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_quota(events: DataFrame, key: str, limit: int, seconds: int = 60, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Requests by key and clock-aligned window, and how many are over the
    limit; late rows beyond the watermark are dropped."""
    counts = events.withWatermark(ts, watermark).groupBy(F.window(ts, f"{seconds} seconds"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), key, "n", F.greatest(F.lit(0), F.col("n") - limit).alias("over_limit"))


def sliding_quota(events: DataFrame, key: str, limit: int, seconds: int = 60, slide: int = 10, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Counts by windows that start every ``slide`` seconds only: a breach that
    no such window holds whole isn't flagged.  ``sliding_log`` is exact."""
    counts = events.withWatermark(ts, watermark).groupBy(F.window(ts, f"{seconds} seconds", f"{slide} seconds"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), key, "n", (F.col("n") > limit).alias("exceeded"))


def sliding_log(events: DataFrame, key: str, limit: int, seconds: int = 60, ts: str = "ts", tie: str = "event_id", late_s: int = 120) -> DataFrame:
    """Each request with the number of its key's requests in the ``seconds`` up to
    it (both ends and itself included, as in ``usage.sliding_window``) and whether
    that exceeds the limit.  The state is a key's times of the last ``seconds`` and
    ``late_s`` more, so that a row of a later trigger finds its window whole if it
    is late by no more; rows already written aren't revised."""
    kinds = dict(events.dtypes)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["t", tie], kind="stable")
        times = sorted([*held, *rows["t"].astype("int64").tolist()])
        n = [bisect_right(times, t) - bisect_left(times, t - seconds * 1_000_000) for t in rows["t"]]
        state.update((times[bisect_left(times, times[-1] - (seconds + late_s) * 1_000_000) :],))
        yield pd.DataFrame({key: k[0], tie: rows[tie].values, "in_window": n, "exceeded": [x > limit for x in n]})

    rows = events.where(F.col(ts).isNotNull()).select(key, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {tie} {kinds[tie]}, in_window long, exceeded boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    counts = events.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def running_stats(events: DataFrame, *keys: str) -> DataFrame:
    """For update or complete mode."""
    return usage.usage_stats(events, *keys)


def token_bucket(events: DataFrame, key: str, rpm: float, burst: float, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Each request with whether its key's bucket has a token.  The state is two
    numbers a key; rows of one trigger are taken in order of time."""
    kinds = dict(events.dtypes)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(burst), None)
        rows = pd.concat(list(parts)).sort_values(["t", tie], kind="stable")
        allowed = []
        for t in rows["t"]:
            last = t if last is None else last
            add = int((t - last) * rpm / 60)
            if add >= 1:
                tokens, last = min(float(burst), tokens + add), t
            allowed.append(tokens >= 1)
            tokens -= allowed[-1]
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({key: k[0], tie: rows[tie].values, "allowed": allowed})

    rows = events.select(key, tie, epoch_s(ts).alias("t"))
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {tie} {kinds[tie]}, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that is there now, then stop; a restart goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
