"""Running a Python function on each page, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: A source below this many bytes may be one partition of one small file.
SMALL_SOURCE = 32 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A small source dealt out to all cores before Python reads it; a large one
    has partitions enough and isn't shuffled."""
    if rows.isStreaming or int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL_SOURCE:
        return rows
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def per_page(pages: DataFrame, fn: Callable[[str], Iterable[dict]], fields: str, column: str = "html", key: str = "page_id") -> DataFrame:
    """``key`` and the columns ``fields`` of each dict that ``fn`` makes of a
    page's ``column`` (null: the empty string).  A narrow operation but for small
    sources."""
    kind = dict(pages.dtypes)[key]
    schema = T.StructType.fromDDL(f"{key} {kind}, {fields}")
    names = schema.fieldNames()[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            out: list[dict] = []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in fn(value.as_py() or ""):
                    out.append({key: k} | {n: row[n] for n in names})
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return spread(pages.select(key, F.col(column).cast("string").alias(column))).mapInArrow(run, schema)
