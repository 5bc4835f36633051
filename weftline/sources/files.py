"""Reading pages, url lists and JSON; writing results; configuration."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html): a parquet table, else one page for each file."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
    return files.select(F.xxhash64("url").alias("page_id"), "url", "html")


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list, trimmed, without empty ones and those that begin with #."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return lines.where((F.col("url") != "") & ~F.col("url").startswith("#"))


def is_url(source: Column) -> Column:
    return source.startswith("http://") | source.startswith("https://")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def render(rows: DataFrame, format_: str = "json") -> DataFrame:
    """(text): each row as json, yaml, csv or xml; anything else is json."""
    names = rows.columns
    each = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    value = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("null"))
    quoted = lambda n: F.concat(F.lit('"'), F.replace(value(n), F.lit('"'), F.lit('""')), F.lit('"'))
    text = {
        "yaml": F.concat(F.lit("- "), F.concat_ws("\n  ", *[F.concat(F.lit(f"{n}: "), F.to_json(F.array(F.col(n))).substr(F.lit(2), F.char_length(F.to_json(F.array(F.col(n)))) - 2)) for n in names])),
        "csv": F.concat_ws(",", *[quoted(n) for n in names]),
        "xml": F.concat(F.lit("<item>"), *[F.concat(F.lit(f"<{n}>"), escape_xml(value(n)), F.lit(f"</{n}>")) for n in names], F.lit("</item>")),
    }.get(format_, each)
    return rows.select(text.alias("text"))


def escape_xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def write(rows: DataFrame, path: str, format_: str = "json") -> None:
    """To a folder of files; xml has a root around its items, yaml is text."""
    if format_ == "csv":
        rows.write.csv(path, header=True, quoteAll=True)
    elif format_ == "xml":
        rows.write.format("xml").option("rootTag", "results").option("rowTag", "item").save(path)
    elif format_ == "yaml":
        render(rows, "yaml").write.text(path)
    else:
        rows.write.json(path)


def write_batch(rows: DataFrame, path: str) -> dict[str, int]:
    """Results (url, status, error, ...) in a folder by status; their counts."""
    rows.write.partitionBy("status").json(path)
    return {r.status: r["count"] for r in rows.groupBy("status").count().collect()}  # a few states


# Templates ----------------------------------------------------------------

def templates(spark: SparkSession, path: str) -> DataFrame:
    """(name, instruction, schema, description) of a folder of JSON templates."""
    return spark.read.schema("name string, instruction string, schema string, description string").json(path, multiLine=True)


def save_template(spark: SparkSession, path: str, name: str, instruction: str, schema: str | None = None, description: str = "") -> None:
    row = [(name, instruction, schema, description)]
    spark.createDataFrame(row, "name string, instruction string, schema string, description string").write.mode("append").json(path)


# Configuration ------------------------------------------------------------

@dataclass
class Llm:
    provider: str = "anthropic"
    model: str | None = None
    max_tokens: int = 2000
    temperature: float = 0.7
    timeout_s: int = 30


@dataclass
class Chunking:
    strategy: str = "semantic"
    max_tokens: int = 8000
    min_tokens: int = 1000
    overlap: int = 200


@dataclass
class Validation:
    mode: str = "lenient"
    fail_on_error: bool = False


@dataclass
class Cache:
    enabled: bool = True
    kind: str = "memory"
    ttl_s: int = 3600
    max_mb: int = 100


@dataclass
class Limits:
    enabled: bool = True
    rpm: int = 10
    max_concurrent: int = 2


@dataclass
class Config:
    llm: Llm = field(default_factory=Llm)
    chunking: Chunking = field(default_factory=Chunking)
    validation: Validation = field(default_factory=Validation)
    cache: Cache = field(default_factory=Cache)
    limits: Limits = field(default_factory=Limits)

    def to_json(self) -> str:
        return json.dumps(asdict(self))


#: Environment names after the prefix, and where they go.
ENVIRONMENT = {
    "LLM_PROVIDER": "llm.provider", "LLM_MODEL": "llm.model", "LLM_MAX_TOKENS": "llm.max_tokens", "LLM_TEMPERATURE": "llm.temperature", "LLM_TIMEOUT": "llm.timeout_s",
    "CHUNKING_STRATEGY": "chunking.strategy", "CHUNKING_MAX_TOKENS": "chunking.max_tokens", "VALIDATION_MODE": "validation.mode", "CACHE_ENABLED": "cache.enabled",
    "CACHE_TTL": "cache.ttl_s", "RATE_LIMIT_ENABLED": "limits.enabled", "RATE_LIMIT_RPM": "limits.rpm",
}


def _fill(target, values: dict) -> None:
    for f in fields(target):
        if f.name in values:
            now = getattr(target, f.name)
            if is_dataclass(now):
                _fill(now, values[f.name])
            else:
                setattr(target, f.name, values[f.name])


def load_config(text: str | None = None, environment: dict[str, str] | None = None, prefix: str = "WEFTLINE") -> Config:
    """Defaults, then JSON, then the environment; numbers that don't parse are
    ignored."""
    config = Config()
    if text:
        _fill(config, json.loads(text))
    env = os.environ if environment is None else environment
    for name, path in ENVIRONMENT.items():
        value = env.get(f"{prefix}_{name}")
        if value is None:
            continue
        section, key = path.split(".")
        target = getattr(config, section)
        now = getattr(target, key)
        try:
            setattr(target, key, value.lower() == "true" if isinstance(now, bool) else type(now)(value) if now is not None else value)
        except ValueError:
            continue
    return config
