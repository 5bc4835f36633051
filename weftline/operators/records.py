"""Extracted records: merging, deduplication, validation, redaction, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from weftline.functions.text import c

# Patterns of personal data and default thresholds.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "credit_card": r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b", "phone": r"(?:\+[0-9]{1,3} )?\([0-9]{3}\) [0-9]{3}-[0-9]{4}|\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b",
    "passport": r"\b[A-Z][0-9]{8}\b",
}
SAFETY = {"hate": 0.7, "harassment": 0.7, "self_harm": 0.8, "sexual": 0.8, "violence": 0.8}
REDACTED = "[REDACTED]"


def merge_results(parts: list[DataFrame], keys: list[str] | None = None, sort_by: str | None = None, limit: int = 100) -> DataFrame:
    """The parts' rows without repetitions, in order, at most ``limit``."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).dropDuplicates(keys)
    return (rows.orderBy(F.asc_nulls_last(sort_by), *[k for k in rows.columns if k != sort_by]) if sort_by else rows).limit(limit)


def resolve_conflicts(rows: DataFrame, entity: str, field: str, value: str, confidence: str) -> DataFrame:
    """For each (entity, field) the value of the highest confidence, ties to the
    smaller value."""
    order = F.struct((-F.col(confidence)).alias("c"), F.col(value).alias("v"))
    return rows.groupBy(entity, field).agg(F.min_by(value, order).alias(value), F.max(confidence).alias(confidence), F.count("*").alias("candidates"))


def fingerprint(rows: DataFrame, keys: list[str]) -> Column:
    """md5 over key:value of the keys; texts trimmed and in lower case, numbers
    to two places."""
    kinds = dict(rows.dtypes)

    def norm(k: str) -> Column:
        value = F.trim(F.lower(k)) if kinds[k] == "string" else F.format_string("%.2f", F.col(k).cast("double"))
        return F.concat(F.lit(f"{k}:"), F.coalesce(value, F.lit("")))

    return F.md5(F.concat_ws("|", *map(norm, keys)).cast("binary"))


def deduplicate(rows: DataFrame, keys: list[str], first_by: str) -> DataFrame:
    """Of equal fingerprints the row with the smallest ``first_by``."""
    seen = Window.partitionBy("fingerprint").orderBy(first_by)
    return rows.withColumn("fingerprint", fingerprint(rows, keys)).withColumn("_n", F.row_number().over(seen)).where("_n = 1").drop("_n")


def categorize(text: Column | str, rules: list[tuple[str, list[str]]], other: str = "other") -> Column:
    """The first category of which a pattern is contained in the text."""
    low = F.lower(c(text))
    hit = lambda words: reduce(lambda a, b: a | b, [low.contains(w.lower()) for w in words])
    return F.coalesce(*[F.when(hit(words), name) for name, words in rules], F.lit(other))


# Validation ---------------------------------------------------------------

_SIMPLE = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}


def struct_of(schema: dict) -> T.DataType:
    """The type of a JSON schema's values."""
    kind = schema.get("type", "object" if "properties" in schema else "string")
    if kind == "object":
        return T.StructType([T.StructField(k, struct_of(v)) for k, v in schema.get("properties", {}).items()])
    return T.ArrayType(struct_of(schema.get("items", {}))) if kind == "array" else _SIMPLE.get(kind, T.StringType())


def schema_errors(schema: dict, value: Column, path: str = "") -> list[Column]:
    """Columns that are a message where the value breaks the schema, else null:
    required, minimum, maximum, pattern, enum, lengths, nested objects."""
    out: list[Column] = []
    required = set(schema.get("required", []))
    for name, sub in schema.get("properties", {}).items():
        at, own = f"{path}{name}", value.getField(name)
        if name in required and not sub.get("nullable"):
            out.append(F.when(own.isNull(), f"{at}: required"))
        tests = {
            "minimum": lambda x, v: x < v, "maximum": lambda x, v: x > v, "minLength": lambda x, v: F.char_length(x) < v, "maxLength": lambda x, v: F.char_length(x) > v,
            "pattern": lambda x, v: ~x.rlike(v), "enum": lambda x, v: ~x.isin(v), "minItems": lambda x, v: F.size(x) < v, "maxItems": lambda x, v: F.size(x) > v,
        }
        out += [F.when(own.isNotNull() & tests[k](own, sub[k]), f"{at}: {k}") for k in tests if k in sub]
        if sub.get("type") == "object":
            out += schema_errors(sub, own, f"{at}.")
    return out


def validate(rows: DataFrame, rules: dict[str, Column], mode: str = "lenient") -> DataFrame:
    """``rules``: name to a predicate that holds for good rows (null: broken).
    strict marks rows with errors as invalid, lenient keeps them with warnings,
    none checks nothing."""
    if mode == "none":
        return rows.withColumns({"errors": F.expr("cast(array() as array<string>)"), "is_valid": F.lit(True)})
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    out = rows.withColumn("errors", broken)
    return out.withColumn("is_valid", F.size("errors") == 0 if mode == "strict" else F.lit(True))


def outliers(rows: DataFrame, value: str, *keys: str, z: float = 3.0) -> DataFrame:
    """The z score of each value in its group and whether it is an outlier by it
    or by quartiles; the group's statistics are joined, not gathered."""
    stats = rows.groupBy(*keys).agg(
        F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    out = rows.join(stats, list(keys))
    spread = F.col("_q")[1] - F.col("_q")[0]
    score = F.coalesce(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")), F.lit(0.0))
    outside = (F.col(value) < F.col("_q")[0] - 1.5 * spread) | (F.col(value) > F.col("_q")[1] + 1.5 * spread)
    return out.withColumns({"z_score": F.round(score, 6), "z_outlier": F.abs(score) > z, "iqr_outlier": outside}).drop("_m", "_s", "_q")


def frequencies(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n"))


# Redaction and safety -----------------------------------------------------

def redact(text: Column | str, kinds: tuple[str, ...] = tuple(PII), method: str = "replace", token: str = REDACTED) -> Column:
    """``replace`` by the token, ``mask`` by a star, or ``remove``."""
    out = c(text)
    for kind in kinds:
        out = F.regexp_replace(out, PII[kind], {"replace": token, "mask": "*", "remove": ""}[method])
    return out


def pii_counts(text: Column | str) -> Column:
    return F.struct(*[F.regexp_count(c(text), F.lit(p)).cast("long").alias(k) for k, p in PII.items()])


def is_safe(scores: dict[str, Column], limits: dict[str, float] | None = None) -> Column:
    """No score reaches its threshold; a missing score is safe."""
    limits = limits or SAFETY
    return reduce(lambda a, b: a & b, [F.coalesce(scores[k] < v, F.lit(True)) for k, v in limits.items() if k in scores])


# Lookups ------------------------------------------------------------------

def cheapest(rows: DataFrame, name: str, site: str, price: str) -> DataFrame:
    """Names on more than one site with their least price and where it is; ties
    to the smaller site."""
    return rows.groupBy(name).agg(
        F.min(price).alias("best_price"), F.min_by(site, F.struct(price, site)).alias("best_site"), F.count_distinct(site).alias("n_sites")).where("n_sites > 1")


def top_by(rows: DataFrame, value: str, k: int = 3, tie: str | None = None) -> DataFrame:
    """The k smallest, nulls last."""
    return rows.orderBy(F.asc_nulls_last(value), *([tie] if tie else [])).limit(k)


def best_of(rows: DataFrame, group: str, spec: str, item: str) -> DataFrame:
    """By group, the item with the largest number in its specification."""
    number = F.regexp_extract(spec, r"(\d+\.?\d*)", 1).try_cast("double")
    found = rows.withColumn("_v", number).where("_v is not null")
    return found.groupBy(group).agg(F.max("_v").alias("best_value"), F.min_by(item, F.struct(-F.col("_v"), F.col(item))).alias("best_item"))


def cache_lookup(wanted: DataFrame, cache: DataFrame, now: Column, ttl_s: int = 3600, key: str = "key") -> DataFrame:
    """The wanted keys with what the cache holds and whether that is fresh."""
    own = cache.groupBy(key).agg(F.max_by("value", "stored_at").alias("value"), F.max("stored_at").alias("stored_at"))
    fresh = F.coalesce(F.col("stored_at") > now - F.make_dt_interval(secs=F.lit(ttl_s)), F.lit(False))
    return wanted.join(own, key, "left").withColumn("hit", fresh).withColumn("value", F.when(F.col("hit"), F.col("value")))


def cache_key(*parts: Column | str) -> Column:
    return F.md5(F.to_json(F.struct(*[c(p).alias(f"k{i}") for i, p in enumerate(parts)])).cast("binary"))


def feedback_for(pages: DataFrame, feedback: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Feedback of the same host whose words agree with the page's title."""
    words = lambda x: F.array_distinct(F.split(F.lower(F.trim(x)), r"\s+"))
    both = pages.join(feedback, "host")
    a, b = words(F.col("title")), words(F.col("pattern"))
    both = both.withColumn("similarity", F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    return both.where(F.col("similarity") >= threshold)


def cross_field(regular: Column, sale: Column, in_stock: Column, variants: Column) -> dict[str, Column]:
    """Rules between fields: a sale isn't dearer; what is out of stock has no
    variants."""
    return {"sale_not_above_regular": sale.isNull() | regular.isNull() | (sale <= regular), "no_variants_out_of_stock": in_stock | (F.coalesce(F.size(variants), F.lit(0)) == 0)}
