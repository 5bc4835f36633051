"""Models, prices, requests, their statistics and their limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions.text import c, epoch_s

# Prices by a million tokens (in, out), windows and names.
PRICES = (
    ("anthropic", "opus", 15.0, 75.0), ("anthropic", "sonnet", 3.0, 15.0), ("anthropic", "haiku", 0.25, 1.25), ("anthropic", "", 3.0, 15.0),
    ("openai", "gpt-4o", 5.0, 15.0), ("openai", "gpt-4-turbo", 10.0, 30.0), ("openai", "gpt-3.5", 0.5, 1.5), ("openai", "", 0.5, 1.5),
    ("local", "", 0.0, 0.0), ("custom", "", 10.0, 30.0),
)
CONTEXT_WINDOWS = (
    ("anthropic", "claude-3", 200_000), ("anthropic", "", 100_000), ("openai", "gpt-4o", 128_000), ("openai", "gpt-4-turbo", 128_000),
    ("openai", "gpt-4", 8192), ("openai", "gpt-3.5-turbo", 16_385), ("openai", "", 4096),
)
DEFAULT_MODELS = {"anthropic": "claude-3-sonnet", "openai": "gpt-4o", "local": "llama-3-8b"}
RETRYABLE = ("RateLimit", "Timeout", "Http", "Overloaded")


def provider(name: Column | str) -> Column:
    """anthropic, openai, local, custom:<name> or null."""
    low = F.lower(c(name))
    return F.when(low.isin("anthropic", "claude"), "anthropic").when(low.isin("openai", "gpt"), "openai").when(low == "local", "local").when(
        c(name).startswith("custom:"), c(name))


def provider_kind(name: Column | str) -> Column:
    known = provider(name)
    return F.when(known.startswith("custom:"), "custom").otherwise(known)


def _by_model(rows, provider_: Column, model: Column, value) -> Column:
    """The value of the first row whose provider is equal and whose name the
    model contains."""
    out = None
    for row in rows:
        hit = (provider_ == row[0]) & model.contains(row[1])
        out = F.when(hit, value(row)) if out is None else out.when(hit, value(row))
    return out


def cost(prompt_tokens: Column | str, completion_tokens: Column | str, provider_: Column | str, model: Column | str) -> Column:
    """Dollars; null for an unknown provider."""
    kind, name = provider_kind(provider_), F.coalesce(F.lower(c(model)), F.lit(""))
    price = lambda k: _by_model(PRICES, kind, name, lambda row: F.lit(row[k]))
    return (c(prompt_tokens) * price(2) + c(completion_tokens) * price(3)) / 1_000_000


def context_window(provider_: Column | str, model: Column | str) -> Column:
    return _by_model(CONTEXT_WINDOWS, provider_kind(provider_), F.coalesce(F.lower(c(model)), F.lit("")), lambda row: F.lit(row[2]))


def default_model(provider_: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in DEFAULT_MODELS.items() for x in kv])
    return F.coalesce(F.element_at(known, provider_kind(provider_)), F.lit("default"))


def parse_prompt(prompt: Column | str) -> Column:
    """struct(system, user): split at the first human or user turn, else after a
    leading system line, else all is the user's."""
    text = c(prompt)
    out = None
    for mark in ("\n\nHuman:", "\n\nUser:"):
        at = F.instr(text, mark)
        pair = F.struct(F.btrim(F.substring(text, F.lit(1), at - 1), F.lit(" \n")).alias("system"),
                        F.btrim(F.substring(text, at + len(mark), F.char_length(text)), F.lit(" \n")).alias("user"))
        out = F.when(at > 0, pair) if out is None else out.when(at > 0, pair)
    at = F.instr(text, "\n\n")
    led = F.struct(F.btrim(F.substring(text, F.lit(8), at - 8), F.lit(" \n")).alias("system"),
                   F.btrim(F.substring(text, at + 2, F.char_length(text)), F.lit(" \n")).alias("user"))
    plain = F.struct(F.lit("").alias("system"), text.alias("user"))
    return out.when(text.startswith("System:") & (at > 0), led).otherwise(plain)


def request(kind: str, prompt: Column | str, model: Column, temperature: Column, top_p: Column, max_tokens: Column, stop: Column, stream: Column) -> Column:
    """The request's body as JSON; null where the model isn't the provider's."""
    parts = parse_prompt(prompt)
    least, family, stops = (4096, "claude", "stop_sequences") if kind == "anthropic" else (2048, "gpt-", "stop")
    name = F.coalesce(model, F.lit(DEFAULT_MODELS[kind]))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    user = F.array(message("user", parts["user"]))
    both = user if kind == "anthropic" else F.when(parts["system"] == "", user).otherwise(F.array(message("system", parts["system"]), message("user", parts["user"])))
    fields = [
        name.alias("model"), F.coalesce(max_tokens, F.lit(least)).alias("max_tokens"), F.coalesce(temperature, F.lit(0.7)).alias("temperature"),
        F.coalesce(top_p, F.lit(1.0)).alias("top_p"), both.alias("messages"), stop.alias(stops), stream.alias("stream")]
    if kind == "anthropic":
        fields.append(F.when(parts["system"] != "", parts["system"]).alias("system"))
    return F.when(name.contains(family), F.to_json(F.struct(*fields)))


def with_defaults(options: dict[str, Column], defaults: dict[str, Column]) -> dict[str, Column]:
    """Each option, else its default; provider, model and extra stay as given."""
    return {k: v if k in ("provider", "model", "extra") else F.coalesce(v, defaults[k]) if k in defaults else v for k, v in options.items()}


# Statistics ---------------------------------------------------------------

def provider_stats(requests: DataFrame, *keys: str) -> DataFrame:
    """Counters of requests (ok, error_code, prompt_tokens, completion_tokens,
    cost, response_ms) by ``keys``, with ratios that are 0 where undefined."""
    ok, code = F.col("ok"), F.coalesce(F.col("error_code"), F.lit(""))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    out = requests.groupBy(*keys).agg(
        F.count("*").alias("total_requests"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.count_if(~ok & (code == "RateLimit")).alias("rate_limited"), F.count_if(~ok & (code == "Timeout")).alias("timeouts"),
        F.coalesce(F.sum(F.when(ok, F.col("prompt_tokens") + F.col("completion_tokens"))), F.lit(0)).cast("long").alias("total_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("cost"))), F.lit(0.0)).alias("total_cost"), F.avg(F.when(ok, F.col("response_ms"))).alias("avg_response_ms"))
    return out.withColumns({
        "avg_response_ms": F.coalesce("avg_response_ms", F.lit(0.0)), "success_rate": ratio("successful", "total_requests"),
        "avg_tokens": ratio("total_tokens", "successful"), "avg_cost": ratio("total_cost", "successful")})


def merge_stats(parts: DataFrame, *keys: str) -> DataFrame:
    """Statistics of parts as those of the whole; means weighed by successes."""
    sums = ["total_requests", "successful", "failed", "rate_limited", "timeouts", "total_tokens", "total_cost"]
    mean = F.coalesce(F.try_divide(F.sum(F.col("avg_response_ms") * F.col("successful")), F.sum("successful")), F.lit(0.0))
    return parts.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums], mean.alias("avg_response_ms"))


def usage_stats(requests: DataFrame, *keys: str) -> DataFrame:
    """Means and maxima of successes; failed and throttled ones are counted."""
    ok = F.col("ok")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    won = lambda name: F.when(ok, F.col(name).cast("double"))
    return requests.groupBy(*keys).agg(
        F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.count_if(F.col("error_code") == "RateLimit").alias("throttled"),
        zero(F.avg(won("total_tokens"))).alias("avg_tokens"), zero(F.avg(won("response_ms"))).alias("avg_request_ms"),
        zero(F.max(won("response_ms"))).alias("max_request_ms"), zero(F.avg(won("wait_ms"))).alias("avg_wait_ms"), zero(F.max(won("wait_ms"))).alias("max_wait_ms"))


# Limits -------------------------------------------------------------------

def effective_limits(requests: DataFrame, limits: DataFrame, fields: tuple[str, ...] = ("rpm", "rpd", "burst")) -> DataFrame:
    """The requests with the limits of their model, else of their provider, else
    the global ones (limits: scope, key and the fields)."""
    out = requests
    for scope, key in (("model", "model"), ("provider", "provider")):
        own = limits.where(F.col("scope") == scope).select(F.col("key").alias(key), *[F.col(f).alias(f"{scope}_{f}") for f in fields])
        out = out.join(own, key, "left")
    every = limits.where("scope = 'global'").select(*fields).first()  # one row of configuration
    kinds = dict(limits.dtypes)
    found = {f: F.coalesce(f"model_{f}", f"provider_{f}", F.lit(every[f] if every else None).cast(kinds[f])) for f in fields}
    return out.withColumns(found).drop(*[f"{s}_{f}" for s in ("model", "provider") for f in fields])


def sliding_window(events: DataFrame, key: str, limit: int, seconds: int = 60, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """With the requests of the trailing window before each, and how long it
    would wait."""
    before = epoch_s(ts)
    row = Window.partitionBy(key).orderBy(before).rangeBetween(-seconds, Window.currentRow)
    out = events.withColumns({"in_window": F.count("*").over(row), "_oldest": F.min(before).over(row)})
    over = F.col("in_window") > limit
    wait = F.when(over, F.round(F.greatest(F.lit(0.0), F.lit(float(seconds)) - (before - F.col("_oldest"))), 6)).otherwise(0.0)
    return out.withColumns({"allowed": ~over, "wait_s": wait}).drop("_oldest")


def fixed_window(events: DataFrame, key: str, limit: int, seconds: int = 60, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """By clock-aligned windows: the place of each request and whether it fits."""
    start = F.window(ts, f"{seconds} seconds")["start"]
    row = Window.partitionBy(key, "window_start").orderBy(ts, tie)
    return events.withColumn("window_start", start).withColumn("n_in_window", F.row_number().over(row)).withColumn("allowed", F.col("n_in_window") <= limit)


def daily_limit(events: DataFrame, key: str, limit: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    row = Window.partitionBy(key, "day").orderBy(ts, tie)
    return events.withColumn("day", F.to_date(ts)).withColumn("n_today", F.row_number().over(row)).withColumn("allowed", F.col("n_today") <= limit)


def spacing(events: DataFrame, key: str, rpm: float, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The leaky bucket by arrivals: how long each waits for its distance to the
    one before."""
    gap = epoch_s(ts) - F.lag(epoch_s(ts)).over(Window.partitionBy(key).orderBy(ts, tie))
    return events.withColumn("wait_s", F.round(F.coalesce(F.greatest(F.lit(0.0), F.lit(60.0 / rpm) - gap), F.lit(0.0)), 6))


def concurrency(events: DataFrame, key: str, seconds: Column | str, limit: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """How many requests of the key run when each starts, itself included."""
    start = events.select(key, tie, epoch_s(ts).alias("t"), F.lit(1).alias("step"))
    end = events.select(key, F.lit(None).cast(dict(events.dtypes)[tie]).alias(tie), (epoch_s(ts) + c(seconds)).alias("t"), F.lit(-1).alias("step"))
    row = Window.partitionBy(key).orderBy("t", "step", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = start.unionByName(end).withColumn("running", F.sum("step").over(row)).where("step = 1")
    return running.select(key, tie, "running", (F.col("running") <= limit).alias("allowed"))


def retry_schedule(max_retries: int = 3, base_s: float = 1.0, most_s: float = 30.0) -> Column:
    """An array of the waits before each retry, without jitter."""
    return F.transform(F.sequence(F.lit(0), F.lit(max_retries - 1)), lambda k: F.least(base_s * F.pow(F.lit(2.0), k), F.lit(most_s)))


def is_retryable(code: Column | str) -> Column:
    return c(code).isin(*RETRYABLE)


def permit(wait_s: Column | str, timeout_s: float = 60.0) -> Column:
    return c(wait_s) <= timeout_s


def _token_bucket(times: list[float], rpm: float, burst: float) -> Iterator[tuple[bool, float]]:
    tokens, last = float(burst), None
    for t in times:
        if last is None:
            last = t
        add = int((t - last) * rpm / 60)
        if add >= 1:
            tokens, last = min(float(burst), tokens + add), t
        ok = tokens >= 1
        wait = 0.0 if ok else max(0.0, 60 / rpm - (t - last))
        tokens -= ok
        yield ok, wait


def _fixed_from_first(times: list[float], rpm: float, burst: float) -> Iterator[tuple[bool, float]]:
    start, n = None, 0
    for t in times:
        if start is None or t - start >= 60:
            start, n = t, 0
        n += 1
        yield n <= rpm, 0.0 if n <= rpm else 60 - (t - start)


def _leaky(times: list[float], rpm: float, burst: float) -> Iterator[tuple[bool, float]]:
    free = None
    for t in times:
        wait = 0.0 if free is None else max(0.0, free - t)
        free = t + wait + 60 / rpm
        yield wait == 0, wait


def _burst_cooldown(times: list[float], rpm: float, burst: float) -> Iterator[tuple[bool, float]]:
    """At most rpm in the last minute; a burst beyond it after a minute of rest."""
    seen: list[float] = []
    for t in times:
        seen = [s for s in seen if t - s < 60]
        rested = not seen
        room = rpm + burst if rested or len(seen) < rpm else rpm
        ok = len(seen) < room
        wait = 0.0 if ok else 60 - (t - seen[0])
        if ok:
            seen.append(t)
        yield ok, wait


SIMULATIONS = {"token_bucket": _token_bucket, "fixed_window": _fixed_from_first, "leaky_bucket": _leaky, "burst_cooldown": _burst_cooldown}


def simulate(events: DataFrame, key: str, algorithm: str, rpm: float = 10, burst: float = 5, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """(key, tie, allowed, wait_s) of a limiter whose state depends on what it
    granted before: a fold over each key's requests in order."""
    fold = SIMULATIONS[algorithm]
    kinds = dict(events.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["t", tie], kind="stable")
        got = list(fold(group["t"].tolist(), rpm, burst))
        return pd.DataFrame({key: group[key].values, tie: group[tie].values, "allowed": [g[0] for g in got], "wait_s": [round(g[1], 6) for g in got]})

    rows = events.select(key, tie, epoch_s(ts).alias("t"))
    return rows.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, allowed boolean, wait_s double")


# Streams of replies -------------------------------------------------------

def sse_events(lines: DataFrame, kind: str = "anthropic") -> DataFrame:
    """(request_id, seq, event, text, model, prompt_tokens, completion_tokens,
    error) of lines (request_id, seq, line); repeated lines count once."""
    data = F.regexp_extract("line", r"^data: (.*)$", 1)
    rows = lines.dropDuplicates(["request_id", "seq"]).withColumn("data", data).where("data <> '' and data <> '[DONE]'")
    get = lambda *paths: F.coalesce(*[F.get_json_object("data", p) for p in paths])
    rows = rows.withColumn("bad", F.expr("try_parse_json(data) is null"))
    if kind == "openai":
        return rows.where("not bad").select(
            "request_id", "seq", F.lit("delta").alias("event"), get("$.choices[0].delta.content").alias("text"), get("$.model").alias("model"),
            F.lit(None).cast("long").alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"),
            get("$.choices[0].finish_reason").alias("finish_reason"), F.lit(None).cast("string").alias("error"))
    return rows.select(
        "request_id", "seq", get("$.type").alias("event"), F.when(get("$.type") == "content_block_delta", get("$.delta.text")).alias("text"),
        get("$.message.model", "$.model").alias("model"), get("$.usage.input_tokens", "$.message.usage.input_tokens").try_cast("long").alias("prompt_tokens"),
        get("$.usage.output_tokens").try_cast("long").alias("completion_tokens"), get("$.delta.stop_reason").alias("finish_reason"),
        F.when(F.col("bad"), "malformed line").alias("error"))


def replies(events: DataFrame) -> DataFrame:
    """One row a request: its text in order, model and usage."""
    return events.groupBy("request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seq", "text")))), lambda s: s["text"]), "").alias("text"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("seq"))).alias("model"), F.max("prompt_tokens").alias("prompt_tokens"),
        F.max("completion_tokens").alias("completion_tokens"), F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason"),
        F.max("error").alias("error"))
