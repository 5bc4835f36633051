"""Queries over texts, requests and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import text as X
from weftline.operators import chunking, prompts, records, usage
from weftline.plans.registry import query, shared_path, table
from weftline.streaming import limits as live

CLASSES = "length(text) AS n, length(text) - length(regexp_replace(text, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '', 'g')) AS w, length(regexp_replace(text, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\p{L}\\p{N}]', '', 'g')) AS s"


@query(f"""
WITH k AS (SELECT doc_id, text, {CLASSES} FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n // 4 + 1 AS chars4, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS bytes4,
  CAST(floor(1.1::DOUBLE * ((n - w - s) // 4 + w + 2 * s)) AS BIGINT) AS anthropic, CAST(floor(1.05::DOUBLE * ((n - w - s) // 4 + w + s)) AS BIGINT) AS openai
FROM k""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", *[fn("text").alias(k) for k, fn in X.TOKEN_COUNTERS.items()])


MODELS = "[('anthropic', 'claude-3-opus'), ('claude', 'claude-3-sonnet'), ('openai', 'gpt-4o'), ('gpt', 'gpt-4-turbo'), ('openai', 'gpt-3.5-turbo'), ('local', 'llama'), ('custom:x', 'm'), ('other', 'm')]"
MODEL_ROWS = [("anthropic", "claude-3-opus"), ("claude", "claude-3-sonnet"), ("openai", "gpt-4o"), ("gpt", "gpt-4-turbo"), ("openai", "gpt-3.5-turbo"), ("local", "llama"), ("custom:x", "m"), ("other", "m")]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as requests: provider and model by conversation."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(m).alias("m")) for p, m in MODEL_ROWS])
    row = F.element_at(pairs, (F.col("conv_id") % len(MODEL_ROWS) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", row["p"].alias("provider"), row["m"].alias("model"))


REQUESTS_SQL = "WITH r AS (SELECT conv_id, turn, text, " + "".join(
    f"CASE conv_id % {len(MODEL_ROWS)} " + " ".join(f"WHEN {k} THEN '{row[j]}'" for k, row in enumerate(MODEL_ROWS)) + f" END AS {name}, " for j, name in enumerate(("provider", "model"))).rstrip(", ") + " FROM conversations)"


@query(REQUESTS_SQL + """,
k AS (SELECT *, CASE WHEN provider IN ('anthropic', 'claude') THEN 'anthropic' WHEN provider IN ('openai', 'gpt') THEN 'openai' WHEN provider = 'local' THEN 'local' WHEN provider LIKE 'custom:%' THEN 'custom' END AS kind,
  CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS pt FROM r WHERE text IS NOT NULL),
p AS (SELECT *, CASE WHEN kind = 'anthropic' THEN CASE WHEN model LIKE '%opus%' THEN 15.0 WHEN model LIKE '%sonnet%' THEN 3.0 WHEN model LIKE '%haiku%' THEN 0.25 ELSE 3.0 END
    WHEN kind = 'openai' THEN CASE WHEN model LIKE '%gpt-4o%' THEN 5.0 WHEN model LIKE '%gpt-4-turbo%' THEN 10.0 ELSE 0.5 END WHEN kind = 'local' THEN 0.0 WHEN kind = 'custom' THEN 10.0 END AS price_in,
  CASE WHEN kind = 'anthropic' THEN CASE WHEN model LIKE '%opus%' THEN 75.0 WHEN model LIKE '%sonnet%' THEN 15.0 WHEN model LIKE '%haiku%' THEN 1.25 ELSE 15.0 END
    WHEN kind = 'openai' THEN CASE WHEN model LIKE '%gpt-4o%' THEN 15.0 WHEN model LIKE '%gpt-4-turbo%' THEN 30.0 ELSE 1.5 END WHEN kind = 'local' THEN 0.0 WHEN kind = 'custom' THEN 30.0 END AS price_out FROM k)
SELECT conv_id, turn, kind, CASE WHEN kind = 'custom' THEN provider ELSE kind END AS provider,
  round((pt * price_in::DOUBLE + 500 * price_out::DOUBLE) / 1000000, 9) AS cost,
  CAST(CASE WHEN kind = 'anthropic' THEN CASE WHEN model LIKE '%claude-3%' THEN 200000 ELSE 100000 END
    WHEN kind = 'openai' THEN CASE WHEN model LIKE '%gpt-4o%' OR model LIKE '%gpt-4-turbo%' THEN 128000 WHEN model LIKE '%gpt-4%' THEN 8192 WHEN model LIKE '%gpt-3.5-turbo%' THEN 16385 ELSE 4096 END END AS INTEGER) AS context_window,
  CASE kind WHEN 'anthropic' THEN 'claude-3-sonnet' WHEN 'openai' THEN 'gpt-4o' WHEN 'local' THEN 'llama-3-8b' ELSE 'default' END AS default_model
FROM p""")
def request_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _requests(spark, sf_dir).where("text is not null").withColumn("pt", X.tokens_bytes4("text"))
    return r.select(
        "conv_id", "turn", usage.provider_kind("provider").alias("kind"), usage.provider("provider").alias("provider"),
        F.round(usage.cost("pt", F.lit(500), "provider", "model"), 9).alias("cost"), usage.context_window("provider", "model").alias("context_window"),
        usage.default_model("provider").alias("default_model"))


@query("""
WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Be brief.' || chr(10) || chr(10) || 'Human: ' || text WHEN 1 THEN 'Be brief.' || chr(10) || chr(10) || 'User: ' || text
    WHEN 2 THEN 'System: be kind' || chr(10) || chr(10) || text ELSE text END AS prompt, text FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Be brief.' WHEN 1 THEN 'Be brief.' WHEN 2 THEN 'be kind' ELSE '' END AS system,
  CASE WHEN turn % 4 = 3 THEN text ELSE trim(text, ' ' || chr(10)) END AS user_text FROM c""")
def parsed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    part = F.col("turn") % 4
    prompt = F.when(part == 0, F.concat(F.lit("Be brief.\n\nHuman: "), "text")).when(part == 1, F.concat(F.lit("Be brief.\n\nUser: "), "text")).when(
        part == 2, F.concat(F.lit("System: be kind\n\n"), "text")).otherwise(F.col("text"))
    both = rows.select("conv_id", "turn", usage.parse_prompt(prompt).alias("p"))
    return both.select("conv_id", "turn", F.col("p.system").alias("system"), F.col("p.user").alias("user_text"))


@query(REQUESTS_SQL + """
SELECT conv_id, turn, model, 2048::BIGINT AS max_tokens, 0.7::DOUBLE AS temperature, text AS content FROM r WHERE model LIKE '%gpt-%' AND text IS NOT NULL""")
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    body = usage.request("openai", "text", F.col("model"), none("double"), none("double"), none("int"), none("array<string>"), none("boolean"))
    rows = _requests(spark, sf_dir).where("text is not null").withColumn("body", body).where("body is not null")
    get = lambda p: F.get_json_object("body", p)
    return rows.select("conv_id", "turn", get("$.model").alias("model"), get("$.max_tokens").cast("long").alias("max_tokens"),
                       get("$.temperature").cast("double").alias("temperature"), get("$.messages[0].content").alias("content"))


GUIDE = "\\n".join(prompts.EXTRACTION_GUIDELINES + prompts.EXTRACTION_MORE["standard"])


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("SELECT item_id, " + " || ".join([
    _sql_text(prompts.SYSTEM_LEAD["claude"] + "Extract.\n\nHTML Content:\n```html\n"), "text", _sql_text("\n```\n\nInstructions:\nFind names\n\nOutput Format:\nExtract the requested information and return it as a valid json object with the following structure:\n" + prompts.EXTRACTION_STRUCTURE["standard"]
    + "\n\nAdditional Guidelines:\n" + "\n".join(prompts.EXTRACTION_GUIDELINES + prompts.EXTRACTION_MORE["standard"]))]) +
    " AS prompt, strlen(text) // 4 + 10 // 4 + 8 // 4 + 200 AS tokens FROM benchmark")
def extraction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        "item_id", prompts.extraction("text", "Find names", system="Extract.").alias("prompt"),
        prompts.extraction_tokens(F.col("text"), "Find names", "Extract.").cast("long").alias("tokens"))


@query()
def navigation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.expr("cast(array() as array<struct<index:int,tag:string,text:string,placeholder:string,id:string,classes:array<string>,visible:boolean,x:double,y:double>>)")
    acts = F.expr("cast(array() as array<struct<action_type:string,target:string,value:string,result:string>>)")
    return table(spark, sf_dir, "pages").select("page_id", prompts.navigation("html", "Find the article", none, acts, url=F.col("url"), progress=F.lit(0.5)).alias("prompt"))


@query()
def analysis_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", prompts.analysis("html", "Describe the page").alias("prompt"))


@query("SELECT page_id, CASE WHEN strlen(html) <= 2000 THEN html END AS whole, strlen(html) > 2000 AS cut FROM pages")
def truncated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = prompts.truncate_html("html", 500)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.when(~short.endswith(prompts.TRUNCATED), short).alias("whole"), short.endswith(prompts.TRUNCATED).alias("cut"))


# Usage --------------------------------------------------------------------

EVENT_REQUESTS = """SELECT event_id, ts, user_id, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'RateLimit' WHEN 1 THEN 'Timeout' ELSE 'Http' END END AS error_code,
  CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(floor(value / 2) AS BIGINT) AS completion_tokens, CAST(floor(value) AS BIGINT) + CAST(floor(value / 2) AS BIGINT) AS total_tokens,
  value / 1000 AS cost, value * 10 AS response_ms, value AS wait_ms FROM events"""


def _event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("weftline_events")
    return spark.sql(EVENT_REQUESTS.replace("FROM events", "FROM weftline_events"))


STATS = """count(*) AS total_requests, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (error_code = 'RateLimit') AS rate_limited,
  count(*) FILTER (error_code = 'Timeout') AS timeouts, CAST(coalesce(sum(prompt_tokens + completion_tokens) FILTER (ok), 0) AS BIGINT) AS total_tokens"""


@query(f"""
WITH r AS ({EVENT_REQUESTS}), s AS (SELECT user_id, {STATS}, round(coalesce(sum(cost) FILTER (ok), 0), 6) AS total_cost, round(coalesce(avg(response_ms) FILTER (ok), 0), 6) AS avg_response_ms FROM r GROUP BY user_id)
SELECT *, round(successful / total_requests, 6) AS success_rate, round(CASE WHEN successful = 0 THEN 0 ELSE total_tokens / successful END, 6) AS avg_tokens FROM s""")
def provider_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.provider_stats(_event_requests(spark, sf_dir), "user_id").drop("avg_cost")
    return out.withColumns({k: F.round(k, 6) for k in ("total_cost", "avg_response_ms", "success_rate", "avg_tokens")})


@query(f"WITH r AS ({EVENT_REQUESTS}) SELECT user_id % 10 AS team, {STATS}, round(coalesce(avg(response_ms) FILTER (ok), 0), 6) AS avg_response_ms FROM r GROUP BY team")
def merged_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = usage.provider_stats(_event_requests(spark, sf_dir), "user_id").withColumn("team", F.col("user_id") % 10)
    return usage.merge_stats(parts, "team").drop("total_cost").withColumn("avg_response_ms", F.round("avg_response_ms", 6))


@query(f"""
WITH r AS ({EVENT_REQUESTS})
SELECT user_id, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (error_code = 'RateLimit') AS throttled,
  round(coalesce(avg(total_tokens) FILTER (ok), 0), 6) AS avg_tokens, round(coalesce(avg(response_ms) FILTER (ok), 0), 6) AS avg_request_ms, round(coalesce(max(response_ms) FILTER (ok), 0), 6) AS max_request_ms,
  round(coalesce(avg(wait_ms) FILTER (ok), 0), 6) AS avg_wait_ms, round(coalesce(max(wait_ms) FILTER (ok), 0), 6) AS max_wait_ms FROM r GROUP BY user_id""")
def usage_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.usage_stats(_event_requests(spark, sf_dir), "user_id")
    return out.withColumns({k: F.round(k, 6) for k in out.columns if k.startswith(("avg", "max"))})


@query("""
WITH e AS (SELECT event_id, event_type, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events),
w AS (SELECT *, count(*) OVER r AS in_window, min(t) OVER r AS oldest FROM e WINDOW r AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))
SELECT event_id, in_window, in_window <= 3 AS allowed, CASE WHEN in_window > 3 THEN round(greatest(0.0::DOUBLE, 3600 - (t - oldest)), 6) ELSE 0.0::DOUBLE END AS wait_s FROM w""")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.sliding_window(table(spark, sf_dir, "events"), "event_type", 3, 3600).select("event_id", "in_window", "allowed", "wait_s")


@query("""
WITH w AS (SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) AS INTEGER) AS n_in_window FROM events)
SELECT event_id, n_in_window, n_in_window <= 2 AS allowed FROM w""")
def fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.fixed_window(table(spark, sf_dir, "events"), "event_type", 2, 3600).select("event_id", "n_in_window", "allowed")


@query("""
WITH w AS (SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INTEGER) AS n_today FROM events)
SELECT event_id, n_today, n_today <= 2 AS allowed FROM w""")
def daily_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.daily_limit(table(spark, sf_dir, "events"), "user_id", 2).select("event_id", "n_today", "allowed")


@query("""
WITH e AS (SELECT event_id, event_type, epoch_us(ts) / 1000000.0::DOUBLE AS t, ts FROM events),
g AS (SELECT event_id, t - lag(t) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM e)
SELECT event_id, round(coalesce(greatest(0.0::DOUBLE, 600.0::DOUBLE - gap), 0.0::DOUBLE), 6) AS wait_s FROM g""")
def spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.spacing(table(spark, sf_dir, "events"), "event_type", 0.1).select("event_id", "wait_s")


@query("""
WITH e AS (SELECT event_type, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, 1 AS step FROM events
  UNION ALL SELECT event_type, NULL, epoch_us(ts) / 1000000.0::DOUBLE + value * 10, -1 FROM events),
r AS (SELECT *, CAST(sum(step) OVER (PARTITION BY event_type ORDER BY t, step, event_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM e)
SELECT event_type, event_id, running, running <= 2 AS allowed FROM r WHERE step = 1""")
def concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.concurrency(table(spark, sf_dir, "events"), "event_type", F.col("value") * 10, 2)


LIMIT_ROWS = [("global", "", 10, 10000, 5), ("provider", "click", 50, None, None), ("model", "user7", 3, 100, 1)]


@query("""
SELECT event_id, CAST(CASE WHEN user_id = 7 THEN 3 WHEN event_type = 'click' THEN 50 ELSE 10 END AS INTEGER) AS rpm, CAST(CASE WHEN user_id = 7 THEN 100 ELSE 10000 END AS INTEGER) AS rpd,
  CAST(CASE WHEN user_id = 7 THEN 1 ELSE 5 END AS INTEGER) AS burst FROM events""")
def effective_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame(LIMIT_ROWS, "scope string, key string, rpm int, rpd int, burst int")
    events = table(spark, sf_dir, "events").withColumns({"provider": F.col("event_type"), "model": F.concat(F.lit("user"), "user_id")})
    return usage.effective_limits(events, limits).select("event_id", "rpm", "rpd", "burst")


@query("SELECT event_id, CAST(k AS INTEGER) AS attempt, least(pow(2.0::DOUBLE, k), 30.0::DOUBLE) AS delay_s FROM events, range(0, 6) t(k) WHERE event_type = 'error'")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    return errors.select("event_id", F.posexplode(usage.retry_schedule(6)).alias("attempt", "delay_s"))


ORDERED = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
"""
BUCKET_SQL = ORDERED + """r AS (
  SELECT user_id, event_id, n, t AS last, 2.0::DOUBLE AS tokens, true AS allowed, 0.0::DOUBLE AS wait_s FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, n, last, CASE WHEN tokens >= 1 THEN tokens - 1 ELSE tokens END, tokens >= 1,
    CASE WHEN tokens >= 1 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 60 / 0.02::DOUBLE - (t - last)) END
  FROM (SELECT e.user_id, e.event_id, e.n, e.t,
      CASE WHEN floor((e.t - r.last) * 0.02::DOUBLE / 60) >= 1 THEN e.t ELSE r.last END AS last,
      CASE WHEN floor((e.t - r.last) * 0.02::DOUBLE / 60) >= 1 THEN least(3.0::DOUBLE, r.tokens + floor((e.t - r.last) * 0.02::DOUBLE / 60)) ELSE r.tokens END AS tokens
    FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
"""


@query(BUCKET_SQL + "SELECT user_id, event_id, allowed, round(wait_s, 6) AS wait_s FROM r")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.simulate(table(spark, sf_dir, "events"), "user_id", "token_bucket", rpm=0.02, burst=3)


@query(ORDERED + """r AS (
  SELECT user_id, event_id, n, 0.0::DOUBLE AS wait_s, t + 60 / 0.02::DOUBLE AS free FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.n, greatest(0.0::DOUBLE, r.free - e.t), e.t + greatest(0.0::DOUBLE, r.free - e.t) + 60 / 0.02::DOUBLE
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, wait_s = 0 AS allowed, round(wait_s, 6) AS wait_s FROM r""")
def leaky_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.simulate(table(spark, sf_dir, "events"), "user_id", "leaky_bucket", rpm=0.02)


@query()
def burst_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.simulate(table(spark, sf_dir, "events"), "event_type", "burst_cooldown", rpm=2, burst=1)


# Streams ------------------------------------------------------------------

def _through(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """The stream's rows after all that is there has been read once."""
    spark = stream.sparkSession
    out = shared_path(spark, label)
    how = "overwrite" if mode == "complete" else "append"
    live.run_once(stream, mode, lambda batch, _: batch.write.mode(how).parquet(out), shared_path(spark, f"{label}-state"))
    return spark.read.schema(stream.schema).parquet(out)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # event time has a zone


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, greatest(0, count(*) - 3) AS over_limit FROM events GROUP BY 1, 2""")
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _through(live.tumbling_quota(_event_stream(spark, sf_dir), "event_type", 3, 3600), "complete", "stream-quota")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"WITH r AS ({EVENT_REQUESTS}) SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT * FROM events) GROUP BY event_type")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _event_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return _through(counts, "complete", "stream-totals")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 2 MINUTE FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _through(live.sessions(_event_stream(spark, sf_dir), "user_id"), "append", "stream-sessions")
    return found.withColumns({k: F.col(k).cast("timestamp_ntz") for k in ("start", "end")})  # those that the watermark has closed


@query(BUCKET_SQL + "SELECT user_id, event_id, allowed FROM r")
def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(live.token_bucket(_event_stream(spark, sf_dir), "user_id", 0.02, 3), "append", "stream-bucket")


@query("SELECT conv_id AS request_id, string_agg(text, '' ORDER BY turn) AS text, 'm' AS model FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def stream_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    message = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.col("text")).alias("delta"), F.lit("m").alias("model")))
    lines = rows.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.concat(F.lit("data: "), message).alias("line"))
    return usage.replies(usage.sse_events(lines)).select("request_id", "text", "model")


# Texts and records --------------------------------------------------------

@query("""
SELECT conv_id, turn, lag(s) OVER w AS preceding_context, lead(s) OVER w AS following_context
FROM (SELECT conv_id, turn, nullif(trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')), '') AS s FROM conversations)
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.with_context(table(spark, sf_dir, "conversations"), "text", "conv_id", "turn", limit=10_000_000)
    return rows.select("conv_id", "turn", "preceding_context", "following_context")


@query("""
SELECT conv_id, turn, 'Source URL: u' || conv_id || chr(10) || chr(10) || 'Location: a > b' || chr(10) || chr(10) || 'Content:' || chr(10) || text || chr(10) || chr(10) AS prompt_text
FROM conversations WHERE text IS NOT NULL""")
def contextual_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    text = chunking.contextual_text(none, F.concat(F.lit("u"), "conv_id"), F.array(F.lit("a"), F.lit("b")), none, F.col("text"), none)
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", text.alias("prompt_text"))


PII_SQL = "text"
for _pattern in records.PII.values():
    PII_SQL = f"regexp_replace({PII_SQL}, '{_pattern}', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, md5({PII_SQL}) AS digest, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS {k}" for k, p in records.PII.items()) + " FROM documents WHERE text IS NOT NULL")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(records.redact("text").cast("binary")).alias("digest"), records.pii_counts("text").alias("k")).select("doc_id", "digest", "k.*")


@query("""
SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host, split_part(url, '?', 1) AS plain,
  trim(regexp_replace(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') AS slug FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", X.host("url").alias("host"), X.without_query("url").alias("plain"), X.slug(title).alias("slug"))


def _lum(r: str) -> str:
    return f"(CASE WHEN {r} / 255.0::DOUBLE <= 0.03928 THEN {r} / 255.0::DOUBLE / 12.92 ELSE pow(({r} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


@query(f"""
WITH e AS (SELECT vec_id, (vec_id * 37) % 256 AS r, (vec_id * 59) % 256 AS g, (vec_id * 83) % 256 AS b FROM embeddings),
l AS (SELECT vec_id, 0.2126 * {_lum('r')} + 0.7152 * {_lum('g')} + 0.0722 * {_lum('b')} AS lum FROM e)
SELECT vec_id, round(lum, 6) AS luminance, round((1.0::DOUBLE + 0.05) / (lum + 0.05), 6) AS contrast FROM l""")
def contrast_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: (F.col("vec_id") * k % 256).cast("string")
    colour = F.concat(F.lit("rgb("), F.concat_ws(", ", part(37), part(59), part(83)), F.lit(")"))
    style = F.concat(F.lit("background-color: white; color: "), colour)
    fg, bg = X.rgb(X.style_value(style, "color")), X.rgb(X.style_value(style, "background-color"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(X.luminance(fg), 6).alias("luminance"), F.round(X.contrast(fg, bg), 6).alias("contrast"))


@query("""
SELECT l_partkey, min(p) AS best_price, arg_min(l_suppkey, struct_pack(a := p, b := l_suppkey)) AS best_site, count(DISTINCT l_suppkey) AS n_sites
FROM (SELECT l_partkey, l_suppkey, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1""")
def cheapest_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    return records.cheapest(rows, "l_partkey", "l_suppkey", "p")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 3")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.top_by(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 3, "o_orderkey")


@query("""
WITH u AS (SELECT DISTINCT p_name, p_brand FROM part WHERE p_size < 20 UNION SELECT DISTINCT p_name, p_brand FROM part WHERE p_size > 10)
SELECT p_name, p_brand FROM u ORDER BY p_name NULLS LAST, p_brand LIMIT 100""")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return records.merge_results([part.where("p_size < 20").select("p_name", "p_brand"), part.where("p_size > 10").select("p_name", "p_brand")], sort_by="p_name")


@query("""
SELECT l_orderkey, l_returnflag, arg_min(l_shipmode, struct_pack(a := -c, b := l_shipmode)) AS l_shipmode, max(c) AS confidence, count(*) AS candidates
FROM (SELECT l_orderkey, l_returnflag, 'line ' || l_linenumber AS l_shipmode, l_discount AS c FROM lineitem) GROUP BY l_orderkey, l_returnflag""")
def resolved_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.concat(F.lit("line "), "l_linenumber").alias("l_shipmode"), F.col("l_discount").alias("confidence"))
    return records.resolve_conflicts(rows, "l_orderkey", "l_returnflag", "l_shipmode", "confidence")


@query("""
WITH f AS (SELECT p_partkey, p_name, md5('p_name:' || trim(lower(p_name)) || '|p_brand:' || trim(lower(p_brand)) || '|p_size:' || printf('%.2f', p_size::DOUBLE)) AS fingerprint FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY p_partkey) AS k FROM f)
SELECT p_partkey, p_name, fingerprint FROM n WHERE k = 1""")
def deduplicated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.deduplicate(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_size"], "p_partkey").select("p_partkey", "p_name", "fingerprint")


RULES = [("fastener", ["bolt", "nut", "screw"]), ("jewel", ["ring"]), ("red", ["red"])]


@query("""
SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%bolt%' OR lower(p_name) LIKE '%nut%' OR lower(p_name) LIKE '%screw%' THEN 'fastener' WHEN lower(p_name) LIKE '%ring%' THEN 'jewel'
  WHEN lower(p_name) LIKE '%red%' THEN 'red' ELSE 'other' END AS category FROM part""")
def categorized_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", records.categorize("p_name", RULES).alias("category"))


@query("""
SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN NOT (l_quantity <= 45) THEN 'quantity' END, CASE WHEN NOT (l_discount <= 0.08) THEN 'discount' END], lambda x: x IS NOT NULL) AS errors,
  l_quantity <= 45 AND l_discount <= 0.08 AS is_valid FROM lineitem""")
def validated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") <= 0.08}
    return records.validate(table(spark, sf_dir, "lineitem"), rules, "strict").select("l_orderkey", "l_linenumber", "errors", "is_valid")


@query("""
WITH s AS (SELECT o_orderpriority, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d, quantile_cont(o_totalprice, [0.25, 0.75]) AS q FROM orders GROUP BY o_orderpriority)
SELECT o_orderkey, round((o_totalprice - m) / d, 6) AS z_score, abs((o_totalprice - m) / d) > 1.5 AS z_outlier,
  o_totalprice < q[1] - 1.5 * (q[2] - q[1]) OR o_totalprice > q[2] + 1.5 * (q[2] - q[1]) AS iqr_outlier FROM orders JOIN s USING (o_orderpriority)""")
def order_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.outliers(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority", z=1.5).select("o_orderkey", "z_score", "z_outlier", "iqr_outlier")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.frequencies(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT event_id, value / 400 < 0.7 AND value / 500 < 0.8 AS safe FROM events")
def safe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", records.is_safe({"hate": F.col("value") / 400, "violence": F.col("value") / 500}).alias("safe"))


@query("""
SELECT p_type, max(p_size::DOUBLE) AS best_value, arg_min(p_partkey, struct_pack(a := -p_size, b := p_partkey)) AS best_item FROM part GROUP BY p_type""")
def largest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("spec", F.concat(F.lit("size "), "p_size", F.lit(" cm")))
    return records.best_of(rows, "p_type", "spec", "p_partkey")


@query("""
WITH c AS (SELECT user_id AS key, arg_max(event_id, ts) AS value, max(ts) AS stored_at FROM events GROUP BY user_id)
SELECT c_custkey AS key, coalesce(stored_at > TIMESTAMP '2024-01-30 12:00:00', false) AS hit, CASE WHEN stored_at > TIMESTAMP '2024-01-30 12:00:00' THEN value END AS value
FROM customer LEFT JOIN c ON key = c_custkey""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), F.col("ts").alias("stored_at"))
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return records.cache_lookup(wanted, cache, F.lit("2024-01-30 13:00:00").cast(cache.schema["stored_at"].dataType)).select("key", "hit", "value")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN round(l_extendedprice * (1 + l_discount - 0.05), 2) <= l_extendedprice THEN [] ELSE ['sale_not_above_regular'] END AS errors FROM lineitem""")
def price_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("sale", F.round(F.col("l_extendedprice") * (1 + F.col("l_discount") - 0.05), 2))
    rules = records.cross_field(F.col("l_extendedprice"), F.col("sale"), F.lit(True), F.expr("cast(array() as array<string>)"))
    return records.validate(rows, rules).select("l_orderkey", "l_linenumber", "errors")
