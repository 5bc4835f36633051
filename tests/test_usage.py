import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import records, usage
from weftline.sources import files
from weftline.streaming import limits as live

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, k string, value double"


def events(spark, seconds, key="a"):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), key, 1.0) for i, s in enumerate(seconds)], EVENTS)


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())


def test_models(spark):
    names = ["anthropic", "Claude", "openai", "gpt", "local", "custom:test", "unknown"]
    got = [r.p for r in spark.createDataFrame([(n,) for n in names], "n string").select(usage.provider("n").alias("p")).collect()]
    assert got == ["anthropic", "anthropic", "openai", "openai", "local", "custom:test", None]
    cost = lambda p, m: one(spark, usage.cost(F.lit(1000), F.lit(500), F.lit(p), F.lit(m)))[0]
    assert [round(cost(*x), 6) for x in (("anthropic", "claude-3-sonnet"), ("openai", "gpt-4o"), ("local", "x"), ("custom:z", "x"))] == [0.0105, 0.0125, 0.0, 0.025]
    assert cost("nobody", "x") is None
    window = lambda p, m: one(spark, usage.context_window(F.lit(p), F.lit(m)))[0]
    assert [window("anthropic", "claude-3-opus"), window("anthropic", "claude-2"), window("openai", "gpt-4"), window("openai", "gpt-3.5-turbo"), window("local", "x")] == [200_000, 100_000, 8192, 16_385, None]
    assert one(spark, usage.default_model(F.lit("gpt")), usage.default_model(F.lit("x"))) == ("gpt-4o", "default")


def test_requests(spark):
    lead, ask = "You are an AI assistant. Be concise and helpful.", "What is the capital of France?"
    split = lambda p: tuple(one(spark, usage.parse_prompt(F.lit(p)))[0])
    assert split(f"{lead}\n\nHuman: {ask}") == split(f"{lead}\n\nUser: {ask}") == split(f"System: {lead}\n\n{ask}") == (lead, ask)
    assert split(ask) == ("", ask)
    none = lambda kind: F.lit(None).cast(kind)
    plain = [none("double"), none("double"), none("int"), none("array<string>"), none("boolean")]
    a = json.loads(one(spark, usage.request("anthropic", F.lit(ask), F.lit("claude-3-sonnet"), *plain))[0])
    assert a["max_tokens"] == 4096 and a["temperature"] == 0.7 and a["messages"] == [{"role": "user", "content": ask}] and "stop_sequences" not in a
    b = json.loads(one(spark, usage.request("openai", F.lit(f"{lead}\n\nUser: {ask}"), F.lit("gpt-4o"), F.lit(0.2), F.lit(0.9), F.lit(1000), F.array(F.lit("STOP")), F.lit(True)))[0])
    assert b["max_tokens"] == 1000 and b["stop"] == ["STOP"] and b["stream"] and [m["role"] for m in b["messages"]] == ["system", "user"]
    assert one(spark, usage.request("openai", F.lit(ask), F.lit("claude-3"), *plain))[0] is None
    merged = usage.with_defaults({"t": F.lit(None).cast("double"), "model": F.lit(None).cast("string")}, {"t": F.lit(0.7), "model": F.lit("m")})
    assert one(spark, merged["t"], merged["model"]) == (0.7, None)


def test_statistics(spark):
    rows = [("p", True, None, 100, 50, 0.02, 1500.0, 10.0), ("p", False, "Timeout", 0, 0, 0.0, 0.0, 0.0), ("p", True, None, 200, 100, 0.04, 2500.0, 30.0), ("q", False, "RateLimit", 0, 0, 0.0, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "k string, ok boolean, error_code string, prompt_tokens long, completion_tokens long, cost double, response_ms double, wait_ms double")
    by = {r.k: r for r in usage.provider_stats(frame, "k").collect()}
    p = by["p"]
    assert (p.total_requests, p.successful, p.failed, p.timeouts, p.total_tokens, round(p.total_cost, 6), p.avg_response_ms, round(p.success_rate, 6), p.avg_tokens, round(p.avg_cost, 6)) == (
        3, 2, 1, 1, 450, 0.06, 2000.0, 0.666667, 225.0, 0.03)
    assert by["q"].success_rate == 0 and by["q"].avg_tokens == 0 and by["q"].rate_limited == 1
    whole = usage.merge_stats(usage.provider_stats(frame.withColumn("part", F.col("prompt_tokens")), "k", "part"), "k").where("k = 'p'").first()
    assert (whole.total_requests, whole.avg_response_ms) == (3, 2000.0)
    u = usage.usage_stats(frame.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")), "k").where("k = 'p'").first()
    assert (u.avg_tokens, u.max_request_ms, u.avg_wait_ms, u.failed) == (225.0, 2500.0, 20.0, 1)


def test_limits(spark):
    e = events(spark, [0, 1, 2, 59.9, 60.1, 61.5])
    rows = {r.event_id: (r.in_window, r.allowed, r.wait_s) for r in usage.sliding_window(e, "k", 3).collect()}
    assert rows[2] == (3, True, 0.0) and rows[3] == (4, False, 0.1) and rows[4][0] == 4 and rows[5][0] == 4
    assert [r.allowed for r in usage.fixed_window(e, "k", 2).orderBy("event_id").collect()] == [True, True, False, False, True, True]
    assert [r.n_today for r in usage.daily_limit(e, "k", 2).orderBy("event_id").collect()] == [1, 2, 3, 4, 5, 6]
    assert [r.wait_s for r in usage.spacing(e, "k", 60).orderBy("event_id").collect()] == [0.0, 0.0, 0.0, 0.0, 0.8, 0.0]
    assert [r.running for r in usage.concurrency(e, "k", F.lit(1.5), 1).orderBy("event_id").collect()] == [1, 2, 2, 1, 2, 2]
    assert one(spark, usage.retry_schedule(6))[0] == [1.0, 2.0, 4.0, 8.0, 16.0, 30.0]
    assert one(spark, usage.is_retryable(F.lit("Timeout")), usage.is_retryable(F.lit("Auth")), usage.permit(F.lit(61.0))) == (True, False, False)


def test_simulations(spark):
    allowed = lambda name, seconds, **o: [r.allowed for r in usage.simulate(events(spark, seconds), "k", name, **o).orderBy("event_id").collect()]
    assert allowed("token_bucket", [0, 0, 0, 30, 60], rpm=2, burst=2) == [True, True, False, True, True]
    assert allowed("fixed_window", [5, 10, 20, 64, 66], rpm=2) == [True, True, False, False, True]
    assert allowed("burst_cooldown", [0, 1, 2, 3, 70], rpm=1, burst=1) == [True, False, False, False, True]
    waits = [r.wait_s for r in usage.simulate(events(spark, [0, 1, 2]), "k", "leaky_bucket", rpm=30).orderBy("event_id").collect()]
    assert waits == [0.0, 1.0, 2.0]


def test_effective_limits(spark):
    limits = spark.createDataFrame([("global", "", 10, 100, 5), ("provider", "p", 20, None, None), ("model", "m", 1, None, 2)], "scope string, key string, rpm int, rpd int, burst int")
    rows = spark.createDataFrame([(1, "p", "m"), (2, "p", "x"), (3, "q", "x")], "id int, provider string, model string")
    got = {r.id: (r.rpm, r.rpd, r.burst) for r in usage.effective_limits(rows, limits).collect()}
    assert got == {1: (1, 100, 2), 2: (20, 100, 5), 3: (10, 100, 5)}


def test_replies(spark):
    d = lambda x: "data: " + json.dumps(x)
    lines = [(1, 0, d({"type": "message_start", "message": {"model": "m", "usage": {"input_tokens": 3}}})), (1, 2, d({"type": "content_block_delta", "delta": {"text": "b"}})),
             (1, 1, d({"type": "content_block_delta", "delta": {"text": "a"}})), (1, 1, d({"type": "content_block_delta", "delta": {"text": "a"}})),
             (1, 3, d({"type": "message_delta", "usage": {"output_tokens": 7}, "delta": {"stop_reason": "end"}})), (1, 4, "data: [DONE]"), (2, 0, "data: {oops")]
    got = {r.request_id: r for r in usage.replies(usage.sse_events(spark.createDataFrame(lines, "request_id long, seq long, line string"))).collect()}
    assert (got[1].text, got[1].model, got[1].prompt_tokens, got[1].completion_tokens, got[1].finish_reason, got[1].error) == ("ab", "m", 3, 7, "end", None)
    assert got[2].error == "malformed line"
    chat = [(1, 0, d({"choices": [{"delta": {"content": "x"}}]})), (1, 1, "data: {oops"), (1, 2, d({"choices": [{"delta": {"content": "y"}, "finish_reason": "stop"}]}))]
    r = usage.replies(usage.sse_events(spark.createDataFrame(chat, "request_id long, seq long, line string"), "openai")).first()
    assert (r.text, r.finish_reason, r.error) == ("xy", "stop", None)


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        events(spark, [k * 40, k * 40 + 1, k * 40 + 2]).withColumn("event_id", F.col("event_id") + 3 * k).coalesce(1).write.mode("append").parquet(source)
    read = lambda: live.read_stream(spark, source, EVENTS)
    out = str(tmp_path / "quota")
    live.run_once(live.tumbling_quota(read(), "k", 2), "complete", lambda b, _: b.write.mode("overwrite").parquet(out), str(tmp_path / "c1"))
    assert sorted((r.window_start.minute, r.n, r.over_limit) for r in spark.read.parquet(out).collect()) == [(0, 6, 4), (1, 3, 1)]
    out2 = str(tmp_path / "bucket")
    live.run_once(live.token_bucket(read(), "k", rpm=60, burst=2), "append", lambda b, _: b.write.mode("append").parquet(out2), str(tmp_path / "c2"))
    batch = usage.simulate(spark.read.parquet(source), "k", "token_bucket", rpm=60, burst=2)
    assert spark.read.parquet(out2).count() == 9
    if sorted(r.event_id for r in batch.collect()) == list(range(9)):
        assert sum(r.allowed for r in spark.read.parquet(out2).collect()) >= 6
    out3 = str(tmp_path / "slide")
    live.run_once(live.sliding_quota(read(), "k", 2), "complete", lambda b, _: b.write.mode("overwrite").parquet(out3), str(tmp_path / "c3"))
    assert max(r.n for r in spark.read.parquet(out3).collect()) == 6


def test_sliding_log_is_exact(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = events(spark, [5, 34, 64, 65, 100, 200])
    for k in range(0, 6, 2):  # a trigger for each two rows
        rows.where(F.col("event_id").between(k, k + 1)).coalesce(1).write.mode("append").parquet(source)
    stream = live.read_stream(spark, source, EVENTS)
    live.run_once(live.sliding_log(stream, "k", 2), "append", lambda b, _: b.write.mode("append").parquet(out), str(tmp_path / "c"))
    got = {r.event_id: (r.in_window, r.exceeded) for r in spark.read.parquet(out).collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (3, True), 3: (4, True), 4: (3, True), 5: (1, False)}
    batch = live.usage.sliding_window(spark.read.parquet(source), "k", 2).collect()
    assert got == {r.event_id: (r.in_window, not r.allowed) for r in batch}


def test_records(spark):
    rows = spark.createDataFrame([(1, "A b", 1.0), (2, "a B ", 1.004), (3, "c", None)], "id long, name string, price double")
    assert [r.id for r in records.deduplicate(rows, ["name", "price"], "id").orderBy("id").collect()] == [1, 3]
    many = records.merge_results([rows, rows.limit(1)], sort_by="price", limit=2).collect()
    assert [r.id for r in many] == [1, 2]
    votes = spark.createDataFrame([("e", "f", "x", 0.5), ("e", "f", "y", 0.9), ("e", "f", "z", 0.9)], "e string, f string, v string, c double")
    best = records.resolve_conflicts(votes, "e", "f", "v", "c").first()
    assert (best.v, best.c, best.candidates) == ("y", 0.9, 3)
    cat = rows.select(records.categorize("name", [("one", ["a"]), ("two", ["c"])]).alias("c")).collect()
    assert [r.c for r in cat] == ["one", "one", "two"]
    checked = records.validate(rows, {"priced": F.col("price").isNotNull(), "low": F.col("price") < 2}, "strict").orderBy("id").collect()
    assert [(r.errors, r.is_valid) for r in checked] == [([], True), ([], True), (["priced", "low"], False)]
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}, "t": {"type": "string", "pattern": "^a"}, "o": {"type": "object", "required": ["z"], "properties": {"z": {"type": "string"}}}}}
    parsed = spark.createDataFrame([('{"n": 0, "t": "b", "o": {}}',), ('{"n": 2, "t": "ab", "o": {"z": "q"}}',), ("{}",)], "j string").select(F.from_json("j", records.struct_of(schema)).alias("v"))
    errors = parsed.select(F.array_compact(F.array(*records.schema_errors(schema, F.col("v")))).alias("e")).collect()
    assert [r.e for r in errors][:2] == [["n: minimum", "t: pattern", "o.z: required"], []] and "n: required" in errors[2].e
    text = "mail a.b@c.org or (555) 123-4567, 123-45-6789 and 4111 1111 1111 1111"
    got = one(spark, records.redact(F.lit(text)), records.redact(F.lit(text), ("email",), "mask"), records.pii_counts(F.lit(text)))
    assert got[0] == "mail [REDACTED] or [REDACTED], [REDACTED] and [REDACTED]" and got[1].startswith("mail * or") and (got[2].email, got[2].phone, got[2].ssn, got[2].credit_card) == (1, 1, 1, 1)
    assert one(spark, records.is_safe({"hate": F.lit(0.69), "violence": F.lit(None).cast("double")}), records.is_safe({"sexual": F.lit(0.8)})) == (True, False)
    shop = spark.createDataFrame([("n", "s1", 3.0), ("n", "s2", 2.0), ("m", "s1", 1.0)], "name string, site string, price double")
    assert [tuple(r) for r in records.cheapest(shop, "name", "site", "price").collect()] == [("n", 2.0, "s2", 2)]
    spec = spark.createDataFrame([("g", "12.5 h", "a"), ("g", "about 9", "b"), ("g", "none", "c")], "g string, s string, i string")
    assert tuple(records.best_of(spec, "g", "s", "i").first()) == ("g", 12.5, "a")
    values = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 2, 1, 2, 3, 50]], "g string, v double")
    assert [r.v for r in records.outliers(values, "v", "g", z=2.0).where("z_outlier and iqr_outlier").collect()] == [50.0]
    now = F.lit(T0)
    cache = spark.createDataFrame([("a", 1, T0 - dt.timedelta(minutes=5)), ("b", 2, T0 - dt.timedelta(hours=2))], "key string, value int, stored_at timestamp")
    hits = {r.key: (r.hit, r.value) for r in records.cache_lookup(spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), cache, now).collect()}
    assert hits == {"a": (True, 1), "b": (False, None), "c": (False, None)}
    pages = spark.createDataFrame([("h", "Big red shoe"), ("g", "x")], "host string, title string")
    notes = spark.createDataFrame([("h", "red big shoe", "n1"), ("h", "blue hat", "n2")], "host string, pattern string, note string")
    assert [r.note for r in records.feedback_for(pages, notes).collect()] == ["n1"]


def test_sources(spark, tmp_path):
    (tmp_path / "urls.txt").write_text(" http://a \n\n# no\nb.html\n")
    urls = files.read_urls(spark, str(tmp_path / "urls.txt")).select("url", files.is_url(F.col("url")).alias("w")).collect()
    assert [(r.url, r.w) for r in urls] == [("http://a", True), ("b.html", False)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.html").write_text("<p>1\n<p>2")
    assert files.read_pages(spark, str(tmp_path / "p")).first().html == "<p>1\n<p>2"
    rows = spark.createDataFrame([(1, 'a"<b')], "i int, s string")
    texts = {f: files.render(rows, f).first().text for f in ("json", "csv", "xml", "yaml", "other")}
    assert json.loads(texts["json"]) == {"i": 1, "s": 'a"<b'} and texts["other"] == texts["json"] and texts["csv"] == '"1","a""<b"'
    assert texts["xml"] == '<item><i>1</i><s>a"&lt;b</s></item>' and texts["yaml"] == '- i: 1\n  s: "a\\"<b"'
    for f in ("json", "csv", "xml", "yaml"):
        files.write(rows, str(tmp_path / f"out_{f}"), f)
    assert files.read_json(spark, str(tmp_path / "out_json")).first().s == 'a"<b'
    states = spark.createDataFrame([("u", "ok", None), ("v", "error", "x"), ("w", "ok", None)], "url string, status string, error string")
    assert files.write_batch(states, str(tmp_path / "batch")) == {"ok": 2, "error": 1}
    files.save_template(spark, str(tmp_path / "t"), "n", "do", "{}")
    assert files.templates(spark, str(tmp_path / "t")).first().instruction == "do"


def test_config():
    c = files.load_config('{"llm": {"model": "m"}, "limits": {"rpm": 5}}', {"WEFTLINE_LLM_MAX_TOKENS": "7", "WEFTLINE_CACHE_ENABLED": "FALSE", "WEFTLINE_RATE_LIMIT_RPM": "x"})
    assert (c.llm.model, c.llm.max_tokens, c.cache.enabled, c.limits.rpm, c.chunking.max_tokens) == ("m", 7, False, 5, 8000)
    assert json.loads(c.to_json())["limits"]["rpm"] == 5


def test_unknown_strategy():
    from weftline.operators.chunking import strategy_of

    assert strategy_of("SIZE") == "size" and strategy_of("what") == "semantic"
    with pytest.raises(KeyError):
        usage.SIMULATIONS["none"]


def test_command_line(spark, tmp_path):
    from weftline.__main__ import main

    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.html").write_text("<title>T</title><main><h1>Hi</h1><p>x</main>")
    main(["extract", str(tmp_path / "pages"), "--what", "markdown", "--out", str(tmp_path / "md")])
    assert "# [TITLE] Hi" in spark.read.json(str(tmp_path / "md")).first().markdown
    main(["extract", str(tmp_path / "pages"), "--what", "chunks", "--strategy", "size", "--out", str(tmp_path / "chunks")])
    assert spark.read.json(str(tmp_path / "chunks")).first().result_kind == "Single"
    (tmp_path / "r.json").write_text('{"n": 1}\n{"n": 0}\nno\n')
    (tmp_path / "s.json").write_text('{"properties": {"n": {"type": "integer", "minimum": 1}}}')
    main(["validate", str(tmp_path / "r.json"), "--schema", str(tmp_path / "s.json"), "--mode", "strict", "--out", str(tmp_path / "v")])
    assert sorted(r.is_valid for r in spark.read.json(str(tmp_path / "v")).collect()) == [False, False, True]
    main(["template", "create", str(tmp_path / "t"), "--name", "n", "--instruction", "i"])
    assert files.templates(spark, str(tmp_path / "t")).count() == 1
