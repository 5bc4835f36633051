"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from pyspark.sql import functions as F

from weftline.llm import bpe, html, mixing, quality, sharding, toxicity, warc
from weftline.llm._shared import modest_batches, table
from weftline.llm.embdedup import duplicates
from weftline.llm.minhash import near_duplicates
from weftline.llm.topk import top_k

#: The vocabulary of op6; its place is a parameter of the codec's callers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str = VOCABULARY) -> tuple[bytes, str]:
    """Content of a rank file and the split pattern that goes with it."""
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


SQL_TOPK = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


SQL_MINHASH = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
edges AS MATERIALIZED (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(x, root) AS (
  SELECT DISTINCT x, x FROM edges
  UNION
  SELECT edges.y, reach.root FROM reach JOIN edges ON reach.x = edges.x),
least_root AS (SELECT x, min(root) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       coalesce(component_id, doc_id) = doc_id AS kept
FROM s LEFT JOIN least_root ON x = doc_id
"""


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


SQL_EMBEDDINGS = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
edges AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, root) AS (
  SELECT DISTINCT x, x FROM edges
  UNION
  SELECT edges.y, reach.root FROM reach JOIN edges ON reach.x = edges.x),
least_root AS (SELECT x, min(root) AS component FROM reach GROUP BY x),
links AS (SELECT x, count(*) AS n FROM edges GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id,
       coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least_root ON least_root.x = vec_id LEFT JOIN links ON links.x = vec_id
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.assign(table(spark, sf_dir, "documents"))
    rows = plan.select(
        "doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("times"),
        F.get("positions", F.lit(0)).alias("position"))
    return mixing.by_position(rows, "position")


SQL_MIXING = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn
  FROM documents),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
r AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS turn_no FROM s),
w AS (SELECT key, source_size, [3.0, 1.0, 2.0][turn_no % 3 + 1]::DOUBLE AS w, [0.5, 0.0, -0.5][turn_no % 3 + 1]::DOUBLE AS slope,
        2 * source_size AS most, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM r),
f AS (SELECT *, (CAST(1.5 AS DOUBLE) * total - CAST(coalesce(sum(most) OVER (ORDER BY most / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
        / sum(w) OVER (ORDER BY most / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT *, max(CASE WHEN w * level <= most THEN level END) OVER () AS best FROM f),
t AS (SELECT key, source_size, slope, least(CAST(most AS DOUBLE), coalesce(w * best, CAST(most AS DOUBLE))) AS target FROM l),
c AS (
  SELECT doc_id, size, source_size, slope, target, CAST(round(target) AS BIGINT) AS goal,
    CAST(coalesce(sum(size) OVER (PARTITION BY key ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t USING (key)),
p AS (
  SELECT *, greatest(0, least(size, goal - start)) AS first_time, greatest(0, least(size, goal - source_size - start)) AS second_time,
    least(1.0::DOUBLE, start / target) AS u
  FROM c)
SELECT doc_id, size, source_size, target, CAST(first_time + second_time AS BIGINT) AS taken,
  CAST((first_time > 0)::INTEGER + (second_time > 0)::INTEGER AS INTEGER) AS times,
  CASE WHEN first_time > 0 THEN 2 * u / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) END AS position
FROM p
"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return bpe.encode(table(spark, sf_dir, "documents"), *vocabulary(), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return html.extract(table(spark, sf_dir, "pages"))


# For pages whose markup is as regular as that of the tables given: one article
# whose blocks are headings and paragraphs.
SQL_HTML = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, unnest(string_split(regexp_replace(x, '</?(?:p|h[1-6]|div|ul|li)(?:\s[^>]*)?>', chr(1), 'g'), chr(1))) AS y FROM a),
n AS (SELECT page_id, url, y, row_number() OVER () AS k FROM b),
c AS (SELECT page_id, url, k, trim(regexp_replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(y, '<br ?/?>', ' ', 'g'), '<[^>]*>', '', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS z FROM n),
t AS (SELECT page_id, url, coalesce(string_agg(z, chr(10) ORDER BY k) FILTER (z <> ''), '') AS text FROM c GROUP BY page_id, url)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archive(spark, warc.write_archive(table(spark, sf_dir, "pages")))
    return records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


SQL_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
        max(page_id) OVER (PARTITION BY sha256(body)) AS holder FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM holder AS again FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN holder END AS refers_to FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk": op1_topk,
        "op2_minhash": op2_minhash,
        "op3_embeddings": op3_embeddings,
        "op4_quality": op4_quality,
        "op5_mixing": op5_mixing,
        "op6_bpe": op6_bpe,
        "op7_html": op7_html,
        "op8_toxicity": op8_toxicity,
        "op9_sharding": op9_sharding,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": SQL_TOPK,
        "op2_minhash": SQL_MINHASH,
        "op3_embeddings": SQL_EMBEDDINGS,
        "op5_mixing": SQL_MIXING,
        "op7_html": SQL_HTML,
        "op10_warc": SQL_WARC,
    }
