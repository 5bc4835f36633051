"""WARC as a content-addressed archive.

``write_archive`` stores each distinct payload once, under its SHA-1, which is
verified by length and SHA-256 (two payloads that share only the SHA-1 stay
apart), and keeps the exact header bytes of every record in a table of their
own.  ``read_archive`` joins the two back into the original records, takes the
payload out of the record by its own Content-Length and checks it against the
digest that the record names; a mismatch is an error.

Of the records with equal payloads of at least ``least`` bytes, the one with the
largest page_id is a response; the others are revisits that refer to it.
Smaller payloads are always written as responses.

Cases: a null html is an empty payload; a null url leaves its header out, and
line ends in a url are percent-encoded; repeated rows make repeated records, all
of the response's kind if they share its id; a null page_id is smaller than any
other and is referred to by none that has an id; an empty table makes an empty
archive; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.llm._shared import shared_dir

LEAST_REVISIT = 1000
#: All records carry the capture time given by the caller, so that runs agree.
CAPTURED = "2024-01-01T00:00:00Z"
EOL = "\r\n"


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary"))
    at = lambda i, n: F.substring(h, i, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", at(1, 8), at(9, 4), at(13, 4), at(17, 4), at(21, 12)), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))


def _headers(captured: str) -> tuple[Column, Column]:
    """The header bytes of a record: WARC's own and those of the HTTP answer."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"),
        _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(EOL),
    )
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    warc = F.concat(
        F.lit(f"WARC/1.1{EOL}"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _line("WARC-Date", F.lit(captured)), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
        _line("Page-Id", F.col("page_id").cast("string")), _line("Refers-To-Page-Id", F.col("refers_to").cast("string")),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", length.cast("string")), F.lit(EOL),
    )
    return warc.cast("binary"), http.cast("binary")


def write_archive(pages: DataFrame, path: str | None = None, least: int = LEAST_REVISIT, captured: str = CAPTURED) -> str:
    """Archive ``pages(page_id, url, html)`` under ``path`` and return it."""
    path = path or f"{shared_dir(pages.sparkSession)}/weftline/warc-{uuid.uuid4().hex}"
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    content = [F.sha1(body).alias("payload_digest"), F.sha2(body, 256).alias("check"), F.octet_length(body).cast("long").alias("payload_bytes")]
    same = ["payload_digest", "check", "payload_bytes"]
    held = pages.select("page_id", *content, body.alias("payload")).groupBy(*same).agg(
        F.max("page_id").alias("holder"), F.first("payload").alias("payload"))
    held.write.parquet(f"{path}/payloads")
    holders = pages.sparkSession.read.parquet(f"{path}/payloads").drop("payload")
    records = pages.select("page_id", "url", *content).join(holders, same)
    again = (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    records = records.select(
        "page_id", "url", *same, F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("holder")).alias("refers_to"),
    )
    warc, http = _headers(captured)
    records.select("page_id", *same, warc.alias("warc_header"), http.alias("http_header")).write.parquet(f"{path}/headers")
    return path


def _field(header: Column, name: str) -> Column:
    value = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest, payload (of a revisit,
    that of the record it refers to) and record, the whole record's bytes."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    rows = headers.join(payloads.select("payload_digest", "check", "payload_bytes", "payload"), ["payload_digest", "check", "payload_bytes"])
    text = F.decode("warc_header", "UTF-8")
    rows = rows.withColumn("text", text).withColumn("record_type", _field(F.col("text"), "WARC-Type"))
    none = F.lit("").cast("binary")
    rows = rows.withColumn("block", F.concat("http_header", F.when(F.col("record_type") == "revisit", none).otherwise(F.col("payload"))))
    broken = (F.octet_length("block") != _field(F.col("text"), "Content-Length").cast("long")) | (
        F.concat(F.lit("sha1:"), F.sha1("payload")) != _field(F.col("text"), "WARC-Payload-Digest"))
    intact = F.when(broken, F.raise_error(F.lit("archive record does not match its headers")).cast("binary")).otherwise(F.col("payload"))
    return rows.select(
        _field(F.col("text"), "Page-Id").cast("long").alias("page_id"), "record_type",
        _field(F.col("text"), "Refers-To-Page-Id").cast("long").alias("refers_to"),
        F.substring(_field(F.col("text"), "WARC-Payload-Digest"), 6, 40).alias("payload_digest"), intact.alias("payload"),
        F.concat("warc_header", "block", F.lit(EOL * 2).cast("binary")).alias("record"),
    )
