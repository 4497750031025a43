"""Content-addressed WARC archive (operator 6).

An archive is two tables in a folder: `payloads` keeps the bytes of every
distinct payload once, under its SHA-256; `records` keeps the exact header
block (WARC and HTTP) of every record with the address of its payload.  The
original records come back by a join on the address.  Reading re-hashes the
stored bytes and fails on any difference from the address or from the digest
in a record's header.

Only one shuffle carries payloads, and copies are combined before it; the
joins move headers and digests alone, so a hot payload is a matter of narrow
rows that adaptive execution can split.

Defined cases: null html is the empty payload; repeated page ids with one
payload are alike (both response, if theirs is the smallest id); a null page
id comes after all others; control characters (0x00 to 0x1F, 0x7F) in a URL are
percent-encoded; a null URL has no target field; an empty table gives an empty
archive; no column but the three named ones is read, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: RFC 4648 base32 against the digits of base 32 as a number.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_CONTROL = r"[\x00-\x1f\x7f]"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are four times 40 bits, or eight digits."""
    hexed = F.sha1(payload)
    part = lambda k: F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*(part(k) for k in range(4))), _DIGITS, _BASE32)


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _header(page_id: Column, url: Column, digest: Column, size: Column, revisit: Column, head: Column) -> tuple[Column, Column]:
    """The WARC header block and the HTTP header block of a record."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF + CRLF))
    # a control character in a URL could end its field
    encoded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(_CONTROL), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)), "")
    safe = F.when(url.rlike(_CONTROL), encoded).otherwise(url)
    name = F.coalesce(page_id.cast("string"), F.lit("null"))
    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        F.coalesce(_field("WARC-Target-URI", safe), F.lit("")),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(_field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), head.cast("string"), F.lit(">"))), _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", (F.length(http) + F.when(revisit, F.lit(0)).otherwise(size)).cast("string")),
        F.lit(CRLF),
    )
    return warc, http


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> None:
    """Write pages as records into a new archive at `path`.

    Of records with equal payloads of at least `min_bytes` bytes, the one with
    the smallest page id is a response and the others revisit it; smaller
    payloads are responses all, and still stored once.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("address", F.unhex(F.sha2("payload", 256)))
    rows.groupBy("address").agg(F.min("page_id").alias("head"), F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    heads = pages.sparkSession.read.parquet(f"{path}/payloads").select("address", "head")
    narrow = rows.select("page_id", "url", "address", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    revisit = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("head"))
    warc, http = _header(F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), revisit, F.col("head"))
    narrow.join(heads, "address").select("page_id", "address", warc.alias("header"), http.alias("http")).write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: page_id, header, http, record bytes, and the fields of the header.

    `record` is the original record, byte by byte.  Payload bytes are read and
    hashed again before the join; a mismatch raises an error.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "address", "payload", F.sha2("payload", 256).alias("_sha256"), base32_sha1(F.col("payload")).alias("_sha1"), F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    records = spark.read.parquet(f"{path}/records")
    value = lambda name, pattern: F.regexp_extract("header", rf"\r\n{name}: {pattern}", 1)
    kind = records.schema["page_id"].dataType
    parsed = records.withColumns({
        "record_type": value("WARC-Type", r"([^\r]*)"),
        "payload_digest": value("WARC-Payload-Digest", r"sha1:([A-Z2-7]*)"),
        "refers_to": F.nullif(value("WARC-Refers-To", r"<urn:page:([^\r]*)>"), F.lit("")).cast(kind),
        "content_length": value("Content-Length", r"([0-9]+)").cast("long"),
    })
    sound = (F.col("_sha1") == F.col("payload_digest")) & (F.lower(F.hex("address")) == F.col("_sha256"))
    sound &= F.col("content_length") == F.length("http") + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    record = F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), body, F.lit(CRLF + CRLF).cast("binary"))
    return parsed.join(payloads, "address").select(
        "page_id", "header", "http", record.alias("record"), "payload", "payload_bytes",
        F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged archive record: "), F.col("header")))).alias("payload_digest"),
        "record_type", "refers_to",
    )
