"""A content-addressed WARC archive, in DataFrame functions only.

write_archive() stores each distinct payload once under its SHA-256, whose equality is checked
by length and SHA-1, and beside them the exact header of every record. read_archive() verifies
each stored payload against its digest and joins headers and payloads into records again.

Defined results: a null html is an empty payload; of records with equal payloads, that with the
smallest page_id is the response (nulls come last; of rows that repeat, one is), the others are
revisits; payloads under min_revisit bytes are all responses; a null url has an empty target;
empty tables give empty results; other columns are dropped. A payload that fails its check on
reading, or digests that meet for different payloads on writing, raise an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, pick, settled, table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def base32_sha1(col):
    """20 bytes are four times 40 bits, each eight letters."""
    hexa = F.sha1(col)
    out = []
    for i in range(4):
        word = F.conv(F.substring(hexa, 1 + 10 * i, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(BASE32), (F.shiftright(word, 35 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*out)


def record_id(*cols):
    h = F.md5(F.concat_ws("|", *cols).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_revisit: int = 0) -> None:
    """Writes path/payloads (sha256, payload) and path/headers (sha256, header) from pages (page_id, url, html)."""
    rows = pick(pages, "page_id", "url", "html").withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    rows = rows.select(F.col("page_id").cast("long"), "url", "payload", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("n"))
    same = F.min("n") == F.max("n")
    stored = rows.withColumn("digest", base32_sha1(F.col("payload"))).groupBy("sha256").agg(F.first("payload").alias("payload"), (same & (F.min("digest") == F.max("digest"))).alias("same"))
    checked = F.when(F.col("same"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payloads differ that have SHA-256 "), "sha256")).cast("binary"))
    stored.select("sha256", checked.alias("payload")).write.parquet(f"{path}/payloads")

    entries = settled(rows.select("page_id", "url", "sha256", "n", base32_sha1(F.col("payload")).alias("digest")).withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    # Kept apart, so that a payload with very many records is split in the join.
    firsts = settled(entries.groupBy("sha256").agg(F.min(order).alias("first")))
    is_response = (F.col("n") < min_revisit) | (F.col("row") == F.col("first.row"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    own = record_id(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "sha256", F.col("row").cast("string"))
    first = record_id(F.coalesce(F.col("first.page_id").cast("string"), F.lit("")), "sha256", F.col("first.row").cast("string"))
    block = F.octet_length(http) + F.when(is_response, F.col("n")).otherwise(0)
    header = F.concat(
        F.lit(f"WARC/1.0{CRLF}"),
        line("WARC-Type", F.when(is_response, "response").otherwise("revisit")),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id"))).otherwise(""),
        F.when(~is_response, F.concat(line("WARC-Refers-To", first), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))).otherwise(""),
        F.when(~is_response & F.col("first.page_id").isNotNull(), line("X-Refers-To-Page-Id", F.col("first.page_id"))).otherwise(""),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        line("Content-Length", block),
        F.lit(CRLF),
        http,
    )
    entries.join(firsts, "sha256").select("sha256", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256, payload, payload_bytes, payload_digest; each is checked against its address."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    out = stored.select("sha256", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    good = F.sha2("payload", 256) == F.col("sha256")
    return out.withColumn("payload_bytes", F.when(good, F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("the payload stored as "), "sha256", F.lit(" is damaged"))).cast("long")))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """sha256, header, and from it page_id, record_type, refers_to and header_digest."""
    rows = spark.read.schema("sha256 string, header binary").parquet(f"{path}/headers").withColumn("h", F.decode("header", "UTF-8"))
    field = lambda name: F.nullif(F.regexp_extract("h", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    return rows.select("sha256", "header", field("X-Page-Id").cast("long").alias("page_id"), field("WARC-Type").alias("record_type"), field("X-Refers-To-Page-Id").cast("long").alias("refers_to"), field("WARC-Payload-Digest").alias("header_digest"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, record (its exact bytes), payload."""
    both = read_headers(spark, path).join(read_payloads(spark, path), "sha256")
    tail = F.lit(CRLF * 2).cast("binary")
    record = F.when(F.col("record_type") == "response", F.concat("header", "payload", tail)).otherwise(F.concat("header", tail))
    ok = F.col("header_digest") == F.concat(F.lit("sha1:"), "payload_digest")
    digest = F.when(ok, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header's digest is not its payload's")).cast("string"))
    return both.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", record.alias("record"), "payload")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    rows = read_archive(spark, path)
    # Of the rebuilt record: its size, and the digest of what follows its header (nothing, for a revisit).
    start = F.octet_length("record") - 4 - F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    body = F.substring("record", (start + 1).cast("int"), (F.octet_length("record") - 4 - start).cast("int"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2(body, 256).alias("body_sha256"))


_LETTERS = " || ".join(f"substr('{BASE32}', 1 + ((w{i} >> {35 - 5 * j}) & 31)::int, 1)" for i in range(4) for j in range(8))
_WORDS = ", ".join(f"('0x' || substr(h, {1 + 10 * i}, 10))::bigint as w{i}" for i in range(4))
_URN = "<urn:uuid:00000000-0000-0000-0000-000000000000>"
#: A record's header with an id of the same length.
_HEADER = f"""'WARC/1.0~WARC-Type: ' || record_type || '~WARC-Record-ID: {_URN}~WARC-Date: {DATE}~WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\r\n]', '%0A', 'g') || '~WARC-Payload-Digest: sha1:' || payload_digest || '~'
  || case when page_id is not null then 'X-Page-Id: ' || page_id || '~' else '' end
  || case when k > 1 then 'WARC-Refers-To: {_URN}~WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest~' else '' end
  || case when k > 1 and first is not null then 'X-Refers-To-Page-Id: ' || first || '~' else '' end
  || 'Content-Type: application/http;msgtype=response~Content-Length: ' || (octet_length(encode(http)) + case when k = 1 then payload_bytes else 0 end) || '~~'"""
OP4_SQL = f"""
with p as (select row_number() over () as n, page_id, url, coalesce(html, '') as t from pages),
h as (select *, sha1(t) as h, octet_length(encode(t))::bigint as payload_bytes from p),
w as (select *, {_WORDS} from h),
f as (
  select *, row_number() over (partition by t order by page_id nulls last, n) as k, min(page_id) over (partition by t) as first, {_LETTERS} as payload_digest,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || payload_bytes || chr(13) || chr(10) || chr(13) || chr(10) as http from w),
g as (select *, case when k = 1 then 'response' else 'revisit' end as record_type from f)
select page_id, payload_bytes, payload_digest, record_type, case when k > 1 then first end as refers_to,
       octet_length(encode(replace({_HEADER}, '~', chr(13) || chr(10)) || http))::bigint + case when k = 1 then payload_bytes else 0 end + 4 as record_bytes,
       sha256(case when k = 1 then t else '' end) as body_sha256
from g
"""
