"""Content-addressed archive of web records.

Payload bytes are stored once per SHA-256 digest, exact record headers are stored
separately, and records are rebuilt by joining the two on the digest.

Edge cases: a null payload is an empty one; a null id counts as smaller than any id;
rows that repeat both id and payload are identical records and all count as the
response if their id is the largest; an empty table gives an empty archive; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table, workspace

# Digits of Spark's base-32 conversion and those of RFC 4648 for the same numbers.
DIGITS_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RFC_4648_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex40(hex40: Column) -> Column:
    """Upper-case base32 of 20 bytes given as 40 hex digits: four groups of 40 bits."""
    groups = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), DIGITS_32, RFC_4648_32)


def _records(pages: DataFrame, id_col: str, uri_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit(b""))
    return pages.select(
        pages[id_col].alias("record_id"),
        pages[uri_col].cast("string").alias("uri"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("key"),
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write ``path/payloads`` (one row per digest) and ``path/headers`` (one row per record).

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest id is
    the response and the others are revisits of it; smaller ones are all responses.
    """
    records = _records(pages, id_col, uri_col, payload_col)
    # One copy for each digest: partial aggregation drops copies before payloads are shuffled.
    records.groupBy("key").agg(F.first("payload").alias("payload")).select(
        "key", base32_of_hex40(F.sha1("payload")).alias("sha1_32"), "payload"
    ).write.option("compression", "zstd").parquet(f"{path}/payloads")

    heads = records.select("record_id", "uri", "payload_bytes", "key", F.sha1("payload").alias("sha1"))
    newest = heads.groupBy("key").agg(F.max("record_id").alias("newest_id"))
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("record_id").eqNullSafe(F.col("newest_id"))
    crlf = "\r\n"
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "),
        F.col("record_type"),
        F.lit(f"{crlf}WARC-Record-ID: "),
        urn(F.col("record_id")),
        F.lit(f"{crlf}WARC-Target-URI: "),
        F.coalesce("uri", F.lit("")),
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"{crlf}WARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit(f"{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "),
        F.when(F.col("record_type") == "revisit", F.lit("0")).otherwise(F.col("payload_bytes").cast("string")),
        F.lit(crlf + crlf),
    )
    (
        heads.join(newest, "key")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("newest_id")))
        .withColumn("payload_digest", base32_of_hex40(F.col("sha1")))
        .select("record_id", "key", "record_type", "refers_to", header.cast("binary").alias("header"))
        .write.option("compression", "zstd")
        .parquet(f"{path}/headers")
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The payload store, each payload checked against the digest that it is stored under."""
    store = spark.read.parquet(f"{path}/payloads")
    return store.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("key"))).cast("binary")))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/headers")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild every record: record_id, record_type, refers_to, payload, and the record's exact bytes."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return read_headers(spark, path).join(read_payloads(spark, path), "key").select(
        "record_id", "record_type", "refers_to", "header", "payload", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record")
    )


def header_field(header: Column, name: str) -> Column:
    """The value of a named field of a record's header text, null where there is none."""
    return F.nullif(F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))


def archive_report(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, read from its rebuilt bytes.

    Type, id and reference are parsed from the stored header; length and SHA-1 are computed anew from the
    payload that the record leads to; a response's block must have the length and a record the digest that its
    header tells, else the read fails.
    """
    text = F.col("header").cast("string")
    number = lambda name: F.regexp_extract(header_field(text, name), r"<urn:record:(-?\d+)>", 1).try_cast("long")
    told = read_records(spark, path).select(
        number("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_of_hex40(F.sha1("payload")).alias("payload_digest"),
        header_field(text, "WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        header_field(text, "WARC-Payload-Digest").alias("told_digest"),
        header_field(text, "Content-Length").cast("long").alias("told_length"),
        (F.octet_length("record") - F.octet_length("header") - 4).cast("long").alias("block_length"),
        F.octet_length("header").cast("long").alias("header_bytes"),
    )
    sound = (F.col("told_digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (F.col("told_length") == F.col("block_length"))
    return told.withColumn(
        "record_type", F.when(F.coalesce(sound, F.lit(False)), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))).cast("string"))
    ).drop("told_digest", "told_length", "block_length")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    release(spark)  # the shuffle files of writing go before records are rebuilt
    return archive_report(spark, path).drop("header_bytes")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha1(coalesce(html, '')) AS h
  FROM pages),
d AS (
  SELECT *, list_aggregate(list_transform(range(8), lambda g:
      list_aggregate(list_transform(range(4), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (((('0x' || substr(h, (5 * g + 1)::INT, 5))::INT >> (15 - 5 * k)::INT) & 31) + 1)::INT, 1)), 'string_agg', '')),
      'string_agg', '') AS payload_digest,
      max(page_id) OVER (PARTITION BY body) AS newest
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM newest THEN NULL ELSE newest END AS refers_to
FROM d
"""
