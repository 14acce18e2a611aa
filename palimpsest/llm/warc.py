"""Content-addressed web archive: payload bytes once by SHA-256, exact record headers apart.

`write_archive` stores two tables: `payloads` (digest, payload, salts), one row for each distinct
payload, and `headers` (digest, salt, header, http), the exact WARC/1.1 and HTTP header bytes of every
record. `read_archive` joins the two and rebuilds the original records byte for byte;
`parsed` reads records as any WARC reader would and verifies every payload against the digest that
its record states. Payloads of one digest are compared by a second hash when they are written.

A digest that stands on more than PER_KEY records has that many salts in its headers, and reading
repeats its payload for each of them, so no task gets all records of a frequent payload.

Defined results: a null payload is empty; a null or multi-line target gives a record without, or
with a percent-encoded, target; among records with equal payloads of at least `least_bytes` the
smallest id is the response (rows that repeat that id too) and the others revisit it; smaller
payloads are all responses; payloads of any length are kept whole; records of null id have none in
their header and read back as null; an empty table gives empty tables; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common

PER_KEY = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), c.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    date: str = "2024-01-01T00:00:00Z", least_bytes: int = 100,
) -> None:
    raw = pages.select(
        F.col(id_col).cast("long").alias("record_id"),
        F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    other = F.xxhash64("payload")
    one = F.when(F.min(other) == F.max(other), F.first("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads of digest "), F.first("digest"))))
    salts = F.ceil(F.count("*") / PER_KEY).cast("int")
    raw.groupBy("digest").agg(one.alias("payload"), salts.alias("salts")).write.mode("overwrite").parquet(f"{path}/payloads")

    keys = raw.select("record_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"))
    # a table, so that the skewed join with it can be split
    shared = common.written(keys.groupBy("digest").agg(F.min("record_id").alias("first_id"), salts.alias("salts"), F.count("*").alias("records")).where("records > 1").drop("records"), "shared-digests")
    known = keys.join(shared, "digest", "left").withColumn("salt", F.pmod(F.hash("record_id", "url"), F.coalesce("salts", F.lit(1))))
    revisit = F.col("first_id").isNotNull() & (F.col("first_id") != F.coalesce("record_id", F.col("first_id") - 1)) & (F.col("size") >= least_bytes)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n")
    )
    block = F.octet_length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("record_id"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("first_id")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
    )
    known.withColumn("http", http).select("digest", "salt", header.cast("binary").alias("header"), F.col("http").cast("binary").alias("http")).write.mode(
        "overwrite"
    ).parquet(f"{path}/headers")
    common.discard(shared)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record, payload): the exact bytes of every record, and the whole payload that its digest names."""
    stored = spark.read.parquet(f"{path}/payloads").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    records = spark.read.parquet(f"{path}/headers").join(stored, ["digest", "salt"])
    body = F.when(F.contains("header", F.lit(b"\r\nWARC-Type: revisit\r\n")), F.lit(b"")).otherwise(F.col("payload"))
    return records.select(F.concat("header", "http", body, F.lit(b"\r\n\r\n")).alias("record"), "payload")


class DamagedRecord(ValueError):
    """A record whose bytes don't agree with its header."""


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """The named fields of a WARC record, its HTTP header, and its body."""
    end = record.find(b"\r\n\r\n")
    lines = record[:end].decode().split("\r\n")
    if end < 0 or lines[0] != "WARC/1.1":
        raise DamagedRecord("no WARC/1.1 header")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    start, size = end + 4, int(fields["Content-Length"])
    if len(record) != start + size + 4 or record[start + size :] != b"\r\n\r\n":
        raise DamagedRecord(f"{fields.get('WARC-Record-ID')}: the block is not of its stated length")
    block = record[start : start + size]
    http = block.find(b"\r\n\r\n") + 4
    return fields, block[:http], block[http:]


def _id_of(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:record:(-?[0-9]+)>", urn or "")
    return int(m[1]) if m else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for record, payload in zip(batch.column(0), batch.column(1), strict=True):
            fields, http, body = parse_record(record.as_py())
            payload = payload.as_py()
            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            stated = re.search(rb"\r\nContent-Length: ([0-9]+)\r\n", http)
            if hashlib.sha256(payload).hexdigest() != digest or not stated or int(stated[1]) != len(payload) or body != (b"" if fields["WARC-Type"] == "revisit" else payload):
                raise DamagedRecord(f"{fields.get('WARC-Record-ID')}: the payload is not the one that was archived")
            rows.append((_id_of(fields.get("WARC-Record-ID")), fields["WARC-Type"], _id_of(fields.get("WARC-Refers-To")), len(payload), digest))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])


def parsed(records: DataFrame) -> DataFrame:
    """record_id, record_type, refers_to, payload_bytes and payload_digest of the records, from their bytes; fails on a damaged record or payload."""
    return records.select("record", "payload").mapInArrow(_parse, "record_id long, record_type string, refers_to long, payload_bytes long, payload_digest string")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to FROM f
"""
