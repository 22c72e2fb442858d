"""A content-addressed archive of WARC records.

The archive is two Parquet tables under one folder: ``payloads`` has every
payload's bytes once, by their SHA-256, and ``headers`` the exact header block of
each record, the HTTP head of its block, and the digest that it refers to.
``read_archive`` reconstructs the records by a join on the digest and verifies every
payload against it; ``record_bytes`` gives their bytes as they stand in a file.

Of equal payloads of at least ``min_bytes`` bytes, the record with the largest
key is the response and the others are revisits of it.  Payloads that a Bloom
filter shows to be unique are written straight; only possibly repeated ones
shuffle, and partial aggregation keeps one copy a task of a payload that a third
of the records may share.  Reading back, a payload of many records is dealt out
once for every ``SPREAD`` of them, so no task gets all records of a digest.

Defined results: null payload counts as empty; a null url gives an empty target;
null keys are smaller than any other; repeated rows that share the largest key
are all responses, with one stored payload, and every record has an id of its own;
an empty table makes an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, shared_dir
from .dedup import filter_of, split

DATE = "2024-01-01T00:00:00Z"
HEADERS = "k {kind}, digest string, header binary, head binary, copies long"
PAYLOADS = "digest string, payload binary, copies long"
#: Records of one payload that are joined with a copy of it.
SPREAD = 1000
END = "\r\n\r\n"


def base32(hexadecimal):
    """Upper-case base32 (RFC 4648) of a hex column of a multiple of 10 digits, 40 as of SHA-1."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * n, 10), 16, 32), 8, "0") for n in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, path: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = DATE) -> str:
    """Write the archive of ``pages`` under ``path`` (a fresh shared folder by default); returns the folder."""
    path = path or f"{shared_dir(pages.sparkSession)}/archives/{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    given = pages.select(F.col(key).alias("k"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = saved(given.select("k", F.monotonically_increasing_id().alias("row"), "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n")), "records")
    found = filter_of(rows, "digest")
    possible, single = split(rows, F.col("digest"), found)
    possible = saved(possible, "possible")
    last = F.struct("k", "row")
    copies = saved(possible.groupBy("digest").agg(F.max(last).alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "revisited")
    repeated = possible.join(copies, "digest", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    single = single.select("digest", *[c for c in rows.columns if c != "digest"], F.lit(None).cast(copies.schema["first"].dataType).alias("first"), F.lit(1).cast("long").alias("copies"))
    revisit = (F.col("copies") > 1) & (F.col("n") >= min_bytes) & ~F.col("k").eqNullSafe(F.col("first.k"))

    def record_id(k, row):
        return F.concat(F.lit("<urn:record:"), F.coalesce(F.url_encode(k.cast("string")), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))

    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("k"), F.col("row"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first.k"), F.col("first.row")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length("head") + F.when(revisit, F.lit(0)).otherwise(F.col("n"))).cast("string")),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit(END)).cast("binary")
    both = single.unionByName(repeated).withColumn("head", head)
    both.select("k", "digest", header.alias("header"), F.col("head").cast("binary").alias("head"), "copies").write.option("compression", "zstd").parquet(f"{path}/headers")
    several, once = split(given.select("digest", "payload"), F.col("digest"), found)
    once = once.withColumn("copies", F.lit(1).cast("long"))
    several = several.groupBy("digest").agg(F.first("payload").alias("payload"), F.count("*").alias("copies"))
    once.unionByName(several).write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def read_archive(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """``k, header, head, payload`` of every record of the archive at ``path``; ``kind`` is the type of the key.

    ``payload`` is the full one, for revisits too.  A payload that is missing or
    does not have its digest is an error.
    """
    headers = spark.read.schema(HEADERS.format(kind=kind)).parquet(f"{path}/headers")
    payloads = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    parts = F.ceil(F.col("copies") / SPREAD)
    headers = headers.withColumn("part", F.pmod(F.xxhash64("header"), parts))
    payloads = payloads.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("copies")
    good = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("no payload has digest "), F.col("digest"))).cast("binary"))
    return headers.join(payloads, ["digest", "part"], "left").select("k", "header", "head", good.alias("payload"))


def record_bytes(records: DataFrame) -> DataFrame:
    """``records`` with ``record``: the bytes of each WARC record as it stands in a file."""
    body = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.withColumn("record", F.concat("header", "head", body, F.lit(END).cast("binary")))


def _field(name: str):
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def describe(records: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, payload_bytes, payload_digest, record_type, refers_to, record_bytes, record_sha256`` of reconstructed records.

    A record whose length or payload digest is not as its header says is an error.
    """
    kind = records.schema["k"].dataType
    refers = F.url_decode(F.regexp_extract(_field("WARC-Refers-To"), "^<urn:record:(.*):[0-9]+>$", 1))
    digest = base32(F.sha1("payload"))
    block = F.octet_length("record") - F.octet_length("header") - len(END)
    good = (block.cast("string") == _field("Content-Length")) & (F.concat(F.lit("sha1:"), digest) == _field("WARC-Payload-Digest"))
    checked = F.when(good, F.octet_length("record").cast("long")).otherwise(F.raise_error(F.lit("a record is not as its header says")).cast("long"))
    return record_bytes(records).select(F.col("k").alias(key), F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), _field("WARC-Type").alias("record_type"), F.when(refers != "", refers).cast(kind).alias("refers_to"), checked.alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write an archive of ``pages``, read it back, reconstruct its records and describe them."""
    path = write_archive(pages, None, key, url, html, min_bytes)
    return describe(read_archive(pages.sparkSession, path, pages.schema[key].dataType.simpleString()), key)
