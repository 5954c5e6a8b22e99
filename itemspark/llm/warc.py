"""WARC archives with revisit records.

Headers (id, digest, size) are shuffled by payload digest; the record with the
largest id of a digest is the original, others become revisit records by a join
with it. Archives are written by Spark's text writer, whose line separator is
the end mark of a record, so tasks commit whole files and may be repeated.

Cases: a null payload is empty; a null URL leaves its header out; a record
without an id is never a revisit and nothing refers to it; repeated rows are
written as often as they occur; an empty table writes an empty archive, which
reads back as no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.session import ship

ship(__name__)

_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Records of one file; a file is read as a whole.
FILE_RECORDS = 2000

_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a payload in base 32: forty bits at a time are written in base 32 and its digits renamed."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _DIGITS32, _BASE32)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Of headers (``page_id``, ``payload_digest``, ``payload_bytes``) those that become revisits, with ``refers_to``."""
    large = headers.filter((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    originals = (
        large.groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "refers_to")
    )
    # the join is by digest alone, so that Spark may split a digest that many records share
    on = (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")) & (F.col("page_id") < F.col("refers_to"))
    return large.join(originals, on).select("page_id", "payload_digest", "refers_to").distinct()


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One WARC record text per page (``page_id``, ``url``, ``html``)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    revisits = resolve_revisits(rows.select("page_id", "payload_digest", "payload_bytes"), min_bytes)
    rows = rows.join(revisits, ["page_id", "payload_digest"], "left")
    is_revisit = F.col("refers_to").isNotNull()
    block = F.when(is_revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), "payload"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", uri),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Profile", F.when(is_revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", urn(F.col("refers_to"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    return rows.select(record.alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    (
        records(pages, min_bytes)
        .write.option("lineSep", _END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(path)
    )


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


def _records_of(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8").split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start, length = head_end + 4, int(head["Content-Length"])
        payload = data[data.index(b"\r\n\r\n", start) + 4 : start + length]
        if head["WARC-Type"] == "revisit":
            size, digest = int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
        else:
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")
        yield _page(head.get("WARC-Record-ID")), head.get("WARC-Target-URI"), head["WARC-Type"], _page(head.get("WARC-Refers-To")), size, digest, payload
        at = start + length + 4


def _read(with_payload: bool):
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = list(_records_of(zlib.decompress(content, 31) if content else b""))
                out = pd.DataFrame(found, columns=[*names, "payload"])
                out = out.astype({"page_id": "Int64", "refers_to": "Int64"})
                yield out if with_payload else out[names]

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives; digest and size of responses are computed from the stored payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(_read(with_payload), _RECORD + (", payload binary" if with_payload else ""))
