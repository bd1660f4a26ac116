"""WARC archives in which equal payloads are stored once.

Payloads are never shuffled.  A first pass writes the headers of all pages: digest, length, page_id and
place in the input (file and row).  They alone are shuffled by digest: per (digest, length) met twice or
more the record with the largest page_id is the original, found by a pre-aggregated maximum, and the
others revisit it.  A second pass over the unshuffled pages writes one WARC record per page with fresh
headers; the references of its files are broadcast to it, in rounds of bounded size (``places``).

A record is text that ends with an empty line, so archives are written by Spark's text writer with
that line as separator, to any file system, and every task writes its own gzip files.  Small, medium
and large pages go to files of their own with bounded numbers of records, so that files are bounded by
bytes.  Reading back takes files whole and walks their records by Content-Length.

Record ids are UUIDs made of the write's own id and the place of the page, so that a repeated task
writes the same ones; all records of a write carry its date.

Defined results: null html is an empty payload, a null url an empty one; control characters and
spaces in a url are percent-encoded.  Repeated rows with the largest page_id are all responses.  Rows
without page_id revisit the original of a payload that has one, and are responses otherwise.  An
empty table gives an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import common, places
from tallyline.session import scratch_path

#: Sizes of payloads below which a file holds so many records: some 64 MB of text at most, or one page.
FILE_RECORDS = ((32 << 10, 2_000), (1 << 20, 64), (None, 1))
#: Payloads below this size are never revisited.
LEAST_BYTES = 0
END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(sha1_hex: Column) -> Column:
    """The 160 bits of a hexadecimal SHA-1 as 32 base32 digits: four from every five hex digits."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for at in range(8):
        bits = F.conv(F.substr(sha1_hex, F.lit(5 * at + 1), F.lit(5)), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digit = F.shiftright(bits, shift).bitwiseAND(31)
            parts.append(F.substr(F.lit(digits), digit + 1, F.lit(1)))
    return F.concat(*parts)


def _placed(pages: DataFrame, run: str) -> DataFrame:
    """The pages with their place, record id and payload length."""
    file, row = places.place_of(pages)
    html = F.coalesce(pages["html"], F.lit(""))
    hex_ = F.md5(F.concat_ws(" ", F.lit(run), file, row).cast("binary"))
    groups = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"
    return pages.select(
        file.alias("file"),
        row.alias("row"),
        F.regexp_replace(hex_, groups, "$1-$2-$3-$4-$5").alias("record_id"),
        pages["page_id"].cast("long").alias("page_id"),
        F.coalesce(pages["url"], F.lit("")).alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
    )


def headers(placed: DataFrame) -> DataFrame:
    """What is shuffled of a page."""
    payload_digest = F.unhex(F.sha1(F.col("html").cast("binary")))
    return placed.select("file", "row", "record_id", "page_id", "payload_bytes", payload_digest.alias("sha1"))


def references(heads: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """A row for each page that revisits another one: its place, the original's page_id and record id."""
    key = ["sha1", "payload_bytes"]
    numbered = heads.filter(F.col("payload_bytes") >= least)
    # Rows without page_id are least, so they are original only where none has one.
    original = F.max(F.struct("page_id", "record_id"))
    met = numbered.groupBy(*key).agg(original.alias("original"), F.count("*").alias("n"))
    met = met.filter((F.col("n") > 1) & F.col("original.page_id").isNotNull()).drop("n")
    revisits = numbered.join(met, key).filter(~F.col("page_id").eqNullSafe(F.col("original.page_id")))
    return revisits.select(
        "file",
        "row",
        F.col("original.page_id").alias("refers_to"),
        F.col("original.record_id").alias("original_id"),
    )


def record(date: str) -> Column:
    """The record of a row as text, without the empty line at its end."""
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("none"))
    is_response = F.col("refers_to").isNull()
    block = F.when(is_response, F.concat(F.lit(_HTTP), F.col("html"))).otherwise("")
    line = lambda name, *value: F.concat(F.lit(f"\r\n{name}: "), *value)
    urn = lambda name: F.concat(F.lit("<urn:uuid:"), F.col(name), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(is_response, "response").otherwise("revisit"),
        line("WARC-Record-ID", urn("record_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.lit("sha1:"), base32(F.sha1(F.col("html").cast("binary")))),
        line("X-Page-ID", text("page_id")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(is_response, "").otherwise(
            F.concat(
                line("WARC-Refers-To", urn("original_id")),
                line("WARC-Refers-To-Date", F.lit(date)),
                line("X-Refers-To-Page-ID", text("refers_to")),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            )
        ),
        line("Content-Type", F.when(is_response, "application/http;msgtype=response").otherwise("text/plain")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n\r\n"),
        block,
    )


def archived(placed: DataFrame, found: DataFrame, date: str) -> DataFrame:
    """The records of pages, given the references of a round."""
    return placed.join(F.broadcast(found), ["file", "row"], "left").select(record(date).alias("value"))


def write_archives(
    pages: DataFrame, path: str, least: int = LEAST_BYTES, limit: int = places.ROUND
) -> None:
    """Write a record per page below ``path``, which must be new.

    The rows of a Parquet table as it was read have a place; other relations are written once to get one."""
    placed = _placed(places.placed(pages), uuid.uuid4().hex)
    date = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = common.stored(headers(placed), "headers")
    found = common.stored(references(heads, least), "references")
    largest = heads.agg(F.max("payload_bytes")).first()[0]
    for first, end in places.rounds(found, limit):
        rows, known = (places.within(x, F.col("file"), F.col("row"), first, end, limit) for x in (placed, found))
        over = None
        for below, files in FILE_RECORDS:
            if over is not None and (largest is None or largest < over):
                break
            sized = rows if over is None else rows.filter(F.col("payload_bytes") >= over)
            sized = sized if below is None else sized.filter(F.col("payload_bytes") < below)
            archive = archived(sized, known, date).write.mode("append").option("lineSep", END)
            archive.option("compression", "gzip").option("maxRecordsPerFile", files).text(path)
            over = below
    common.discard(heads)
    common.discard(found)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    at = 0
    while at < len(archive):
        stop = archive.index(b"\r\n\r\n", at)
        lines = archive[at:stop].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        found = dict(line.split(": ", 1) for line in lines[1:])
        start = stop + 4
        end = start + int(found["Content-Length"])
        if archive[end : end + 4] != END.encode():
            raise ValueError(f"a record does not end at byte {end}")
        yield found, archive[start:end]
        at = end + 4


def _page(text: str) -> int | None:
    return None if text == "none" else int(text)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; the payload of a response is checked against its digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in records(gzip.decompress(content.as_py())):
                    stated, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    size, other = int(head["X-Payload-Length"]), None
                    if kind == "response":
                        payload = block[len(_HTTP) :]
                        if digest(payload) != stated or len(payload) != size:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    else:
                        other = _page(head["X-Refers-To-Page-ID"])
                    rows.append((_page(head["X-Page-ID"]), size, stated, kind, other))
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES
                )

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(common.table(spark, sf, "pages"), path)
    return read_archives(spark, path)


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, array_to_string([
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
          1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER)]
        FOR i IN range(32)], '') AS payload_digest FROM d),
o AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS original FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM o
"""
