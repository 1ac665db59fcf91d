"""WARC archives: written, read, revisits resolved, and rewritten without repeats.

Archives are files of whole records, written by Spark's text writer (a record is text
and its closing line feeds end the line) and read by its binary reader, so they can lie
in any store that Spark reaches. A file holds at most ``FILE_BYTES`` before compression,
or one record that is larger; archives are unpacked as a stream. A record is found by its
Content-Length, never by looking for a mark that a payload may hold as well.

To resolve revisits or find repeats, only headers are grouped: per payload digest one
row (the original), from a partial and a final aggregate. Records are then joined with
the originals, which Spark splits where a digest is hot.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_BYTES = 32 << 20
#: Fixed values of the formats.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KIND = ("source_id long, record_type string, record_id string, refers_to string, uri string, date string, "
        "payload_digest string, payload string, payload_bytes long")
#: Stands for a null source id where the smallest is looked for: after all others.
LAST = (1 << 63) - 1


def base32_sha1(text: Column) -> Column:
    """SHA-1 of the UTF-8 bytes in base 32, upper case, without padding."""
    digits = F.sha1(text)
    out = []
    for i in range(8):
        value = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(value, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*out)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def captured(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
             date: str | None = None) -> DataFrame:
    """Response records of pages, each with an id of its own, repeated rows too.

    A null payload counts as empty; null ids and addresses stay null.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    # Line ends would break a header.
    uri = F.replace(F.replace(F.col(uri_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(id_col).cast("long").alias("source_id"), uri.alias("uri"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
    return rows.select(
        "source_id", F.lit("response").alias("record_type"),
        _uuid(F.lit("response"), F.col("source_id"), F.col("uri"), F.col("payload_digest"),
              F.monotonically_increasing_id()).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"), "uri", F.lit(date).alias("date"), "payload_digest", "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"))


def _file_numbers(file_bytes: int):
    """Numbers that grow within a task whenever the records so far fill a file; only sizes go to Python."""
    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        filled, at = 0, 0
        for sizes in batches:
            out = []
            for size in sizes:
                if filled and filled + size > file_bytes:
                    filled, at = 0, at + 1
                filled += size
                out.append(at)
            yield pd.Series(out, dtype="int64")

    number.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(number, "long").asNondeterministic()


def write(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write records in gzipped files of at most ``file_bytes`` (or one record), without a shuffle.

    The block of a response is an HTTP message, that of a revisit its headers only.
    Files of the same number in their tasks share a folder ``file=...``.
    """
    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce("payload", F.lit(""))))
    made = records.withColumn("block", block)
    record = F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", F.col("record_id")),
        header("WARC-Date", F.col("date")), header("WARC-Target-URI", F.col("uri")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Refers-To", F.col("refers_to")), header("WARC-Profile", F.when(revisit, PROFILE)),
        header("X-Source-Id", F.col("source_id")), F.lit("Content-Type: application/http; msgtype=response\r\n"),
        header("Content-Length", F.octet_length("block")), F.lit("\r\n"), F.col("block"), F.lit("\r\n\r"))
    lines = made.select(record.alias("value")).withColumn("file", _file_numbers(file_bytes)(F.octet_length("value").cast("long") + 1))
    lines.write.partitionBy("file").option("compression", "gzip").text(path)


def parsed(archive: io.BufferedIOBase) -> Iterator[tuple]:
    """Records of one unpacked archive, read as a stream."""
    while line := archive.readline():
        head = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().removesuffix("\r\n").partition(": ")
            head[name] = value
        block = archive.read(int(head["Content-Length"]))
        archive.read(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        gone = head["WARC-Type"] == "revisit"
        yield (int(head["X-Source-Id"]) if "X-Source-Id" in head else None, head["WARC-Type"], head["WARC-Record-ID"],
               head.get("WARC-Refers-To"), head.get("WARC-Target-URI"), head["WARC-Date"],
               head["WARC-Payload-Digest"].removeprefix("sha1:"), None if gone else payload.decode(), size)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [f.split()[0] for f in KIND.split(", ")]
        kinds = [pa.int64() if f.endswith("long") else pa.string() for f in KIND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for part in batches:
        for content in part.column("content"):
            rows, size = [], 0
            for row in parsed(gzip.open(io.BytesIO(content.as_buffer()))):
                rows.append(row)
                size += len(row[7] or "") + 500
                if size > 4 << 20:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under a path; a revisit's payload is null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)
    return files.select("content").mapInArrow(_read, KIND)


def _originals(records: DataFrame, more: list[str]) -> DataFrame:
    """Per payload the header of the response with the smallest source id."""
    top = F.struct(F.coalesce("source_id", F.lit(LAST)).alias("first_id"), F.col("record_id").alias("first_record"),
                   F.col("payload_bytes").alias("first_bytes"))
    return records.filter("record_type = 'response'").groupBy("payload_digest", *more).agg(F.min(top).alias("top")) \
        .select("payload_digest", *more, "top.*")


def deduplicated(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Records with fresh headers: of equal payloads one response stays, the others revisit it.

    Payloads count as equal if SHA-1, length and a second hash are. Responses shorter
    than ``min_bytes`` and records that are revisits already stay. Records that repeat
    the smallest source id are all responses; a null id comes last.
    """
    keyed = records.withColumn("check", F.xxhash64("payload"))
    same = ["payload_bytes", "check"]
    found = keyed.join(_originals(keyed, same).drop("first_bytes"), ["payload_digest", *same], "left")
    repeats = (F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes) \
        & (F.coalesce("source_id", F.lit(LAST)) != F.col("first_id"))
    kind = F.when(repeats, "revisit").otherwise(F.col("record_type"))
    return found.select(
        "source_id", kind.alias("record_type"),
        _uuid(F.lit("fresh"), F.col("record_id")).alias("record_id"),
        F.when(repeats, _uuid(F.lit("fresh"), F.col("first_record"))).otherwise(F.col("refers_to")).alias("refers_to"),
        "uri", "date", "payload_digest", F.when(~repeats, F.col("payload")).alias("payload"), "payload_bytes")


def resolved(records: DataFrame) -> DataFrame:
    """All records, each revisit with ``original_id``, the source id of the response it refers to.

    A revisit whose response isn't there, or has no id, gets null; so do responses.
    """
    first = _originals(records, []).select("payload_digest", "first_id")
    found = records.join(first, "payload_digest", "left")
    return found.select(*records.columns, F.when(
        F.col("record_type") == "revisit", F.nullif("first_id", F.lit(LAST))).alias("original_id"))
