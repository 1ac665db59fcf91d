"""Removal of repeated passages: overlapping windows of three lines, seen globally.

Every run of three consecutive lines is hashed (128 bits). For each hash the first
occurrence in the corpus, by document id and position, is found by a partial and a
final aggregate, so a passage that a third of all documents hold costs one row per
task there. All later occurrences are then marked by an equi-join, which Spark splits
where a hash is hot, and the lines of a document that lie in any marked window go.

Only hashes and positions are shuffled for the search; texts move once, for the join
with the marked positions of their own document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.llm.batches import byte_rows, pieces
from perilake.llm.shared import free

LINES = 3
EDGE = b" \t\r"
NULL_ID = -(1 << 63)


def filled_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines of a text, and the places of those that aren't blank."""
    lines = text.split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(EDGE)]


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "body"):
                rows, starts, high, low = [], [], [], []
                for row, text in enumerate(byte_rows(batch.column("body"))):
                    lines, filled = filled_lines(text)
                    for i in range(len(filled) - size + 1):
                        hashed = xxhash.xxh3_128_intdigest(b"\n".join(lines[j].strip(EDGE) for j in filled[i:i + size]))
                        rows.append(row)
                        starts.append(i)
                        high.append(hashed >> 64)
                        low.append(hashed & ((1 << 64) - 1))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "row_id": batch.column("row_id").take(at), "row_hash": batch.column("row_hash").take(at),
                    "start": pa.array(starts, pa.int32()),
                    "high": pa.array(np.array(high, np.uint64).view(np.int64)),
                    "low": pa.array(np.array(low, np.uint64).view(np.int64))})
    return run


def _clean(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "body"):
                texts, removed = [], []
                for text, starts in zip(byte_rows(batch.column("body")), batch.column("starts").to_pylist()):
                    if not starts:
                        texts.append(text)
                        removed.append(0)
                        continue
                    lines, filled = filled_lines(text)
                    gone = {filled[i + j] for i in starts or () for j in range(size)}
                    removed.append(len(gone))
                    texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone))
                cleaned = pc.if_else(batch.column("body").is_valid(), pa.array(texts, pa.binary()).cast(pa.string()), None)
                yield pa.RecordBatch.from_pydict({
                    "others": batch.column("others"), "body": cleaned, "n_removed": pa.array(removed, pa.int64())})
    return run


def repeated_windows(docs: DataFrame, size: int = LINES) -> DataFrame:
    """Windows that occurred before: row_id, row_hash, start. Expects row_id, row_hash, body."""
    seen = docs.mapInArrow(_windows(size), "row_id long, row_hash long, start int, high long, low long")
    place = F.struct("row_id", "row_hash", "start")
    first = seen.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")) \
        .filter("n > 1").select("high", "low", "first")
    return seen.join(first, ["high", "low"]).filter(place != F.col("first")) \
        .select("row_id", "row_hash", "start")


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          size: int = LINES) -> DataFrame:
    """Documents without the lines of every window that occurred before in the corpus.

    Returns all rows and columns of ``docs`` with the text cleaned and a last column
    ``n_removed`` (with underscores added where that name is taken).

    Lines end at a line feed and are compared without blanks, tabs and carriage returns
    at either end; blank lines are no part of a window and stay. A text of fewer than
    ``size`` lines has no window and stays as it is. Windows overlap; what several of
    them cover is removed once. First is the smallest id, then the smallest place;
    within one document, a later copy of its own lines goes too. A null text stays null
    and a null id comes before all others. Rows that repeat an id and its text count as
    one document and get the same lines removed; rows that share only the id are told
    apart by the hash of their text. An empty table gives an empty result.
    """
    row_id, row_hash, removed = free(docs, "row_id", "row_hash", "n_removed")
    keyed = docs.withColumns({row_id: F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)),
                              row_hash: F.xxhash64(text_col)})
    slim = keyed.select(F.col(row_id).alias("row_id"), F.col(row_hash).alias("row_hash"), F.col(text_col).alias("body"))
    marked = repeated_windows(slim, size).groupBy("row_id", "row_hash").agg(F.collect_set("start").alias("starts"))
    others = [c for c in docs.columns if c != text_col]
    both = keyed.select(
        F.col(row_id).alias("row_id"), F.col(row_hash).alias("row_hash"), F.col(text_col).alias("body"),
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("others")).join(marked, ["row_id", "row_hash"], "left")
    kind = both.schema["others"].dataType.simpleString()
    return both.select("others", "body", "starts") \
        .mapInArrow(_clean(size), f"others {kind}, body string, n_removed long").select(
        *[F.col("body").alias(c) if c == text_col else F.col(f"others.`{c}`").alias(c) for c in docs.columns],
        F.col("n_removed").alias(removed))
