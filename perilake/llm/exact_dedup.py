"""Exact duplicates by composable polynomial fingerprints, confirmed on the texts.

The fingerprint of a text is a polynomial over its bytes modulo two primes of 31
bits. Chunks are hashed side by side, as the rows of one matrix product, and joined by

    fingerprint(left + right) = fingerprint(left) * base ** len(right) + fingerprint(right)

so a text of any length needs one chunk's powers only. Fingerprints, not texts, are
grouped over the whole corpus. Only rows whose fingerprint and length occur again are
shuffled with their text; each then meets one text of its group and is compared with
it chunk by chunk in a stream. Rows that differ (a collision) go through another round
with another base, so the result never rests on a hash.

A hot group is dealt over as many partitions as its row count asks for, each with its
own copy of the group's text. No task holds more than one text besides its batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.llm.batches import arrow_schema, byte_rows, pieces
from perilake.llm.shared import cut

PRIMES = (2147483647, 2147483629)
#: Bytes of a chunk: 255 * 2**31 * 4096 < 2**53, so double precision sums are exact.
CHUNK = 4096
#: Rows of one group that a task compares with its copy of the group's text.
GROUP_ROWS = 2000


class Polynomial:
    """Fingerprints modulo two primes; ``round_no`` chooses the bases."""

    def __init__(self, primes: tuple[int, int] = PRIMES, round_no: int = 0, chunk: int = CHUNK):
        self.primes, self.chunk = np.array(primes, np.int64), chunk
        self.bases = [int.from_bytes(hashlib.sha256(f"{round_no}/{i}".encode()).digest()[:8], "big") % (p - 2) + 2
                      if p > 2 else 1 for i, p in enumerate(primes)]
        up = [[pow(b, chunk - 1 - i, p) for i in range(chunk)] for b, p in zip(self.bases, primes)]
        self.table = np.array(up, np.float64).T
        self.shifts = [np.ones(2, np.int64)]
        self.step = np.array([pow(b, chunk, p) for b, p in zip(self.bases, primes)], np.int64)

    def of(self, data: bytes) -> tuple[int, int]:
        n = len(data)
        k = max(1, -(-n // self.chunk))
        rows = np.zeros(k * self.chunk)
        rows[k * self.chunk - n:] = np.frombuffer(data, np.uint8)
        parts = ((rows.reshape(k, self.chunk) @ self.table) % self.primes).astype(np.int64)
        while len(self.shifts) < k:
            self.shifts.append(self.shifts[-1] * self.step % self.primes)
        shifts = np.array(self.shifts[k - 1::-1] if k < len(self.shifts) else self.shifts[::-1])
        a, b = (parts * shifts % self.primes).sum(0) % self.primes
        return int(a), int(b)

    def join(self, left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
        """Fingerprint of two texts put together, from theirs and the second one's length."""
        return tuple((x * pow(b, right_bytes, int(p)) + y) % int(p)
                     for x, y, b, p in zip(left, right, self.bases, self.primes))


def _print_rows(poly: Polynomial, text_col: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text_col):
                lowered = [x.lower() for x in byte_rows(batch.column(text_col))]
                prints = [poly.of(x) for x in lowered]
                out = {
                    "row_id": batch.column("row_id"),
                    "print": pa.array([(a << 31) | b for a, b in prints], pa.int64()),
                    "n_bytes": pa.array([len(x) for x in lowered], pa.int64()),
                }
                if keep_text:
                    out["body"] = pa.array(lowered, pa.binary())
                else:
                    out["text_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in lowered])
                yield pa.RecordBatch.from_pydict(out)
    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group with the group's text first; yields the rows that differ from it."""
    group, text = None, b""
    for whole in batches:
        for batch in pieces(whole, "body"):
            odd = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("print", "n_bytes", "part", "first")))
            for i, ((*key, first), body) in enumerate(zip(keys, batch.column("body"))):
                body = memoryview(body.as_buffer()).cast("B")
                if first == 0:
                    group, text = (group, text) if key == group else (key, bytes(body))
                elif any(body[at:at + CHUNK] != text[at:at + CHUNK] for at in range(0, len(text), CHUNK)):
                    odd.append(i)
            if odd:
                yield batch.take(pa.array(odd)).select(["row_id", "print", "n_bytes", "body"])


def _round(rows: DataFrame, poly: Polynomial) -> tuple[DataFrame, DataFrame]:
    """Groups by fingerprint, and the rows whose text is not that of their group."""
    prints = cut(rows.mapInArrow(_print_rows(poly, "body", False),
                                 "row_id long, print long, n_bytes long, text_sha256 string"))
    groups = prints.groupBy("print", "n_bytes").agg(
        F.max("row_id").alias("keep_id"), F.count("*").alias("group_size"))
    return prints, groups


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 primes: tuple[int, int] = PRIMES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The group of every row: equal texts after lower-casing A-Z only.

    Returns one row per input row: the id, ``keep_id`` (largest id of the group),
    ``group_size``, ``kept`` and ``text_sha256`` of the lower-cased text in UTF-8.

    A null text counts as empty. A null id ranks below all others; such a row is kept
    only in a group without any id, and ``keep_id`` is then null. Rows that repeat an
    id and its text are one group, and each of them that carries the kept id is kept.
    An empty table gives an empty result; other columns are not read.
    """
    null_id = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(null_id)).alias("row_id"),
                       F.col(text_col).alias("body"))
    done, round_no = [], 0
    while True:
        poly = Polynomial(primes, round_no)
        prints, groups = _round(rows, poly)
        repeated = cut(groups.filter("group_size > 1"))
        bodies = rows.mapInArrow(_print_rows(poly, "body", True),
                                 "row_id long, print long, n_bytes long, body binary")
        parts = F.ceil(F.col("group_size") / group_rows).cast("int")
        place = lambda part, first: F.struct(part.cast("int").alias("part"), F.lit(first).alias("first"))
        # Any row with the kept id can stand for the group; copies of it are compared like all others.
        heads = F.when(F.col("row_id") == F.col("keep_id"),
                       F.transform(F.sequence(F.lit(0), parts - 1), lambda p: place(p, 0)))
        own = F.array(place(F.pmod(F.xxhash64("row_id"), parts), 1))
        odd = cut(
            bodies.join(repeated, ["print", "n_bytes"])
            .select("print", "n_bytes", "row_id", "body", F.inline(F.coalesce(F.concat(own, heads), own)))
            .repartition("print", "n_bytes", "part")
            .sortWithinPartitions("print", "n_bytes", "part", "first", "row_id", "body")
            .mapInArrow(_compare, "row_id long, print long, n_bytes long, body binary"))
        if odd.isEmpty():
            done.append(prints.join(groups, ["print", "n_bytes"]))
            break
        done.append(_without(prints, odd))
        rows, round_no = odd.select("row_id", "body"), round_no + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    named = lambda c: F.nullif(F.col(c), F.lit(null_id))
    return out.select(
        named("row_id").alias(id_col), named("keep_id").alias("keep_id"), "group_size",
        ((F.col("row_id") == F.col("keep_id"))).alias("kept"), "text_sha256")


def _without(prints: DataFrame, odd: DataFrame) -> DataFrame:
    """Groups of a round without its differing rows, which later rounds settle."""
    key = ["row_id", "print", "n_bytes", "text_sha256"]
    gone = odd.select("row_id", "print", "n_bytes", F.sha2("body", 256).alias("text_sha256")) \
        .groupBy(key).agg(F.count("*").alias("n_gone"))
    left = prints.groupBy(key).agg(F.count("*").alias("n")).join(gone, key, "left_anti")
    sizes = left.groupBy("print", "n_bytes").agg(F.max("row_id").alias("keep_id"),
                                                 F.sum("n").alias("group_size"))
    return left.join(sizes, ["print", "n_bytes"]) \
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("copy", "n")
