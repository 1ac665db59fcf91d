"""Texts of Arrow batches as byte arrays, and words and shingles as 64-bit hashes.

Everything here works on one batch inside a task. A word is a run of bytes other
than blank, tab, line feed, vertical tab, form feed and carriage return; in UTF-8
these bytes occur only as themselves, so words can be found without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: Bytes that are hashed at a time; bounds the working arrays of very long texts.
SLICE = 1 << 21

U = np.uint64
_draw = np.random.Generator(np.random.PCG64(20260101))
PLACES = _draw.integers(0, 1 << 64, 64, dtype=U) | U(1)
#: Words longer than this are hashed one by one, so that no loop is as long as a word.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (finaliser with two multiplications)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_rows(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null counts as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word of one text."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], ~BLANK[data], [False])).view(np.int8)))
    return edges[0::2], edges[1::2]


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Eight bytes of every word at a time, scattered between steps, so that no algebra of the places survives."""
    lo = starts[0]
    part = np.concatenate([data[lo:ends[-1]], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(part) - 7, "<u8", part.data, strides=(1,))
    at, left = starts - lo, ends - starts
    out = mix(left.astype(U) + U(0x9E3779B97F4A7C15))
    long_ones = np.flatnonzero(left > LONG_WORD)
    live = np.flatnonzero(left <= LONG_WORD)
    while len(live):
        size = np.minimum(left[live], 8)
        value = eight[at[live]] & (U(0xFFFFFFFFFFFFFFFF) >> ((8 - size) * 8).astype(U))
        out[live] = mix(mix(out[live] ^ value) + out[live])
        at[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    for i in long_ones:
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes())
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word, a few MB of text at a time."""
    if not len(starts):
        return np.zeros(0, U)
    if ends[-1] - starts[0] <= SLICE:
        return _hash_spans(data, starts, ends)
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        out.append(_hash_spans(data, starts[i:j], ends[i:j]))
        i = j
    return np.concatenate(out)


def hashed_words(text: bytes) -> np.ndarray:
    """Hashes of the words of a text after lower-casing A-Z."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    return word_hashes(data, *word_bounds(data))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.full(n, U(size))
    for i in range(size):
        total += words[i:i + n] * PLACES[i % len(PLACES)] + U(i)
    return mix(total)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles, sorted; fewer words than ``size`` make one shingle, none make none."""
    if not len(words):
        return np.zeros(0, U)
    return np.unique(windows(words, min(size, len(words))))


def arrow_schema(fields: str) -> pa.Schema:
    """Schema from ``name type`` pairs, e.g. ``"id int64, text string"``."""
    kinds = {"int64": pa.int64(), "int32": pa.int32(), "string": pa.string(), "double": pa.float64(),
             "bool": pa.bool_(), "binary": pa.binary(), "longs": pa.list_(pa.int64()), "ints": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])


def pieces(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of text at most, one row at least."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64) + 64
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
