"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of m words may occur with up to k = m * rate edits (words inserted, left
out or replaced). Split into k + 1 pieces, one piece at least must occur unchanged.
Hashes of all pieces are looked up in hashes of the word windows of each document;
around a hit, Myers' bit-parallel algorithm computes the edit distance of the whole
item to every stretch of the text, with one bit per word of the item.

Documents are read once per block of items and never shuffled. Items are a stated
query set: a block of at most ``BLOCK_BYTES`` of item text is broadcast, however many
items there are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.llm.batches import LOWER, byte_rows, pieces, windows, word_hashes
from perilake.llm.shared import largest_frame_bytes

RATE = 0.2
MIN_WORDS = 1
BLOCK_BYTES = 16 << 20
FILTER_BITS = 22

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Scripts written without blanks: Thai to Khmer, kana, Han; each character is a word of its own.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(f"[{UNSPACED}]|[^\\W_\x80-\xbf{UNSPACED}]+")


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (bytes) of the words of a text.

    A word is a run of letters and digits, lower-cased; in scripts written without
    blanks, each character is one. Texts of ASCII and accented Latin letters only are
    split and lower-cased as bytes.
    """
    data = LOWER[np.frombuffer(text, np.uint8)]
    if (data >= 0xC4).any():
        return _other_words(text)
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    data[upper] += 0x20
    inside = WORD_BYTE[data]
    # Signs of two bytes: all that start with C2, and the signs of multiplication and division.
    signs = np.concatenate([np.flatnonzero(data[:-1] == 0xC2), after[(data[after] == 0x97) | (data[after] == 0xB7)] - 1])
    inside[signs] = inside[signs + 1] = False
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    return word_hashes(data, starts, ends), starts, ends


def _other_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    plain = text.decode("utf-8", "replace")
    found = [m.span() for m in WORD.finditer(plain)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lowered = [plain[a:b].lower().encode("utf-8", "replace") for a, b in found]
    sizes = np.array([len(w) for w in lowered])
    stops = np.cumsum(sizes)
    points = np.frombuffer(plain.encode("utf-32-le", "replace"), "<u4")
    places = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64))])
    spans = places[np.array(found)]
    return word_hashes(np.frombuffer(b"".join(lowered), np.uint8), stops - sizes, stops), spans[:, 0], spans[:, 1]


def edit_ends(pattern: list[int], text: list[int]) -> list[int]:
    """Myers: for each end in ``text``, the distance of the pattern to the best stretch ending there."""
    m = len(pattern)
    where: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    full, top, distance = (1 << m) - 1, 1 << (m - 1), m
    plus, minus, out = full, 0, []
    for w in text:
        same = where.get(w, 0)
        flat = (((same & plus) + plus) ^ plus) | same | minus
        up, down = minus | (~(flat | plus) & full), plus & flat
        distance += bool(up & top) - bool(down & top)
        out.append(distance)
        up, down = up << 1, down << 1
        plus = (down | ~((same | minus) | up)) & full
        minus = up & (same | minus) & full
    return out


class Items:
    """Pieces of a block of test items, to be looked up in documents."""

    def __init__(self, rows: list[tuple[int, str]], rate: float = RATE, min_words: int = MIN_WORDS):
        self.items, found = [], defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            hashed, _, _ = words_of((text or "").encode())
            m = len(hashed)
            if m < max(1, min_words):
                continue
            budget = int(m * rate)
            cuts = [m * i // (budget + 1) for i in range(budget + 2)]
            for lo, hi in zip(cuts, cuts[1:]):
                found[hi - lo][int(windows(hashed[lo:hi], hi - lo)[0])].append((len(self.items), lo))
            self.items.append((item_id, hashed.tolist(), budget))
        self.pieces = {n: dict(p) for n, p in found.items()}
        self.filters = {}
        for n, table in self.pieces.items():
            self.filters[n] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[n][np.array(list(table), np.uint64) & np.uint64((1 << FILTER_BITS) - 1)] = True

    def _regions(self, hashed: np.ndarray) -> dict[int, list[list[int]]]:
        """For each item, stretches of words around its hits, merged where they overlap."""
        regions = defaultdict(list)
        for n, table in self.pieces.items():
            keys = windows(hashed, n)
            for at in np.flatnonzero(self.filters[n][keys & np.uint64((1 << FILTER_BITS) - 1)]):
                for item, offset in table.get(int(keys[at]), ()):
                    _, words, budget = self.items[item]
                    start = int(at) - offset - budget
                    regions[item].append([max(0, start), min(len(hashed), start + len(words) + 2 * budget)])
        for item, spans in regions.items():
            spans.sort()
            merged = [spans[0]]
            for lo, hi in spans[1:]:
                if lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            regions[item] = merged
        return regions

    def matches(self, hashed: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Item id, distance, first word and end word of each occurrence in a document."""
        out = []
        for item, spans in self._regions(hashed).items():
            item_id, words, budget = self.items[item]
            for lo, hi in spans:
                text = hashed[lo:hi].tolist()
                far = edit_ends(words, text)
                end = 0
                while end < len(far):
                    if far[end] > budget:
                        end += 1
                        continue
                    run = end
                    while run < len(far) and far[run] <= budget:
                        run += 1
                    best = min(range(end, run), key=lambda i: (far[i], i))
                    back = edit_ends(words[::-1], text[best::-1][:len(words) + budget])
                    length = min(range(len(back)), key=lambda i: (back[i], i)) + 1
                    out.append((item_id, far[best], lo + best + 1 - length, lo + best + 1))
                    end = run
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str, rate: float, min_words: int) -> Iterator[Items]:
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")) \
        .filter("t IS NOT NULL").distinct()
    n = max(1, -(-largest_frame_bytes(rows, "t") // BLOCK_BYTES))
    for k in range(n):
        yield Items([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()],
                    rate, min_words)


def _points(text: bytes, at: int) -> int:
    return int(((np.frombuffer(text, np.uint8)[:at] & 0xC0) != 0x80).sum())


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id: str = "item_id", item_text: str = "text", rate: float = RATE,
               min_words: int = MIN_WORDS) -> DataFrame:
    """Occurrences of test items in documents: id, item_id, distance, start, end.

    Start and end (exclusive) are code points of the document's text; distance counts
    edited words. Neighbouring ends within the budget are one occurrence, the nearest,
    then the first. An item of fewer than 1 / ``rate`` words has no edits to spend
    and must occur as it is; one of fewer than ``min_words`` words, or without words,
    matches nothing, and so do null or empty texts on either side. Null ids are
    carried as null. Repeated documents match each for itself, repeated items once.
    Empty tables give an empty result; other columns are not read.
    """
    spark, slim = docs.sparkSession, docs.select(F.col(id_col).cast("long").alias("row_id"),
                                                 F.col(text_col).alias("body"))
    out = None
    for block in _blocks(items, item_id, item_text, rate, min_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, "body"):
                    rows = []
                    for i, text in enumerate(byte_rows(batch.column("body"))):
                        hashed, starts, ends = words_of(text)
                        for item, far, lo, hi in shared.value.matches(hashed):
                            rows.append((i, item, far, _points(text, starts[lo]), _points(text, ends[hi - 1])))
                    cols = list(zip(*rows)) or [()] * 5
                    yield pa.RecordBatch.from_pydict({
                        id_col: batch.column("row_id").take(pa.array(cols[0], pa.int64())),
                        **{n: pa.array(c, pa.int64()) for n, c in zip(("item_id", "distance", "start", "end"), cols[1:])}})

        part = slim.mapInArrow(run, f"`{id_col}` long, item_id long, distance long, start long, end long")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", rate: float = RATE, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents in which no test item occurs, all columns unchanged, without a shuffle.

    Nulls, short items and empty tables are treated as in ``find_leaks``.
    """
    for block in _blocks(items, item_id, item_text, rate, min_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, text_col):
                    clean = [not shared.value.matches(words_of(x)[0]) for x in byte_rows(batch.column(text_col))]
                    yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
