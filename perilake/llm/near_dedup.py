"""Near duplicates: a multi-index Hamming join of b-bit MinHash signatures.

A signature has 60 symbols of 16 bits, one per hash function. It is split into 12
chunks of 5 symbols. By the pigeonhole principle, two signatures that differ in at
most 23 symbols have a chunk with at most one differing symbol, so looking up every
chunk with each one of its symbols left out (60 keys of 4 symbols) finds all of them.
At a Jaccard similarity of 0.8 a pair has no such chunk with probability 1e-7.

1. Documents with equal shingle sets form a class; one of them stands for it.
2. Keys of the classes are counted by a partial and a final aggregate; each member of a
   bucket is paired with one leader only, that with the most company over all its keys
   (in a group of edited copies, one that is close to the original).
3. These pairs are confirmed on full shingle sets, in streams that hold one leader's
   set at a time, and give first components.
4. Only pairs of one bucket from different components can still matter. Buckets that
   hold several components are compared on their signatures in square blocks of
   bounded size. First each member is confirmed against its nearest one of another
   component; then, in the buckets that still hold several, all pairs whose signatures
   (60 symbols) are near are. Pairs that are already connected need no check, so
   groups of copies aren't expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.llm.batches import byte_rows, hashed_words, mix, pieces, shingle_set
from perilake.llm.components import components
from perilake.llm.shared import cut

U = np.uint64
SYMBOLS, CHUNKS = 60, 12
WIDTH = SYMBOLS // CHUNKS
#: Symbols that may differ for a pair from a bucket to be confirmed on full sets. At a
#: similarity of 0.8 a pair differs in more with probability 5e-8.
LOOSE = 30
#: Bits of a parity.
BITS = 1024
#: Rows of a block, and rows that share one copy of a leader's text.
BLOCK, LEADER_ROWS = 1000, 2000
#: Bytes of ids up to which they are sent to all tasks.
BROADCAST_BYTES = 32 << 20
NULL_ID = -(1 << 63)

_draw = np.random.Generator(np.random.PCG64(7))
TURNS = _draw.integers(0, 1 << 64, SYMBOLS, dtype=U)
FACTORS = _draw.integers(0, 1 << 64, SYMBOLS, dtype=U) | U(1)
TAGS = _draw.integers(0, 1 << 64, (CHUNKS, WIDTH), dtype=U)


def signature(shingles: np.ndarray) -> bytes:
    """16 bits of the smallest hash of a set under each hash function, then its parity."""
    low = np.full(SYMBOLS, np.iinfo(U).max, U)
    for at in range(0, len(shingles), 2048):
        part = shingles[None, at:at + 2048]
        np.minimum(low, ((part ^ TURNS[:, None]) * FACTORS[:, None]).min(1), out=low)
    flips = np.bincount((shingles >> U(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return (mix(low) & U(0xFFFF)).astype(np.uint16).tobytes() + np.packbits(flips.astype(np.uint8)).tobytes()


def unpacked(signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols and parities of rows of signatures."""
    rows = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), 2 * SYMBOLS + BITS // 8)
    symbols, parities = rows[:, :2 * SYMBOLS], rows[:, 2 * SYMBOLS:]
    return np.ascontiguousarray(symbols).view(np.uint16), np.ascontiguousarray(parities).view(U)


def parity_limit(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Bits in which the parities of linked sets with this sum of sizes may differ."""
    apart = sizes * (100 - percent) // (100 + percent)
    odd = (1 - (1 - 2 / BITS) ** apart) / 2
    return np.minimum(apart, BITS * odd + 6 * np.sqrt(BITS * odd * (1 - odd)) + 1)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of rows of signatures: each chunk with each of its symbols left out."""
    chunks = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(U)
    keys = []
    for left in range(WIDTH):
        kept = [i for i in range(WIDTH) if i != left]
        word = sum((chunks[:, :, i] << U(16 * k) for k, i in enumerate(kept)), np.zeros(chunks.shape[:2], U))
        keys.append(mix(word ^ TAGS[None, :, left]))
    return np.stack(keys, 2).reshape(len(signatures), SYMBOLS)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "body"):
                counts, digests, signatures = [], [], []
                for text in byte_rows(batch.column("body")):
                    found = shingle_set(hashed_words(text), size)
                    counts.append(len(found))
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    signatures.append(signature(found))
                yield pa.RecordBatch.from_pydict({
                    "row_id": batch.column("row_id"), "n_shingles": pa.array(counts, pa.int64()),
                    "digest": pa.array(digests, pa.binary()), "signature": pa.array(signatures, pa.binary())})
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 4096):
            batch = whole.slice(at, 4096)
            keys = chunk_keys(unpacked(batch.column("signature").to_pylist())[0])
            ids = np.repeat(np.asarray(batch.column("rep")), SYMBOLS)
            yield pa.RecordBatch.from_pydict({"key": keys.reshape(-1).view(np.int64), "rep": ids})


def _confirm(size: int, percent: int):
    """Rows sorted by leader with the leader's text first; yields the linked pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads = None, []
        for whole in batches:
            for batch in pieces(whole, "body"):
                a, b = [], []
                keys = zip(*(batch.column(c).to_pylist() for c in ("lead", "part", "first", "row_id")))
                for (lead, part, first, row), text in zip(keys, byte_rows(batch.column("body"))):
                    found = shingle_set(hashed_words(text), size)
                    if (lead, part) != group:
                        group, heads = (lead, part), []
                    if first == 0:
                        heads.append(found)
                    elif any(linked(found, head, percent) for head in heads):
                        a.append(row)
                        b.append(lead)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least ``percent`` hundredths of their union in common."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (rep, lead) that are linked on their full sets: a, b."""
    pairs = cut(pairs)
    parts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / LEADER_ROWS).cast("int").alias("parts"))
    ids = cut(pairs.select(F.col("rep").alias("row_id")).union(pairs.select("lead")).distinct())
    # Only texts that a pair needs are shuffled, as long as the list of their ids is small.
    known = F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids
    texts = texts.join(known, "row_id", "left_semi")
    members = pairs.join(parts, "lead").select(
        F.col("rep").alias("row_id"), "lead", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"),
        F.lit(1).alias("first"))
    heads = parts.select(
        F.col("lead").alias("row_id"), "lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("first"))
    return members.unionByName(heads).join(texts, "row_id") \
        .repartition("lead", "part").sortWithinPartitions("lead", "part", "first") \
        .mapInArrow(_confirm(size, percent), "a long, b long").distinct()


def _cross(nearest: bool, percent: int):
    """Rows sorted by cell; yields pairs of a cell from different components that may be linked.

    With ``nearest``, the nearest partner of each row outside the cell's largest component
    only. Otherwise all near pairs, each in the cell of the first key that both have.
    """
    def close(key: int, rows: list[tuple]) -> pa.RecordBatch:
        rep, comp, side, size = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        signs, parities = unpacked([r[4] for r in rows])
        keys = chunk_keys(signs).view(np.int64)
        names, counts = np.unique(comp, return_counts=True)
        largest = names[counts.argmax()]
        a, b = [], []
        for i in range(len(rows)):
            if nearest and comp[i] == largest:
                continue
            other = comp != comp[i]
            if side[0] >= 0:  # a cell of two blocks: pairs within a block have a cell of their own
                other &= side != side[i]
            if not nearest:
                other[:i] = False
            at = np.flatnonzero(other)
            far = (signs[at] != signs[i]).sum(1)
            at, far = at[far <= LOOSE], far[far <= LOOSE]
            odd = np.bitwise_count(parities[at] ^ parities[i]).sum(1)
            maybe = odd <= parity_limit(size[at] + size[i], percent)
            at, far = at[maybe], far[maybe]
            if nearest:
                at = at[far.argmin():][:1] if len(at) else at
            else:
                same = keys[at] == keys[i]
                at = at[keys[i][same.argmax(1)] == key] if len(at) else at
            a.append(np.maximum(rep[at], rep[i]))
            b.append(np.minimum(rep[at], rep[i]))
        empty = np.zeros(0, np.int64)
        return pa.RecordBatch.from_pydict({"rep": np.concatenate([empty, *a]), "lead": np.concatenate([empty, *b])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            names = ("key", "low", "high", "rep", "comp", "side", "n_shingles", "signature")
            for *now, rep, comp, side, size, sign in zip(*(batch.column(c).to_pylist() for c in names)):
                if now != cell:
                    if len(rows) > 1:
                        yield close(cell[0], rows)
                    cell, rows = now, []
                rows.append((rep, comp, side, size, sign))
        if len(rows) > 1:
            yield close(cell[0], rows)
    return run


def leader_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's leader: rep, lead."""
    company = members.groupBy("rep").agg(F.sum("n").alias("company"))
    leads = members.join(company, "rep").groupBy("key") \
        .agg(F.max(F.struct("company", F.bitwise_not("rep").alias("r"))).alias("top")) \
        .select("key", F.bitwise_not("top.r").alias("lead"))
    return members.join(leads, "key").filter("rep <> lead").select("rep", "lead").distinct()


def cross_pairs(members: DataFrame, roots: DataFrame, classes: DataFrame, nearest: bool,
                percent: int) -> DataFrame:
    """Pairs that share a bucket, lie in different components and have near signatures."""
    placed = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("key", "rep", F.coalesce("root", "rep").alias("comp"))
    open_keys = placed.groupBy("key").agg(
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).filter("c0 <> c1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cells = placed.join(open_keys.select("key", blocks.alias("blocks")), "key").withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("key", "rep", "comp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"))
    pairs = cells.join(classes.select("rep", "n_shingles", "signature"), "rep") \
        .repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "rep") \
        .mapInArrow(_cross(nearest, percent), "rep long, lead long")
    return pairs.distinct() if nearest else pairs


def _same_ids(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id but not a set."""
    filled = sets.filter("n_shingles > 0").select("row_id", "digest")
    several = filled.groupBy("row_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).filter("d0 <> d1")
    return filled.join(several.select("row_id"), "row_id").join(classes.select("digest", "rep"), "digest") \
        .select(F.col("row_id").alias("a"), F.col("rep").alias("b"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                size: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate group of every row.

    Words are runs of characters other than blank, tab, LF, VT, FF and CR, after
    lower-casing A-Z. A document's set holds its distinct shingles of ``size`` words;
    fewer words make one shingle. Two documents are linked when they share at least
    ``percent`` hundredths of the union of their sets.

    Returns one row per input row: the id, ``n_shingles``, ``component_id`` (smallest
    id reachable over links) and ``kept`` (whether that is the row's own id).

    A null text and one without words have an empty set, which is linked with nothing.
    Rows that share an id are one document that has all their texts; rows without an
    id count as one such document, below all others, shown as null. An empty table gives
    an empty result; other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("row_id"),
                        F.col(text_col).alias("body"))
    sets = cut(texts.mapInArrow(_sets(size), "row_id long, n_shingles long, digest binary, signature binary"))
    classes = cut(sets.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("row_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature")))
    keys = classes.mapInArrow(_keys, "key long, rep long")
    buckets = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut(keys.join(buckets, "key"))

    edges = cut(confirmed(leader_pairs(members), texts, size, percent).unionByName(_same_ids(sets, classes)))
    roots = components(edges)
    for nearest in (True, False):
        more = cut(cross_pairs(members, roots, classes, nearest, percent))
        if more.isEmpty():
            break
        # Components so far are kept as edges to their smallest node.
        known = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(known.unionByName(confirmed(more, texts, size, percent)))

    ids = classes.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("digest", F.coalesce("root", "rep").alias("component"))
    found = sets.select("row_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")) \
        .join(ids, "digest", "left").withColumn("component", F.coalesce("component", "row_id"))
    named = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return found.select(named("row_id").alias(id_col), "n_shingles", named("component").alias("component_id"),
                        (F.col("row_id") == F.col("component")).alias("kept"))
