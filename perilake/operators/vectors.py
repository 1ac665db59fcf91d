"""Text vectors and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, CountVectorizerModel, SQLTransformer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window, functions as F, types as T

from perilake.session import shared_root

HASH_DIGITS = 3
SLOTS = 16**HASH_DIGITS
DIM = 64
# Questions are broadcast up to this many bytes of vectors, see knn().
BROADCAST_BYTES = 64 << 20
QUESTION_BLOCK = 2_000
CORPUS_BLOCK = 50_000
PAIRS_AT_ONCE = 4_000_000
DISTANCE_DIGITS = 9
# Distinct words of a batch that are hashed at a time.
WORDS_AT_ONCE = 1 << 16


def _split(col: str) -> str:
    return f"split(lower({col}), '[^\\\\p{{L}}\\\\p{{N}}]+')"


def _words(col: str) -> str:
    return f"transform(filter({_split(col)}, w -> w <> ''), w -> substr(md5(w), 1, {HASH_DIGITS}))"


def slots_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and slot of each word of a batch of split texts, as ``_words`` gives them.

    Each distinct word of the batch is hashed once, in pieces of bounded size.
    """
    words = texts.flatten().cast(pa.large_binary()).dictionary_encode()
    slot = np.full(len(words.dictionary), -1)
    for start in range(0, len(slot), WORDS_AT_ONCE):
        some = words.dictionary.slice(start, WORDS_AT_ONCE).to_pylist()
        slot[start:start + len(some)] = [int(md5(w).hexdigest()[:HASH_DIGITS], 16) if w else -1 for w in some]
    slots = slot[words.indices.to_numpy()]
    at = np.repeat(np.arange(len(texts)), texts.value_lengths().to_numpy(zero_copy_only=False))
    return at[slots >= 0], slots[slots >= 0]


def present_slots(corpus: DataFrame, col: str) -> DataFrame:
    """One row per text: ``_counts``, a sparse vector with a 1 for each slot that the text has."""
    names = ("type", "size", "indices", "values")

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            at, slots = slots_of(batch.column(0))
            # One flag per text and slot: 41 MB for Spark's 10,000 rows a batch.
            seen = np.zeros(n * SLOTS, bool)
            seen[at * SLOTS + slots] = True
            at, slots = np.divmod(np.flatnonzero(seen), SLOTS)
            ends = pa.array(np.searchsorted(at, np.arange(n + 1)).astype(np.int32))
            parts = (pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, SLOTS, np.int32)),
                     pa.ListArray.from_arrays(ends, pa.array(slots.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(np.ones(len(slots)))))
            fields = [pa.field(f, p.type, f != "type") for f, p in zip(names, parts)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(parts, fields=fields)], names=["_counts"])

    kind = T.StructType([T.StructField("_counts", VectorUDT())])
    return corpus.select(F.expr(f"coalesce({_split(col)}, array())")).mapInArrow(run, kind)


def fit_embedder(corpus: DataFrame, col: str = "text") -> PipelineModel:
    """Term weights of a corpus: words hashed to slots, slots weighted by rarity.

    Counting is map-only; the fit aggregates one number per slot. Weights depend on which
    slots a text has, so that the fit reads those alone.
    """
    stages = [
        SQLTransformer(statement=f"SELECT *, coalesce({_words(col)}, array()) AS _terms FROM __THIS__"),
        CountVectorizerModel.from_vocabulary(
            [format(i, f"0{HASH_DIGITS}x") for i in range(SLOTS)], inputCol="_terms", outputCol="_counts"
        ),
    ]
    idf = IDF(inputCol="_counts", outputCol="_weights").fit(present_slots(corpus, col))
    return PipelineModel([*stages, idf])


def fold(rows: np.ndarray, slots: np.ndarray, n: int, weights: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors of ``n`` texts from one (row, slot) pair per word; its cost is that of the words.

    A slot adds its weight, times its count in the text, to one position; signs
    alternate, so that words sharing a position do not simply add up.
    """
    cells, counts = np.unique(rows * len(weights) + slots, return_counts=True)
    row, slot = np.divmod(cells, len(weights))
    sign = np.where(slot // dim % 2 == 0, 1.0, -1.0)
    out = np.bincount(row * dim + slot % dim, counts * weights[slot] * sign, n * dim).reshape(n, dim)
    norm = np.sqrt(np.add.reduce(out.T**2, axis=0))
    return out / np.where(norm == 0, 1.0, norm)[:, None]


def embed_text(
    df: DataFrame, embedder: PipelineModel, dim: int = DIM, name: str = "embedding", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add a unit vector of ``dim`` floats; text without known words gives zeros.

    Texts are split in the JVM; an Arrow batch of words is hashed and folded at once. No
    row leaves its task. Only the columns ``keep`` come along, all where it is not given.
    """
    source = embedder.stages[0].getStatement()
    words = source[source.index("split("):source.index(", w -> w <> ''")]
    # SLOTS numbers, whatever the corpus.
    weights = df.sparkSession.sparkContext.broadcast(embedder.stages[-1].idf.toArray())
    keep = df.columns if keep is None else list(keep)
    held = [f"_k{i}" for i in range(len(keep))]
    rows = df.select(*keep, F.expr(f"coalesce({words}, array())").alias("_words")).toDF(*held, "_words")

    def run(batches):
        for batch in batches:
            out = fold(*slots_of(batch.column("_words")), batch.num_rows, weights.value, dim).astype(np.float32)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(h) for h in held), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=[*held, "_v"])

    kinds = ", ".join(f"{h} {t}" for h, (_, t) in zip(held, df.select(*keep).dtypes))
    return rows.mapInArrow(run, f"{kinds}, _v array<float>").toDF(*keep, name)


# --- nearest neighbours ------------------------------------------------------


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1 if rows else 0)


def _ids(column) -> np.ndarray:
    ids = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return ids.astype(str) if ids.dtype == object else ids


def _keep_best(which, ids, dist, k):
    """The k smallest (distance, id) of each question."""
    order = np.lexsort((ids, dist, which))
    which, ids, dist = which[order], ids[order], dist[order]
    starts = np.r_[True, which[1:] != which[:-1]] if len(which) else np.zeros(0, bool)
    place = np.arange(len(which)) - np.maximum.accumulate(np.where(starts, np.arange(len(which)), 0))
    kept = place < k
    return which[kept], ids[kept], dist[kept]


def _nearest(questions: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """Exact squared distances of the k nearest rows per question.

    A matrix product proposes every row that could be among the k nearest,
    rounding error included; those are measured term by term.
    """
    q2, v2 = (questions**2).sum(axis=1), (vectors**2).sum(axis=1)
    near = q2[:, None] + v2[None, :] - 2.0 * questions @ vectors.T
    if len(ids) > k:
        slack = 4 * 10.0**-DISTANCE_DIGITS + 1e-12 * (q2.max(initial=0) + v2.max(initial=0))
        limit = np.partition(near, k - 1, axis=1)[:, k - 1] + slack
        which, row = np.nonzero(near <= limit[:, None])
    else:
        which, row = np.nonzero(np.ones_like(near, dtype=bool))
    dist = np.zeros(len(which))
    for j in range(questions.shape[1]):
        dist += (questions[which, j] - vectors[row, j]) ** 2
    scale = 10.0**DISTANCE_DIGITS
    return _keep_best(which, ids[row], np.floor(dist * scale + 0.5) / scale, k)


def _search(questions: np.ndarray, blocks, k: int):
    """Running k best over blocks of (ids, vectors); memory stays bounded."""
    best = None
    step = max(k, PAIRS_AT_ONCE // max(1, len(questions)))
    for ids, vectors in blocks:
        for at in range(0, len(ids), step):
            found = _nearest(questions, vectors[at : at + step], ids[at : at + step], k)
            if best is not None:
                found = tuple(np.concatenate(pair) for pair in zip(best, found))
            best = _keep_best(*found, k)
    return best


def _hits(best, question_ids: np.ndarray, schema: pa.Schema) -> pa.Table:
    which, ids, dist = best if best is not None else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    columns = [pa.array(question_ids[which].tolist(), schema.types[0]), pa.array(ids.tolist(), schema.types[1])]
    return pa.Table.from_arrays([*columns, pa.array(dist, pa.float64())], schema=schema)


def knn(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = 6,
    question_id: str = "question_id",
    corpus_id: str = "chunk_id",
    vector: str = "embedding",
) -> DataFrame:
    """Exact k nearest corpus rows per question by squared L2 distance.

    Result rows are (question id, corpus id, rank, distance); equal distances
    are ordered by corpus id. Rows without an id or a vector take no part. Questions are measured first: if their vectors fit
    in BROADCAST_BYTES they are broadcast and the corpus is read in place, else
    the search runs over a grid of blocks (knn_grid).
    """
    shared_root(questions.sparkSession)
    known = questions.where(F.col(vector).isNotNull() & F.col(question_id).isNotNull()).select(question_id, vector).checkpoint()
    size = known.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vector)).alias("dim")).first()
    if size["rows"] * (size["dim"] or 0) * 8 > BROADCAST_BYTES:
        return knn_grid(known, corpus, k, question_id, corpus_id, vector)

    small = known.toArrow()
    shared = questions.sparkSession.sparkContext.broadcast(
        (_ids(small.column(0)), _matrix(small.column(1))) if small.num_rows else None
    )
    schema, fields = _hit_schema(questions, corpus, question_id, corpus_id)

    def scan(batches):
        if shared.value is None:
            return
        names, matrix = shared.value
        blocks = ((_ids(b.column(0)), _matrix(b.column(1))) for b in batches if b.num_rows)
        yield from _hits(_search(matrix, blocks, k), names, fields).to_batches()

    rows = corpus.where(F.col(vector).isNotNull() & F.col(corpus_id).isNotNull()).select(corpus_id, vector)
    return _ranked(rows.mapInArrow(scan, schema), question_id, corpus_id, k)


def knn_grid(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = 6,
    question_id: str = "question_id",
    corpus_id: str = "chunk_id",
    vector: str = "embedding",
    question_block: int = QUESTION_BLOCK,
    corpus_block: int = CORPUS_BLOCK,
) -> DataFrame:
    """The same result for question sets too large to broadcast.

    Both sides are hashed into blocks of bounded size; every pair of blocks is
    one small task that returns at most k rows per question. All questions meet
    all corpus rows, so the result is exact.
    """
    asked = questions.where(F.col(vector).isNotNull() & F.col(question_id).isNotNull()).select(question_id, vector)
    known = corpus.where(F.col(vector).isNotNull() & F.col(corpus_id).isNotNull()).select(corpus_id, vector)
    q_blocks = max(1, ceil(asked.count() / question_block))
    c_blocks = max(1, ceil(known.count() / corpus_block))
    schema, fields = _hit_schema(questions, corpus, question_id, corpus_id)

    def spread(df, own, own_name, blocks, other_name, others):
        place = F.pmod(F.xxhash64(own), F.lit(blocks)).cast("int").alias(own_name)
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other_name)
        return df.select("*", place, every).groupBy("_q", "_c")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return fields.empty_table()
        block = [(_ids(right.column(corpus_id)), _matrix(right.column(vector)))]
        best = _search(_matrix(left.column(vector)), block, k)
        return _hits(best, _ids(left.column(question_id)), fields)

    left = spread(asked, question_id, "_q", q_blocks, "_c", c_blocks)
    right = spread(known, corpus_id, "_c", c_blocks, "_q", q_blocks)
    return _ranked(left.cogroup(right).applyInArrow(search, schema), question_id, corpus_id, k)


def _hit_schema(questions, corpus, question_id, corpus_id):
    kinds = [questions.schema[question_id].dataType.simpleString(), corpus.schema[corpus_id].dataType.simpleString()]
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    fields = pa.schema([(question_id, arrow[kinds[0]]), (corpus_id, arrow[kinds[1]]), ("distance", pa.float64())])
    return f"{question_id} {kinds[0]}, {corpus_id} {kinds[1]}, distance double", fields


def _ranked(found: DataFrame, question_id: str, corpus_id: str, k: int) -> DataFrame:
    order = Window.partitionBy(question_id).orderBy("distance", corpus_id)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(question_id, corpus_id, "rank", "distance")
