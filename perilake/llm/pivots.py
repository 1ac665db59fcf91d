"""Exact top-k search by inner product with a pivot table.

Every vector's distances to a set of pivots are computed once. By the triangle
inequality, the largest difference of two vectors' distances to one pivot is a lower
bound of their distance, and with both lengths an upper bound of their inner product.
A query's candidates are evaluated in the order of these bounds until the next bound is
below the k-th best score; none that could still count is left out.

Queries go out in blocks of bounded bytes, each block against all rows in place, so the
rows are shuffled once however many queries there are. A task keeps k results for each
query of the block. In directions without structure the bounds exclude little, and
nearly all candidates are evaluated; results don't depend on that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilake.llm.shared import cut, fresh_path

PIVOTS, SAMPLE, STEP = 32, 1000, 256
BLOCK_BYTES = 16 << 20
#: Whole numbers below this are exact as doubles.
EXACT = 1 << 53
LONG, WIDE = (1 << 63) - 1, 10**38 - 1


def whole_vectors(rows: DataFrame, vector_col: str, scale: int = 256) -> Column:
    """The floor of ``scale`` times each entry as longs; null where an entry is null, not finite, or 2^61 or more."""
    x = F.transform(F.col(vector_col), lambda c: F.lit(float(scale)) * c.cast("double"))
    good = F.forall(x, lambda c: F.coalesce(F.abs(c) < float(1 << 61), F.lit(False)))
    # A product that is not a number fails the comparison as well: Spark orders it above all numbers.
    return F.when(good, F.transform(x, lambda c: F.floor(c).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros."""
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots, from differences, so that equal vectors have exactly equal ones."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        gap = x.astype(float) - p
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def choose_pivots(table: DataFrame, n: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Up to ``n`` vectors far from each other, out of the ``sample`` distinct ones of the least hash."""
    drawn = table.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(sample).toArrow().column("x").combine_chunks()
    if not len(drawn):
        return np.zeros((0, 0), np.int64)
    x = _matrix(drawn, max(int(np.max(drawn.value_lengths())), 1))
    chosen = [0]
    far = _distances(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def pivot_table(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256, pivots: int = PIVOTS) -> tuple[DataFrame, int]:
    """Rows (row, id, x, near) and their width: ``x`` the whole-number vector, ``near`` its distances to the pivots.

    Written once; ``row`` numbers the rows, repeated ones too.
    """
    x = whole_vectors(rows, vector_col, scale)
    known = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter("id IS NOT NULL AND x IS NOT NULL")
    # The search is work on each row many times over, so rows are dealt over all cores whatever files they lie in.
    parts = max(known.rdd.getNumPartitions(), 2 * known.sparkSession.sparkContext.defaultParallelism)
    known = cut(known.repartition(parts).withColumn("row", F.monotonically_increasing_id()))
    width = max(known.agg(F.max(F.size("x")).alias("n")).first().n or 0, 1)
    chosen = choose_pivots(known, pivots)
    shared = known.sparkSession.sparkContext.broadcast(np.pad(chosen, ((0, 0), (0, width - chosen.shape[1]))))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _distances(_matrix(batch.column("x"), width), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.FixedSizeListArray.from_arrays(near.ravel(), near.shape[1]).cast(pa.list_(pa.float64()))],
                names=[*batch.schema.names, "near"])

    path = fresh_path(known.sparkSession, "pivots")
    known.mapInArrow(measure, "id long, x array<bigint>, row long, near array<double>").write.parquet(path)
    return known.sparkSession.read.parquet(path), width


class Block:
    """Rows of a batch with their lengths and pivot distances."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, width: int):
        columns = {n: batch.column(n) for n in ("row", "id", "x", "near")}
        columns = {n: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for n, c in columns.items()}
        self.row, self.id = columns["row"].to_numpy(), columns["id"].to_numpy()
        self.x = _matrix(columns["x"], width)
        near = columns["near"]
        self.near = near.flatten().to_numpy().reshape(len(near), -1)
        self.most = float(np.abs(self.x).astype(float).max(initial=0))
        self.points = self.x.astype(float)
        self.square = np.einsum("ij,ij->i", self.points, self.points)


def _scores(rows: Block, picked: np.ndarray, query: Block, i: int) -> np.ndarray:
    """Exact inner products; whole numbers of any size where doubles would not be exact."""
    if rows.most * query.most * max(query.x.shape[1], 1) < EXACT:
        return (rows.points[picked] @ query.points[i]).astype(np.int64)
    return rows.x[picked].astype(object) @ query.x[i].astype(object)


def upper_bounds(rows: Block, query: Block, i: int) -> np.ndarray:
    """No inner product of query ``i`` with a row is above its bound; rounding is allowed for."""
    apart = np.zeros(len(rows.id))
    for j in range(rows.near.shape[1]):
        np.maximum(apart, np.abs(rows.near[:, j] - query.near[i, j]), out=apart)
    lengths = rows.square + query.square[i]
    return (lengths - apart * apart) / 2 + 1e-9 * lengths + 1


def _better(score, ids, row, k: int):
    """The k best by score, then id, then row."""
    order = sorted(range(len(score)), key=lambda j: (-score[j], ids[j], row[j]))[:k]
    return [score[j] for j in order], [ids[j] for j in order], [row[j] for j in order]


def search_block(rows: Block, query: Block, best: list, k: int) -> int:
    """Take the rows of a block into the k best of each query, in the order of their bounds; how many were evaluated."""
    counted = 0
    for i in range(len(query.id)):
        bound = upper_bounds(rows, query, i)
        score, ids, row = best[i]
        # Equal scores go by id, so only a bound below the k-th score excludes a row.
        open_ = np.flatnonzero(bound >= float(score[-1])) if len(score) == k else np.arange(len(bound))
        order = open_[np.argsort(-bound[open_], kind="stable")]
        at, step = 0, STEP
        while at < len(order) and (len(score) < k or bound[order[at]] >= float(score[-1])):
            picked = order[at:at + step]
            picked = picked[rows.row[picked] != query.row[i]]
            counted += len(picked)
            found = _scores(rows, picked, query, i)
            if len(score) == k:
                kept = found >= score[-1]
                picked, found = picked[kept], found[kept]
            if len(found) > k:
                least = np.partition(found, len(found) - k)[len(found) - k] if found.dtype != object else sorted(found)[-k]
                picked, found = picked[found >= least], found[found >= least]
            score, ids, row = _better(score + found.tolist(), ids + rows.id[picked].tolist(), row + rows.row[picked].tolist(), k)
            at, step = at + step, step * 2
        best[i] = score, ids, row
    return counted


def search(table: DataFrame, width: int, queries: DataFrame, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best rows of ``table`` for each row of ``queries``: query_row, query_id, rank, vec_id, score.

    Both are pivot tables of one ``pivot_table`` call. Each block of queries is
    broadcast, about ``block_bytes`` of vectors and distances, and its results are
    written before the next block is sent.
    """
    spark = table.sparkSession
    bytes_each = 8 * (width + PIVOTS + 2)
    asked = queries.count()
    if not asked:
        return spark.createDataFrame([], "query_row long, query_id long, rank int, vec_id long, score long")
    n_blocks = -(-asked * bytes_each // block_bytes)
    # Blocks are ranges of the row number's hash, each read by one filtered scan.
    place = F.pmod(F.xxhash64("row"), F.lit(n_blocks))
    path = fresh_path(spark, "topk")
    for number in range(n_blocks):
        part = queries.filter(place == number).toArrow()
        if not part.num_rows:
            continue
        shared = spark.sparkContext.broadcast(part)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query = Block(shared.value, width)
            best = [([], [], []) for _ in query.id]
            for batch in batches:
                if batch.num_rows:
                    search_block(Block(batch, width), query, best, k)
            out = [(int(query.row[i]), int(query.id[i]), r, v, max(-LONG - 1, min(LONG, s)), str(max(-WIDE, min(WIDE, s))))
                   for i, b in enumerate(best) for s, v, r in zip(*b)]
            names = ["query_row", "query_id", "row", "vec_id", "score", "exact"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[j] for o in out], pa.int64() if j < 5 else pa.string()) for j in range(6)], names=names)

        fields = "query_row long, query_id long, row long, vec_id long, score long, exact string"
        found = table.mapInArrow(scan, fields).withColumn("exact", F.col("exact").cast("decimal(38,0)"))
        # Each task sends at most k rows for a query.
        order = Window.partitionBy("query_row").orderBy(F.desc("exact"), "vec_id", "row")
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
            .select("query_row", "query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.parquet(path)


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5,
          scale: int = 256, pivots: int = PIVOTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k rows of the largest inner product for each row whose id is divisible by ``every``.

    Result: query_id, rank (from 1), vec_id, score; ties go to the smaller id. Entries are
    the floor of ``scale`` times the given ones. A row without an id, or whose vector is
    null, holds a null or an entry that is not finite or that becomes 2^61 or more, takes no part; an
    empty vector scores 0, and a shorter vector counts as ended by zeros. Repeated rows are
    rows of their own, as queries and as candidates. Scores beyond a long are held at its
    end, but ranked by their value (beyond 38 digits as equal). An empty table gives an empty result. Other columns
    are not read, whatever their names.
    """
    table, width = pivot_table(rows, id_col, vector_col, scale, pivots)
    queries = table.filter(F.col("id") % every == 0)
    return search(table, width, queries, k, block_bytes).select("query_id", "rank", "vec_id", "score")
