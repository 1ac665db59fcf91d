import math

import numpy as np
from pyspark.sql import functions as F

from perilake.llm import pivots
from perilake.llm.queries import QUERIES

from conftest import SMALL, values

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every=50, k=5):
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if i is not None and v is not None and all(c is not None and math.isfinite(c) and abs(c) < 1e15 for c in v)]
    out = []
    for at, (q, x) in enumerate(good):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for j, (i, y) in enumerate(good) if j != at)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_whole_table(spark):
    rows = values(spark.read.parquet(f"{SMALL}/embeddings.parquet"), "vec_id", "embedding")
    assert sorted(values(QUERIES["op13_pivot_search"](spark, SMALL))) == brute(rows)


def test_ties_nulls_repeats_short_vectors_and_clashing_names(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(c) for c in draw.integers(-2, 3, 4)]) for i in range(300)]
    rows += [rows[0]] * 3 + [(350, rows[7][1]), (400, []), (450, [1.0]), (None, [9.0] * 4), (500, None), (501, [9.0, None]),
                             (502, [math.nan] * 4), (503, [math.inf] * 4), (504, [3e38] * 4)]
    rows += [(1000 + i, [2.0] * 4) for i in range(400)]  # many copies of one vector
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "x", "row", "near", "rank", "score"):
        df = df.withColumn(name, F.lit("a"))
    assert sorted(values(pivots.top_k(df))) == brute(rows)
    # Several blocks of queries give the same rows.
    assert sorted(values(pivots.top_k(df, pivots=3, block_bytes=1500))) == brute(rows)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [float(2**21 - i), float(2**21 + 2 * i), 1.0]) for i in range(60)]
    assert sorted(values(pivots.top_k(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_few_rows_and_none(spark):
    assert values(pivots.top_k(spark.createDataFrame([], SCHEMA))) == []
    assert values(pivots.top_k(spark.createDataFrame([(1, [1.0])], SCHEMA))) == []
    assert values(pivots.top_k(spark.createDataFrame([(50, [1.0])], SCHEMA))) == []
    assert values(pivots.top_k(spark.createDataFrame([(50, []), (1, [])], SCHEMA))) == [(50, 1, 1, 0)]
    assert values(pivots.top_k(spark.createDataFrame([(50, [1.0]), (3, [0.5])], SCHEMA))) == [(50, 1, 3, 128 * 256)]


def test_bounds_hold_and_exclude_rows_of_other_clusters(spark):
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((20, 16)) * 40
    rows = [(i, [float(c) for c in centres[i % 20] + draw.standard_normal(16)]) for i in range(2000)]
    table, width = pivots.pivot_table(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    block = pivots.Block(table.toArrow(), width)
    for i in range(0, 2000, 97):
        exact = pivots._scores(block, np.arange(2000), block, i)
        assert (pivots.upper_bounds(block, block, i) >= exact).all()
    query = pivots.Block(table.filter("id % 50 = 0").toArrow(), width)
    best = [([], [], []) for _ in query.id]
    share = pivots.search_block(block, query, best, 5) / (len(query.id) * 2000)
    assert share < 0.3, share
