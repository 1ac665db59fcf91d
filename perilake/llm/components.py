"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.llm.shared import cut


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of every node that has an edge: node, root.

    Expects two long columns ``a`` and ``b``. A large star links all larger
    neighbours of a node to its smallest one, a small star all smaller ones; when
    neither changes an edge, every component is a star around its smallest node.
    Neighbours are never gathered: each star is a minimum by node, joined back,
    so a node with very many edges is split by Spark like any other hot key.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = cut(e)
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.distinct())
        if (now := _state(e)) == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
