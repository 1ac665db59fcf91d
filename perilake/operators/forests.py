"""Random forests of many rows, grown level by level from counts per node, feature and bin.

Spark's trainer keeps draws and nodes of all trees with every row, and updates the
statistics of all trees row by row. Here a row is one byte per feature, rows lie in
blocks, and a task goes through its blocks tree by tree, so that it holds the counts of
one tree, which fit the processor's cache. Draws come from a generator seeded by block
and tree and nodes from walking the tree, so nothing is stored per row and tree. Counts
meet by tree, where splits are chosen; the driver gets splits only, as many as nodes.

Trees follow the rules of Spark's trainer: draws from Poisson(1), the square root of the
number of features per node (all for a single tree), at most ``BINS`` bins with cuts from
a sample of ``SAMPLED`` rows, Gini gain over weighted counts, leaves of equal prediction
merged. The draws are others, so the forest is not the one that Spark grows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from perilake.session import shared_root
from perilake.sources.tables import remove

BINS = 32
#: Rows, at least, from whose values the cuts are taken, as in Spark's trainer.
SAMPLED = max(BINS * BINS, 10_000)
BLOCK_ROWS = 1 << 16
#: Rows of a task; more tasks send more counts.
TASK_ROWS = 1 << 20
#: Shares of Poisson(1), to 16 bits: the number of draws for each 16-bit number.
DRAWS = np.searchsorted(np.cumsum([exp(-1) / factorial(k) for k in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
#: Impurities up to this count as zero.
PURE = np.finfo(np.float64).eps

LEVEL = "tree int, feature array<int>, cut array<int>, gain array<double>, sides array<long>"


@dataclass
class Level:
    """Splits of one tree's nodes of one depth; ``after`` holds the places of the two children in the next level, or -1."""

    feature: np.ndarray
    cut: np.ndarray
    after: np.ndarray


def midpoints(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts between the distinct values, at most ``bins`` - 1 that part the weight evenly."""
    value, which = np.unique(values, return_inverse=True)
    between = (value[:-1] + value[1:]) / 2
    if len(between) < bins:
        return between
    upto = np.cumsum(np.bincount(which, weights))
    stride = upto[-1] / bins
    cuts, target = [], stride
    for i in range(1, len(value)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            cuts.append(between[i - 1])
            target += stride
    return np.array(cuts)


def as_blocks(rows: DataFrame, cuts: Sequence[np.ndarray], n_rows: int) -> DataFrame:
    """Rows (_x, _y) as (block, bytes): per feature a run of bytes, each twice the row's bin plus its label.

    Blocks are checkpointed, as draws go by their number and place.
    """
    def run(batches):
        held, n, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = batch.column("_y").to_numpy(zero_copy_only=False).astype(np.uint8)
            held.append(np.stack([2 * np.searchsorted(c, x[:, f]).astype(np.uint8) + y for f, c in enumerate(cuts)]))
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield record(number, held)
                held, n, number = [], 0, number + 1
        if held:
            yield record(number, held)

    def record(number, held):
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([np.concatenate(held, axis=1).tobytes()], pa.binary())], names=["block", "bytes"])

    blocks = rows.select("_x", "_y").mapInArrow(run, "block long, bytes binary")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, ceil(n_rows / TASK_ROWS))
    shared_root(rows.sparkSession)
    return blocks.repartition(tasks).checkpoint()


def chosen_features(seed: int, tree: int, level: int, nodes: int, features: int, per_node: int) -> np.ndarray:
    """Features that each node of a tree's level may be split by."""
    drawn = np.random.default_rng([seed, 1, tree, level]).random((nodes, features))
    return np.argsort(drawn, axis=1)[:, :per_node]


def in_bag(seed: int, block: int, tree: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that a tree draws, and how often."""
    # The generator takes 32 bits of a number at a time.
    bits = np.random.Generator(np.random.SFC64([seed, 2, block >> 32, block & 0xFFFFFFFF, tree])).bytes(2 * n)
    draws = DRAWS.take(np.frombuffer(bits, np.uint16))
    rows = np.flatnonzero(draws > 0)
    return rows, draws.take(rows).astype(np.float64)


def counts_of(tree: Sequence[Level], codes: np.ndarray, rows: np.ndarray, draws: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Drawn rows per chosen feature, node of the level below ``tree``, bin and label."""
    n, flat = codes.shape[1], codes.ravel()
    node = np.zeros(len(rows), np.int64)
    for level in tree:
        code = flat.take((level.feature * n).take(node) + rows)
        node = level.after.take(2 * node + (code > (2 * level.cut + 1).take(node)))
        stays = node >= 0
        if not stays.all():
            node, rows, draws = node[stays], rows[stays], draws[stays]
    cells, first = 2 * BINS, node * (2 * BINS)
    out = np.empty((chosen.shape[1], len(chosen), BINS, 2), np.int64)
    for j in range(chosen.shape[1]):
        code = flat.take((chosen[:, j] * n).take(node) + rows)
        out[j] = np.bincount(first + code, draws, len(chosen) * cells).reshape(out.shape[1:])
    return out


def gini(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=-1)
    return 1.0 - ((counts / np.where(total > 0, total, 1.0)[..., None]) ** 2).sum(axis=-1)


def best_splits(counts: np.ndarray, chosen: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node the feature (-1: none gains), last bin to the left, gain, and counts left and right by label."""
    left = counts.cumsum(axis=2)
    total = left[:, :, -1:]
    left = left[:, :, :-1]
    right = total - left
    a, b, t = left * weights, right * weights, total * weights
    wa, wb, wt = a.sum(axis=-1), b.sum(axis=-1), t.sum(axis=-1)
    gain = gini(t) - (wa * gini(a) + wb * gini(b)) / np.where(wt > 0, wt, 1.0)
    gain[(left.sum(axis=-1) < 1) | (right.sum(axis=-1) < 1)] = -1.0
    nodes = np.arange(len(chosen))
    flat = gain.transpose(1, 0, 2).reshape(len(chosen), -1)
    at = flat.argmax(axis=1)
    j, cut = at // (BINS - 1), at % (BINS - 1)
    best = flat[nodes, at]
    feature = np.where(best > 0, chosen[nodes, j], -1)
    return feature, cut, best, np.concatenate([left[j, nodes, cut], right[j, nodes, cut]], axis=1)


class Tree:
    """A tree while it grows: its nodes in order of depth, and the splits by level."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.levels = weights, []
        self.feature, self.cut, self.left = (np.full(1, -1) for _ in range(3))
        self.gain, self.counts = np.full(1, -1.0), np.zeros((1, 2), np.int64)
        self.front = np.zeros(1, np.int64)

    def grow(self, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, sides: np.ndarray, last: bool) -> None:
        """Take in the splits of the nodes in front; children that may be split come in front."""
        if not self.levels:
            self.counts[0] = sides[0, :2] + sides[0, 2:]
        split = feature >= 0
        at, children = self.front[split], len(self.feature) + np.arange(2 * split.sum())
        self.feature[at], self.cut[at], self.gain[at], self.left[at] = feature[split], cut[split], gain[split], children[::2]
        counts = sides[split].reshape(-1, 2)
        self.feature, self.cut, self.left = (np.concatenate([a, np.full(len(children), -1)]) for a in (self.feature, self.cut, self.left))
        self.gain, self.counts = np.concatenate([self.gain, np.full(len(children), -1.0)]), np.concatenate([self.counts, counts])
        goes_on = (gini(counts * self.weights) > PURE) & (not last)
        after = np.full((len(feature), 2), -1)
        after[split] = np.where(goes_on, np.cumsum(goes_on) - 1, -1).reshape(-1, 2)
        self.levels.append(Level(np.where(split, feature, 0), cut, after.ravel()))
        self.front = children[goes_on]

    def table(self, number: int, cuts: Sequence[np.ndarray]) -> pa.Table:
        """The nodes as columns, where siblings that are leaves of one prediction are merged into their parent."""
        weighted = self.counts * self.weights
        prediction, left = weighted.argmax(axis=1), self.left.copy()
        for node in np.flatnonzero(left >= 0)[::-1].tolist():
            a = left[node]
            if left[a] < 0 and left[a + 1] < 0 and prediction[a] == prediction[a + 1]:
                left[node], prediction[node] = -1, prediction[a]
        kept = np.zeros(len(left), bool)
        kept[0] = True
        for node in np.flatnonzero(left >= 0).tolist():
            kept[left[node]:left[node] + 2] = kept[node]
        place, inner = np.cumsum(kept) - 1, (left >= 0)[kept]
        ids = np.flatnonzero(kept)
        first = np.where(inner, place[left[ids]], -1)
        cut = [cuts[f][c] if i else 0.0 for f, c, i in zip(self.feature[ids].tolist(), self.cut[ids].tolist(), inner.tolist())]
        return pa.table({
            "tree": np.full(len(ids), number, np.int32), "id": np.arange(len(ids), dtype=np.int32),
            "prediction": prediction[ids].astype(float), "impurity": gini(weighted[ids]), "zero": weighted[ids, 0], "one": weighted[ids, 1],
            "n": self.counts[ids].sum(axis=1), "gain": np.where(inner, self.gain[ids], -1.0), "left": first.astype(np.int32),
            "right": np.where(inner, first + 1, -1).astype(np.int32), "feature": np.where(inner, self.feature[ids], -1).astype(np.int32),
            "cut": np.array(cut), "inner": inner})


def grow_trees(
    blocks: DataFrame, features: int, weights: np.ndarray, n_trees: int, depth: int, seed: int,
) -> list[Tree]:
    """All trees, one pass over the blocks per level."""
    per_node = features if n_trees == 1 else ceil(sqrt(features))
    grown = [Tree(weights) for _ in range(n_trees)]
    sc = blocks.sparkSession.sparkContext
    for level in range(depth):
        open_ = {t: (tree.levels, len(tree.front)) for t, tree in enumerate(grown) if len(tree.front)}
        if not open_:
            break
        shared = sc.broadcast(open_)

        def count(batches):
            held = [(block, np.frombuffer(data, np.uint8).reshape(features, -1))
                    for batch in batches for block, data in zip(batch.column("block").to_pylist(), batch.column("bytes").to_pylist())]
            for t, (levels, nodes) in shared.value.items() if held else ():
                chosen = chosen_features(seed, t, level, nodes, features, per_node)
                total = 0
                for block, codes in held:
                    total = total + counts_of(levels, codes, *in_bag(seed, block, t, codes.shape[1]), chosen)
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([total.astype(np.int32).tobytes()], pa.binary())], names=["tree", "counts"])

        def choose(parts):
            t = parts.column("tree")[0].as_py()
            nodes = shared.value[t][1]
            total = sum(np.frombuffer(p, np.int32).astype(np.int64) for p in parts.column("counts").to_pylist())
            chosen = chosen_features(seed, t, level, nodes, features, per_node)
            *splits, sides = best_splits(total.reshape(per_node, nodes, BINS, 2), chosen, weights)
            return pa.table([pa.array([c], kind) for c, kind in zip(
                (t, *splits, sides.ravel()), (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int64())))],
                names=["tree", "feature", "cut", "gain", "sides"])

        found = blocks.mapInArrow(count, "tree int, counts binary").groupBy("tree").applyInArrow(choose, LEVEL).toArrow()
        for t, *splits, sides in zip(*(found.column(c) for c in found.column_names)):
            grown[t.as_py()].grow(*(s.values.to_numpy() for s in splits), sides.values.to_numpy().reshape(-1, 4), level == depth - 1)
        shared.unpersist()
    return grown


def known_rows(rows: DataFrame, trainer) -> DataFrame:
    """Features and labels by the columns of a trainer, as (_x, _y); labels other than 0 and 1 are an error."""
    label = F.col(trainer.getLabelCol()).cast("double")
    known = F.when(label.isin(0.0, 1.0), label).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("double"))
    return rows.select(vector_to_array(trainer.getFeaturesCol()).alias("_x"), known.alias("_y"))


def sampled_cuts(rows: DataFrame, n_rows: int, seed: int, weights: np.ndarray) -> list[np.ndarray]:
    """The cuts of each feature, from a sample of rows (_x, _y)."""
    sample = rows.sample(min(1.0, SAMPLED / n_rows), seed) if n_rows > SAMPLED else rows
    sample = sample.toArrow()
    y = sample.column("_y").to_numpy()
    x = sample.column("_x").combine_chunks().values.to_numpy().reshape(len(y), -1)
    return [midpoints(column, weights[y.astype(int)]) for column in x.T]


def fit(
    rows: DataFrame, forest: RandomForestClassifier, n_rows: int, weights: tuple[float, float],
) -> RandomForestClassificationModel:
    """A model of ``forest``'s settings for rows with its columns of features and labels 0 and 1.

    ``weights`` are those of the two classes. Of the settings, the number of trees, depth
    and seed may differ from Spark's defaults.
    """
    spark, weights = rows.sparkSession, np.array(weights)
    rows = known_rows(rows, forest)
    cuts = sampled_cuts(rows, n_rows, forest.getSeed(), weights)
    blocks = as_blocks(rows, cuts, n_rows)
    grown = grow_trees(blocks, len(cuts), weights, forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed())
    nodes = pa.concat_tables([tree.table(t, cuts) for t, tree in enumerate(grown)])
    return as_model(spark.createDataFrame(nodes), forest, len(cuts))


def as_model(nodes: DataFrame, forest: RandomForestClassifier, features: int) -> RandomForestClassificationModel:
    """Nodes as a model of the library, through its saved form: that of a model of two rows, with other nodes."""
    spark = nodes.sparkSession
    two = spark.createDataFrame(
        [(Vectors.dense([0.0] * features), float(y), 1.0) for y in (0, 1)], [forest.getFeaturesCol(), forest.getLabelCol(), forest.getWeightCol()])
    path = f"{shared_root(spark)}/forests/{uuid.uuid4().hex}"
    forest.fit(two).write().save(path)
    kinds = spark.read.parquet(f"{path}/data").schema
    cuts = F.when(F.col("inner"), F.array("cut")).otherwise(F.array().cast("array<double>"))
    data = F.struct(
        "id", "prediction", "impurity", F.array("zero", "one").alias("impurityStats"), F.col("n").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        F.struct(F.col("feature").alias("featureIndex"), cuts.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split"))
    stored = nodes.select(F.col("tree").alias("treeID"), data.alias("nodeData"))
    stored.select(*[F.col(f.name).cast(f.dataType) for f in kinds]).write.mode("overwrite").parquet(f"{path}/data")
    model = RandomForestClassificationModel.load(path)
    remove(spark, path)
    return model
