"""Boosted trees of many rows, grown level by level from sums per node, feature and bin.

Spark's trainer keeps each row as objects, some hundreds of bytes, and starts from the
first round again when more rounds are wanted. Here rows lie in the blocks of ``forests``,
one byte per feature, with eight bytes per row for the output of the trees so far. A task
sums up its blocks, sums of tasks meet in a tree of tasks, and the driver chooses the splits
of one level from sums whose size is set by depth, features and bins, not by the rows. A
growth goes on from the rounds it has.

Rounds follow the rules of Spark's trainer: the first tree is fitted to the labels as -1 and
1, each further one to the residuals of the log-loss; every row is drawn by the row share,
features by their share per node; at most ``BINS`` bins with cuts from a sample, gain by
weighted variance, leaves of equal prediction merged. The draws are others, so the trees are
not the ones that Spark grows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from perilake.operators import forests
from perilake.operators.forests import BINS, PURE, Level
from perilake.operators.trees import Ensemble
from perilake.session import shared_root
from perilake.sources.tables import remove

#: After so many rounds the outputs so far are written down, as by Spark's trainer.
CHECKPOINT_ROUNDS = 10


def residuals(codes: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What the next tree is fitted to: the labels as -1 and 1, or the slope of the log-loss at the outputs so far."""
    sign = 2.0 * (codes[0] & 1) - 1.0
    if margin is None:
        return sign
    with np.errstate(over="ignore"):
        return 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))


def drawn(seed: int, block: int, tree: int, n: int, share: float) -> np.ndarray:
    """The rows of a block that a tree is fitted to."""
    bits = np.random.Generator(np.random.SFC64([seed, 3, block >> 32, block & 0xFFFFFFFF, tree])).bytes(2 * n)
    return np.flatnonzero(np.frombuffer(bits, np.uint16) < round(share * (1 << 16)))


def sums_of(
    levels: Sequence[Level], codes: np.ndarray, rows: np.ndarray, wanted: np.ndarray, nodes: int, last: bool,
) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the drawn rows in the level below ``levels``.

    The first array has rows, residuals and, in the last level, their squares per feature,
    node, bin and label; the second one the squares per node and label.
    """
    n, flat = codes.shape[1], codes.ravel()
    node = np.zeros(len(rows), np.int64)
    for level in levels:
        code = flat.take((level.feature * n).take(node) + rows)
        node = level.after.take(2 * node + (code > (2 * level.cut + 1).take(node)))
        stays = node >= 0
        if not stays.all():
            node, rows, wanted = node[stays], rows[stays], wanted[stays]
    first, cells, squares = node * (2 * BINS), nodes * 2 * BINS, wanted * wanted
    out = np.empty((3 if last else 2, len(codes), nodes, BINS, 2))
    for f, code in enumerate(codes):
        at = first + code.take(rows)
        out[0, f] = np.bincount(at, minlength=cells).reshape(nodes, BINS, 2)
        out[1, f] = np.bincount(at, wanted, cells).reshape(nodes, BINS, 2)
        if last:
            out[2, f] = np.bincount(at, squares, cells).reshape(nodes, BINS, 2)
    return out, np.bincount(2 * node + (codes[0].take(rows) & 1), squares, 2 * nodes).reshape(nodes, 2)


def best_splits(sums: np.ndarray, squares: np.ndarray, chosen: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node the feature (-1: none gains), last bin to the left, gain, and the figures of the node, left and right.

    Figures are rows, weight, and weighted sums of the residuals and of their squares; squares
    of the sides are known in the last level only.
    """
    nodes = np.arange(len(chosen))
    figures = [sums[0].sum(axis=-1), *(s @ weights for s in sums)]
    left = [f.cumsum(axis=2) for f in figures]
    whole = [f[0, :, -1] for f in left]
    own = np.stack([*whole[:3], squares @ weights], axis=1)
    (nl, wl, sl), (nr, wr, sr) = ([f[:, :, :-1] for f in left[:3]], [f[:, :, -1:] - f[:, :, :-1] for f in left[:3]])
    w, s = whole[1][:, None], whole[2][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (sl * sl / wl + sr * sr / wr - s * s / w) / w
    allowed = np.zeros((len(sums[0]), len(nodes), 1), bool)
    allowed[chosen.T, nodes, 0] = True
    gain = np.where(allowed & (nl >= 1) & (nr >= 1), gain, -1.0)
    flat = gain.transpose(1, 0, 2).reshape(len(nodes), -1)
    at = flat.argmax(axis=1)
    f, cut = at // (BINS - 1), at % (BINS - 1)
    best = flat[nodes, at]
    splits = (best > 0) & (variance(own) > PURE)
    to_left = np.full((len(nodes), 4), np.nan)
    to_left[:, :len(left)] = np.stack([a[f, nodes, cut] for a in left], axis=1)
    return np.where(splits, f, -1), cut, best, own, to_left, own - to_left


def variance(figures: np.ndarray) -> np.ndarray:
    mean = figures[:, 2] / figures[:, 1]
    return figures[:, 3] / figures[:, 1] - mean * mean


class Tree:
    """A tree while it grows: its nodes in order of depth, and the splits by level."""

    def __init__(self):
        self.levels: list[Level] = []
        self.feature, self.cut, self.left = (np.full(1, -1) for _ in range(3))
        self.gain, self.figures = np.full(1, -1.0), np.zeros((1, 4))
        self.front = np.zeros(1, np.int64)

    def grow(self, feature, cut, gain, own, to_left, to_right, last: bool) -> None:
        """Take in the splits of the nodes in front; their children come in front."""
        self.figures[self.front] = own
        split = feature >= 0
        at, children = self.front[split], len(self.feature) + np.arange(2 * split.sum())
        self.feature[at], self.cut[at], self.gain[at], self.left[at] = feature[split], cut[split], gain[split], children[::2]
        self.feature, self.cut, self.left = (np.concatenate([a, np.full(len(children), -1)]) for a in (self.feature, self.cut, self.left))
        self.gain = np.concatenate([self.gain, np.full(len(children), -1.0)])
        self.figures = np.concatenate([self.figures, np.stack([to_left[split], to_right[split]], axis=1).reshape(-1, 4)])
        after = np.full((len(feature), 2), -1)
        if not last:
            after[split] = np.arange(len(children)).reshape(-1, 2)
        self.levels.append(Level(np.where(split, feature, 0), cut, after.ravel()))
        self.front = children[:0] if last else children

    def values(self) -> np.ndarray:
        """Prediction of each node."""
        return self.figures[:, 2] / self.figures[:, 1]

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The leaf that each row of a block reaches."""
        n, flat = codes.shape[1], codes.ravel()
        inner = self.left >= 0
        start, limit = np.where(inner, self.feature, 0) * n, np.where(inner, 2 * self.cut + 1, 2 * BINS)
        first, rows = np.where(inner, self.left, np.arange(len(self.left))), np.arange(n)
        at = np.zeros(n, np.int64)
        for _ in self.levels:
            at = first.take(at) + (flat.take(start.take(at) + rows) > limit.take(at))
        return at

    def pruned(self) -> tuple[np.ndarray, np.ndarray]:
        """The left child of each node, where siblings that are leaves of one prediction are merged; and which nodes stay."""
        value, left = self.values(), self.left.copy()
        for node in np.flatnonzero(left >= 0)[::-1].tolist():
            a = left[node]
            if left[a] < 0 and left[a + 1] < 0 and value[a] == value[a + 1]:
                left[node] = -1
        kept = np.zeros(len(left), bool)
        kept[0] = True
        for node in np.flatnonzero(left >= 0).tolist():
            kept[left[node]:left[node] + 2] = kept[node]
        return left, kept

    def table(self, number: int, cuts: Sequence[np.ndarray]) -> pa.Table:
        """The nodes as columns."""
        left, kept = self.pruned()
        ids, place = np.flatnonzero(kept), np.cumsum(kept) - 1
        inner, figures = left[ids] >= 0, self.figures[ids]
        first = np.where(inner, place[left[ids]], -1)
        cut = [cuts[f][c] if i else 0.0 for f, c, i in zip(self.feature[ids].tolist(), self.cut[ids].tolist(), inner.tolist())]
        return pa.table({
            "tree": np.full(len(ids), number, np.int32), "id": np.arange(len(ids), dtype=np.int32), "prediction": self.values()[ids],
            "impurity": variance(figures), "weight": figures[:, 1], "sum": figures[:, 2], "squares": figures[:, 3],
            "n": figures[:, 0].astype(np.int64), "gain": np.where(inner, self.gain[ids], -1.0), "left": first.astype(np.int32),
            "right": np.where(inner, first + 1, -1).astype(np.int32), "feature": np.where(inner, self.feature[ids], -1).astype(np.int32),
            "cut": np.array(cut), "inner": inner})


class Growth:
    """Rounds grown so far on the rows (features and labels 0 and 1 by the columns of ``booster``), and how to go on.

    ``weights`` are those of the two classes. Of the booster's settings, depth, step, the
    shares of rows and features, and the seed may differ from Spark's defaults.
    """

    def __init__(self, rows: DataFrame, booster: GBTClassifier, n_rows: int, weights: tuple[float, float]):
        self.spark, self.booster, self.weights = rows.sparkSession, booster, np.array(weights)
        rows = forests.known_rows(rows, booster)
        self.cuts = forests.sampled_cuts(rows, n_rows, booster.getSeed(), self.weights)
        self.trees: list[Tree] = []
        features = len(self.cuts)
        blocks = forests.as_blocks(rows, self.cuts, n_rows)
        #: Blocks as (number, bytes, output of the trees so far).
        self._state = blocks.rdd.map(lambda r: (r[0], np.frombuffer(r[1], np.uint8).reshape(features, -1), None))
        self._state.persist(StorageLevel.MEMORY_AND_DISK)
        self._written: str | None = None

    def grow(self, rounds: int) -> None:
        """Go on to so many rounds."""
        while len(self.trees) < rounds:
            before = self._state
            if self.trees:
                tree, step = self.trees[-1], self._weight(len(self.trees) - 1)
                value = step * tree.values()

                def moved(block):
                    number, codes, margin = block
                    added = value.take(tree.leaves(codes))
                    return number, codes, added if margin is None else margin + added

                self._state = before.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
                if len(self.trees) % CHECKPOINT_ROUNDS == 0:
                    self._state.checkpoint()
            self.trees.append(self._next())
            if before is not self._state:
                before.unpersist()
            if self._state.isCheckpointed():
                if self._written and self._written != self._state.getCheckpointFile():
                    remove(self.spark, self._written)
                self._written = self._state.getCheckpointFile()

    def _weight(self, tree: int) -> float:
        return self.booster.getStepSize() if tree else 1.0

    def _next(self) -> Tree:
        """The next tree, one pass over the blocks per level."""
        tree, number, features = Tree(), len(self.trees), len(self.cuts)
        seed, share, depth = self.booster.getSeed(), self.booster.getSubsamplingRate(), self.booster.getMaxDepth()
        per_node = ceil(float(self.booster.getFeatureSubsetStrategy()) * features)
        for level in range(depth):
            nodes, levels, last = len(tree.front), tree.levels, level == depth - 1
            if not nodes:
                break

            def summed(blocks):
                total = None
                for block, codes, margin in blocks:
                    rows = drawn(seed, block, number, codes.shape[1], share)
                    total = both(total, sums_of(levels, codes, rows, residuals(codes, margin).take(rows), nodes, last))
                if total is not None:
                    yield total

            sums, squares = self._state.mapPartitions(summed).treeReduce(both)
            chosen = forests.chosen_features(seed, number, level, nodes, features, per_node)
            tree.grow(*best_splits(sums, squares, chosen, self.weights), last)
        return tree

    def ensemble(self) -> Ensemble:
        """The node arrays of all rounds."""
        columns, roots, at = [], [], 0
        for number, tree in enumerate(self.trees):
            t = tree.table(number, self.cuts)
            value = 2.0 * self._weight(number) * t["prediction"].to_numpy()
            columns.append([t["feature"].to_numpy().astype(np.int64), t["cut"].to_numpy(), t["left"].to_numpy().astype(np.int64) + at,
                            t["right"].to_numpy().astype(np.int64) + at, value, t["n"].to_numpy().astype(float)])
            roots.append(at)
            at += t.num_rows
        return Ensemble(*(np.concatenate(c) for c in zip(*columns)), np.array(roots), True)

    def model(self, rounds: int) -> GBTClassificationModel:
        """The first rounds as a model of the library."""
        nodes = pa.concat_tables([tree.table(t, self.cuts) for t, tree in enumerate(self.trees[:rounds])])
        return as_model(self.spark.createDataFrame(nodes), self.booster, len(self.cuts), rounds)

    def close(self) -> None:
        """Give up what the growth holds; it can't go on then."""
        self._state.unpersist()
        if self._written:
            remove(self.spark, self._written)


def both(a: tuple | None, b: tuple) -> tuple:
    return b if a is None else tuple(x + y for x, y in zip(a, b))


def as_model(nodes: DataFrame, booster: GBTClassifier, features: int, rounds: int) -> GBTClassificationModel:
    """Nodes as a model of the library, through its saved form: that of a model of two rows, with other nodes."""
    spark = nodes.sparkSession
    two = spark.createDataFrame(
        [(Vectors.dense([0.0] * features), float(y), 1.0) for y in (0, 1)], [booster.getFeaturesCol(), booster.getLabelCol(), booster.getWeightCol()])
    path, into = (f"{shared_root(spark)}/boosted/{uuid.uuid4().hex}" for _ in range(2))
    booster.copy({booster.maxIter: 2, booster.subsamplingRate: 1.0}).fit(two).write().save(path)
    kinds = spark.read.parquet(f"{path}/data").schema
    cuts = F.when(F.col("inner"), F.array("cut")).otherwise(F.array().cast("array<double>"))
    data = F.struct(
        "id", "prediction", "impurity", F.array("weight", "sum", "squares").alias("impurityStats"), F.col("n").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        F.struct(F.col("feature").alias("featureIndex"), cuts.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split"))
    stored = nodes.select(F.col("tree").alias("treeID"), data.alias("nodeData"))
    stored.select(*[F.col(f.name).cast(f.dataType) for f in kinds]).write.parquet(f"{into}/data")
    # The first tree's line, and the second one's for each further tree.
    lines = spark.read.parquet(f"{path}/treesMetadata")
    numbers = spark.range(rounds).select(F.col("id").cast("int").alias("_n"))
    lines.join(F.broadcast(numbers), F.col("_1") == F.least("_n", F.lit(1))).withColumn("_1", F.col("_n")).select(*lines.columns) \
        .coalesce(1).write.parquet(f"{into}/treesMetadata")
    about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    about["numTrees"] = rounds
    about["paramMap"] |= {"maxIter": rounds, "subsamplingRate": booster.getSubsamplingRate()}
    write_about(spark, about, f"{into}/metadata")
    model = GBTClassificationModel.load(into)
    for p in (path, into):
        remove(spark, p)
    return model


def write_about(spark: SparkSession, about: dict, path: str) -> None:
    """The description in a saved model."""
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(path)
