"""Tree ensembles as node arrays: scores, margins after each tree, Shapley values.

The arrays hold at most trees * 2^(depth + 1) nodes, a bound set by the model's
parameters and not by the data it was fit on; they are broadcast, and everything
below works on one Arrow batch inside a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Subtrees of up to this height are attributed together, see ``units``.
UNIT_HEIGHT = 3
#: Rows whose patterns are worked out at a time.
ROWS_AT_ONCE = 1 << 16
#: Rows whose leaves in all trees are held at a time.
WALKED_AT_ONCE = 1 << 12
#: Up to this many values are told apart by a table, more by sorting.
SMALL = 1 << 16


@dataclass
class Ensemble:
    """Nodes of all trees; a leaf has ``feature`` -1. ``value`` carries the tree's weight.

    A row goes left where its feature is at most ``cut``; a missing value goes right.
    Forest values are shares of a probability, boosted ones shares of log-odds.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    roots: np.ndarray
    boosted: bool
    _units: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_units": None}

    @property
    def trees(self) -> int:
        return len(self.roots)

    def first(self, trees: int) -> "Ensemble":
        """The ensemble of the first trees only."""
        return Ensemble(self.feature, self.cut, self.left, self.right, self.value, self.cover, self.roots[:trees], self.boosted)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches in each tree."""
        at = np.broadcast_to(self.roots, (len(x), self.trees)).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            goes_left = x[rows, feature] <= self.cut[at]
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """What each tree adds to each row's output."""
        return self.value[self.leaves(x)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = self.parts(x).sum(axis=1)
        return logistic(total) if self.boosted else total

    def base(self) -> float:
        """Mean output over the rows the trees were grown on."""
        weight = np.zeros(len(self.feature))
        weight[self.roots] = 1.0
        for node in self._order():
            if self.feature[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    weight[child] = weight[node] * self.cover[child] / self.cover[node]
        leaf = self.feature < 0
        return float((weight[leaf] * self.value[leaf]).sum())

    def _order(self) -> list[int]:
        out, pending = [], list(self.roots)
        while pending:
            node = int(pending.pop())
            out.append(node)
            if self.feature[node] >= 0:
                pending += [self.left[node], self.right[node]]
        return out

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley value of each feature for each row of ``x``."""
        if self._units is None:
            self._units = units(self)
        out = np.empty(x.shape)
        for start in range(0, len(x), ROWS_AT_ONCE):
            out[start:start + ROWS_AT_ONCE] = _shapley(x[start:start + ROWS_AT_ONCE], *self._units)
        return out


def logistic(log_odds: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-log_odds))


def stored_ensemble(spark: SparkSession, model: PipelineModel, path: str) -> Ensemble:
    """Node arrays of a fitted pipeline's last stage, read from its saved form at ``path``.

    Forest leaves carry the class-1 probability over the number of trees; boosted leaves
    carry log-odds (twice the weighted tree output).
    """
    stage = model.stages[-1]
    stage.write().overwrite().save(path)
    boosted = "RandomForest" not in type(stage).__name__
    weights = 2.0 * np.array(stage.treeWeights) if boosted else np.full(stage.getNumTrees, 1.0 / stage.getNumTrees)
    node = F.col("nodeData")
    cover = node["rawCount"].cast("double") if boosted else F.aggregate(node["impurityStats"], F.lit(0.0), lambda a, b: a + b)
    value = node["prediction"] if boosted else node["impurityStats"][1] / cover
    stored = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        F.when(node["leftChild"] >= 0, node["split"]["featureIndex"]).otherwise(-1).alias("feature"),
        F.when(node["leftChild"] >= 0, node["split"]["leftCategoriesOrThreshold"][0]).otherwise(0.0).alias("cut"),
        value.alias("value"), cover.alias("cover")).toArrow()
    cols = {n: stored.column(n).to_numpy() for n in stored.column_names}
    order = np.lexsort((cols["id"], cols["tree"]))
    cols = {n: c[order] for n, c in cols.items()}
    sizes = np.bincount(cols["tree"], minlength=len(weights))
    roots = np.cumsum(sizes) - sizes
    offset = roots[cols["tree"]]
    # Ids of a tree count its nodes from 0, so they are places behind its root.
    return Ensemble(cols["feature"].astype(np.int64), cols["cut"], cols["left"] + offset, cols["right"] + offset,
                    cols["value"] * weights[cols["tree"]], cols["cover"], roots, boosted)


def declared_ensemble(trees: Sequence, weight: float, boosted: bool) -> Ensemble:
    """An ensemble from nested splits (feature, cut, share going left, left, right) with numbers as leaves."""
    feature, cut, left, right, value, cover, roots = [], [], [], [], [], [], []

    def add(node, share: float) -> int:
        at = len(feature)
        for column, blank in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (value, 0.0), (cover, share)):
            column.append(blank)
        if isinstance(node, tuple):
            feature[at], cut[at], to_left = node[0], node[1], node[2]
            left[at] = add(node[3], share * to_left)
            right[at] = add(node[4], share * (1 - to_left))
        else:
            value[at] = weight * node
        return at

    for tree in trees:
        roots.append(add(tree, 1.0))
    return Ensemble(np.array(feature), np.array(cut, float), np.array(left), np.array(right), np.array(value, float),
                    np.array(cover, float), np.array(roots), boosted)


def save_ensemble(spark: SparkSession, ensemble: Ensemble, path: str) -> None:
    """Write the nodes as a table of one row per node, roots marked."""
    e = ensemble
    root = np.zeros(len(e.feature), bool)
    root[e.roots] = True
    table = pa.table({"node": np.arange(len(e.feature)), "feature": e.feature, "cut": e.cut, "left": e.left, "right": e.right,
                      "value": e.value, "cover": e.cover, "root": root, "boosted": np.full(len(e.feature), e.boosted)})
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(path)


def load_ensemble(spark: SparkSession, path: str) -> Ensemble:
    table = spark.read.parquet(path).orderBy("node").toArrow()
    columns = {n: table.column(n).to_numpy() for n in table.column_names}
    arrays = [columns[n] for n in ("feature", "cut", "left", "right", "value", "cover")]
    return Ensemble(*arrays, np.flatnonzero(columns["root"]), bool(columns["boosted"][0]))


def with_outputs(
    ensemble: Ensemble, df: DataFrame, features: Sequence[str], keep: Sequence[str], probability: str | None = "probability",
    impacts: str | None = None,
) -> DataFrame:
    """Columns ``keep``, the probability and an array of the impacts, both from one pass over the rows."""
    shared = df.sparkSession.sparkContext.broadcast(ensemble)
    held = [f"_k{i}" for i in range(len(keep))]
    rows = df.select(
        *[F.col(c).alias(h) for c, h in zip(keep, held)],
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)],
    )

    def run(batches):
        for batch in _larger(batches):
            x = np.column_stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(features))])
            out = [batch.column(h) for h in held]
            if probability:
                out.append(pa.array(np.concatenate([
                    shared.value.probability(x[at:at + WALKED_AT_ONCE]) for at in range(0, len(x), WALKED_AT_ONCE)])))
            if impacts:
                flat = shared.value.shapley(x)
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel())))
            yield pa.RecordBatch.from_arrays(out, names=[*held, *(["_p"] if probability else []), *(["_i"] if impacts else [])])

    kinds = [f"{h} {df.schema[c].dataType.simpleString()}" for c, h in zip(keep, held)]
    kinds += ["_p double"] * bool(probability) + ["_i array<double>"] * bool(impacts)
    names = [F.col(h).alias(c) for c, h in zip(keep, held)]
    if probability:
        names.append(F.col("_p").alias(probability))
    if impacts:
        # One null-free array per row, in the order of the features.
        named = [F.struct(F.lit(f).alias("feature"), F.col("_i")[i].alias("impact")) for i, f in enumerate(features)]
        names.append(F.array(*named).alias(impacts))
    return rows.mapInArrow(run, ", ".join(kinds)).select(*names)


def _larger(batches):
    """Batches joined up to ROWS_AT_ONCE rows, so that patterns are worked out less often."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# --- Shapley values ----------------------------------------------------------
#
# A leaf's output depends on a row through one bit for each feature on its path: whether
# the row keeps to the feature's interval. The leaf is a product game with factor 1 or 0
# (the bit) for a known feature and r (the share of rows that stay) for an unknown one,
# and the Shapley value of feature i in it is
#
#   value * integral over t in [0, 1] of (z_i - r_i) * prod over j <> i of (r_j + t (z_j - r_j)),
#
# a polynomial of degree d - 1 in t, so d / 2 Gauss-Legendre points give it exactly.
#
# The leaves of a low subtree share their path down to it. Their bits follow from the bits
# of that path and of the subtree's splits, the pattern of the unit. Rows of a batch with
# the same pattern have the same values; these are worked out once per pattern that occurs.


@dataclass
class Unit:
    features: np.ndarray  # features whose values the unit gives
    bits: int
    places: list[np.ndarray]  # per feature: bits of the pattern by the code of the row's value
    mask: np.ndarray  # per feature and leaf: bits of the pattern that belong to the feature, and
    want: np.ndarray  # what they must be for a row that keeps to the leaf's path
    stay: np.ndarray  # per feature and leaf: share of rows that stay
    value: np.ndarray  # per leaf

    def table(self, patterns: np.ndarray) -> np.ndarray:
        """Shapley values per pattern and feature."""
        width, n_leaves = self.mask.shape
        kept = (patterns & self.mask[:, :, None]) == self.want[:, :, None]
        # Patterns that differ in other leaves only share a leaf's work.
        own = (kept * (1 << np.arange(width))[:, None, None]).sum(axis=0) + (np.arange(n_leaves) << width)[:, None]
        distinct, place = numbered(own.ravel(), n_leaves << width)
        leaf = distinct >> width
        z = (distinct >> np.arange(width)[:, None] & 1).astype(float)
        rest = self.stay[:, leaf]
        lift, value = z - rest, self.value[leaf]
        share = np.zeros(z.shape)
        for t, w in zip(*_points((width + 1) // 2)):
            factor = rest * (1.0 - t) + t * z
            share += lift / factor * (factor.prod(axis=0) * (value * w))
        return share.T[place.reshape(own.shape)].sum(axis=0)


def numbered(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values below ``limit``, in order, and which of them each value is."""
    if limit > SMALL:
        return np.unique(values, return_inverse=True)
    seen = np.bincount(values, minlength=limit)
    distinct = np.flatnonzero(seen)
    seen[distinct] = np.arange(len(distinct))
    return distinct, seen.take(values, mode="clip")


@lru_cache
def _points(n: int) -> tuple[np.ndarray, np.ndarray]:
    x, w = np.polynomial.legendre.leggauss(n)
    return (x + 1) / 2, w / 2


def units(ensemble: Ensemble) -> tuple[list[Unit], dict[int, np.ndarray]]:
    """Units of all trees, and the distinct cuts of each feature."""
    e = ensemble
    inner = e.feature >= 0
    cuts = {int(f): np.unique(e.cut[inner & (e.feature == f)]) for f in np.unique(e.feature[inner])}
    code = np.zeros(len(e.feature), np.int64)
    for f, c in cuts.items():
        mine = inner & (e.feature == f)
        code[mine] = np.searchsorted(c, e.cut[mine])
    feature, left, right = e.feature.tolist(), e.left.tolist(), e.right.tolist()
    code, cover, value = code.tolist(), e.cover.tolist(), e.value.tolist()
    height = {}
    for node in reversed(e._order()):
        height[node] = 0 if feature[node] < 0 else 1 + max(height[left[node]], height[right[node]])
    found = []
    # Box of a path: feature -> (lowest code, highest code, share that stays).
    pending = [(int(root), {}) for root in e.roots]
    while pending:
        node, box = pending.pop()
        if height[node] > UNIT_HEIGHT:
            for child, goes_left in ((left[node], True), (right[node], False)):
                f = feature[node]
                low, high, stay = box.get(f, (0, len(cuts[f]), 1.0))
                stay *= cover[child] / cover[node]
                edge = (low, min(high, code[node]), stay) if goes_left else (max(low, code[node] + 1), high, stay)
                pending.append((child, {**box, f: edge}))
        elif box or height[node]:
            found.append(_unit(node, box, feature, left, right, code, cover, value, cuts))
    return found, cuts


def _unit(node, box, feature, left, right, code, cover, value, cuts) -> Unit:
    splits, leaves, pending = [], [], [(node, (), {})]
    while pending:
        at, path, stays = pending.pop()
        f = feature[at]
        if f < 0:
            leaves.append((value[at], path, stays))
            continue
        number = len(splits)
        splits.append((f, code[at]))
        for child, bit in ((left[at], 1), (right[at], 0)):
            share = stays.get(f, box[f][2] if f in box else 1.0) * cover[child] / cover[at]
            pending.append((child, (*path, (number, bit)), {**stays, f: share}))
    names = sorted({*box, *(f for f, _ in splits)})
    prefix = sorted(box)
    owner = [names.index(f) for f in prefix] + [names.index(f) for f, _ in splits]
    places = [np.zeros(len(cuts[f]) + 1, np.uint16 if len(owner) <= 16 else np.int64) for f in names]
    mask, want = np.zeros((2, len(names), len(leaves)), np.int64)
    for b, f in enumerate(prefix):
        places[owner[b]][box[f][0]:box[f][1] + 1] |= 1 << b
        mask[owner[b]] |= 1 << b
        want[owner[b]] |= 1 << b
    for b, (_, c) in enumerate(splits, start=len(prefix)):
        places[owner[b]][:c + 1] |= 1 << b
    for k, (_, path, _) in enumerate(leaves):
        for number, bit in path:
            b = len(prefix) + number
            mask[owner[b], k] |= 1 << b
            want[owner[b], k] |= bit << b
    stay = np.array([[stays.get(f, box[f][2] if f in box else 1.0) for _, _, stays in leaves] for f in names])
    return Unit(np.array(names), len(owner), places, mask, want, stay, np.array([v for v, _, _ in leaves]))


def _shapley(x: np.ndarray, parts: list[Unit], cuts: dict[int, np.ndarray]) -> np.ndarray:
    # Missing values come behind every cut, as they go right.
    codes = {f: np.searchsorted(c, x[:, f]) for f, c in cuts.items()}
    out = np.zeros((x.shape[1], len(x)))
    for unit in parts:
        names = unit.features.tolist()
        pattern = unit.places[0].take(codes[names[0]], mode="clip")
        for place, f in zip(unit.places[1:], names[1:]):
            pattern += place.take(codes[f], mode="clip")
        occurring, which = numbered(pattern.astype(np.intp), 1 << unit.bits)
        for f, row in zip(names, np.ascontiguousarray(unit.table(occurring).T)):
            out[f] += row.take(which, mode="clip")
    return out.T
