"""The forest of many rows against counts and splits worked out row by row."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from perilake.operators import forests, metrics, models, trees

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 5, 3000), rng.random(3000) < 0.3, rng.normal(size=3000)]).astype(float)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2 * x[:, 0] + x[:, 1] - 3 * x[:, 2] - 2)))).astype(float)
    frame = spark.createDataFrame([(i, *map(float, r), float(o)) for i, (r, o) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y double")
    return frame.repartition(5).cache()


def test_draws_are_poisson():
    n = 1 << 18
    rows, draws = forests.in_bag(1, (3 << 32) + 5, 7, n)
    assert len(rows) / n == pytest.approx(1 - np.exp(-1), abs=0.005)
    assert draws.sum() / n == pytest.approx(1, abs=0.01) and (draws ** 2).sum() / n == pytest.approx(2, abs=0.02)
    again, _ = forests.in_bag(1, (3 << 32) + 5, 7, n)
    other, _ = forests.in_bag(1, (4 << 32) + 5, 7, n)
    assert np.array_equal(rows, again) and not np.array_equal(rows, other)


def test_cuts_part_all_values_or_the_weight():
    assert forests.midpoints(np.array([3.0, 1.0, 1.0, 2.0]), np.ones(4)).tolist() == [1.5, 2.5]
    cuts = forests.midpoints(np.arange(1000.0), np.ones(1000))
    assert len(cuts) == forests.BINS - 1
    assert np.diff(cuts).min() >= 31 and np.diff(cuts).max() <= 32


def test_tree_is_that_of_its_drawn_rows(some):
    """Every node's counts, and its split against all cuts of its chosen features, row by row."""
    weights, depth, seed = np.array([0.75, 1.5]), 4, 3
    rows = some.select(F.array(*NAMES).alias("_x"), F.col("y").alias("_y"))
    held = rows.toPandas()
    x = np.stack(held["_x"])
    cuts = [forests.midpoints(x[:, f], weights[held["_y"].astype(int)]) for f in range(4)]
    blocks = forests.as_blocks(rows, cuts, 3000)
    grown = forests.grow_trees(blocks, 4, weights, 3, depth, seed)
    codes = [(b, np.frombuffer(data, np.uint8).reshape(4, -1)) for b, data in blocks.collect()]
    assert sum(c.shape[1] for _, c in codes) == 3000
    for t, tree in enumerate(grown):
        drawn = [(c[:, r], w) for b, c in codes for r, w in [forests.in_bag(seed, b, t, c.shape[1])]]
        code, w = np.concatenate([c for c, _ in drawn], axis=1), np.concatenate([w for _, w in drawn])
        bins, label = code >> 1, code[0] & 1

        def by_label(mask):
            return np.array([w[mask & (label == k)].sum() for k in (0, 1)])

        front = [(0, np.ones(len(w), bool))]
        for level in range(depth):
            chosen = forests.chosen_features(seed, t, level, len(front), 4, 2)
            behind = []
            for (node, mask), features in zip(front, chosen):
                assert by_label(mask).tolist() == tree.counts[node].tolist()
                gains = {}
                for f in features:
                    for c in range(len(cuts[f])):
                        sides = [by_label(mask & (bins[f] <= c)), by_label(mask & (bins[f] > c))]
                        if min(s.sum() for s in sides) >= 1:
                            part = [s * weights for s in sides]
                            whole = part[0] + part[1]
                            gains[f, c] = forests.gini(whole) - sum(p.sum() * forests.gini(p) for p in part) / whole.sum()
                best = max(gains.values(), default=0.0)
                if tree.left[node] < 0:
                    assert best < 1e-12
                    continue
                f, c, left = tree.feature[node], tree.cut[node], tree.left[node]
                assert gains[f, c] == pytest.approx(best, abs=1e-12) and tree.gain[node] == pytest.approx(best, abs=1e-12)
                for child, side in ((left, bins[f] <= c), (left + 1, bins[f] > c)):
                    assert by_label(mask & side).tolist() == tree.counts[child].tolist()
                    if level < depth - 1 and tree.counts[child].min() > 0:
                        behind.append((child, mask & side))
            front = behind


def test_many_rows_get_a_model_of_the_library(spark, some, tmp_path, monkeypatch):
    """Above the limit Spark's trainer sees the two rows of the frame only, and the model is as good."""
    # A fitted model holds its summary, which can't be sent to tasks once a session has observed a write; a loaded one can.
    models.save_model(models.train_forest(some, NAMES, "y", n_trees=30, depth=6), str(tmp_path / "theirs"))
    theirs = models.load_model(str(tmp_path / "theirs"))
    seen, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    ours = models.train_forest(some, NAMES, "y", n_trees=30, depth=6, spark_rows=2999)
    assert seen == [2]
    area = [metrics.roc_auc(models.with_probability(m, some), "y", "probability").first()["roc_auc"] for m in (ours, theirs)]
    assert area[0] == pytest.approx(area[1], abs=0.02) and area[0] > 0.85
    stage = ours.stages[-1]
    assert stage.getNumTrees == 30 and stage.getOrDefault("maxDepth") == 6 and max(t.depth for t in stage.trees) == 6
    ensemble = trees.stored_ensemble(spark, ours, str(tmp_path / "nodes"))
    inner = ensemble.feature >= 0
    assert np.allclose(ensemble.cover[ensemble.left[inner]] + ensemble.cover[ensemble.right[inner]], ensemble.cover[inner])
    walked = dict(trees.with_outputs(ensemble, some, NAMES, ["id"]).collect())
    stored = dict(models.with_probability(ours, some).select("id", "probability").collect())
    assert max(abs(walked[i] - stored[i]) for i in stored) < 1e-12
    models.save_model(ours, str(tmp_path / "m"))
    again = dict(models.with_probability(models.load_model(str(tmp_path / "m")), some).select("id", "probability").collect())
    assert again == stored


def test_many_rows_of_one_kind_and_odd_rows(spark, some):
    flat = spark.createDataFrame([(1.0, float(i % 2)) for i in range(20)], "a double, y double")
    model = models.train_forest(flat, ["a"], "y", n_trees=3, depth=3, spark_rows=5)
    assert [t.numNodes for t in model.stages[-1].trees] == [1, 1, 1]
    for odd in (flat.withColumn("y", F.lit(None).cast("double")), flat.withColumn("y", F.col("y") * 2), flat.withColumn("a", F.lit(None).cast("double"))):
        with pytest.raises(Exception):
            models.train_forest(odd, ["a"], "y", n_trees=3, depth=3, spark_rows=5)
