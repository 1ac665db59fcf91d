"""The boosted trees of many rows against sums, splits and outputs worked out row by row."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from perilake.operators import boosting, forests, metrics, models, trees

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 5, 3000), rng.random(3000) < 0.3, rng.normal(size=3000)]).astype(float)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2 * x[:, 0] + x[:, 1] - 3 * x[:, 2] - 2)))).astype(float)
    frame = spark.createDataFrame([(i, *map(float, r), float(o)) for i, (r, o) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y double")
    return frame.repartition(5).cache()


def test_drawn_rows_have_their_share():
    n = 1 << 18
    rows = boosting.drawn(1, (3 << 32) + 5, 7, n, 0.8)
    assert len(rows) / n == pytest.approx(0.8, abs=0.005)
    assert np.array_equal(rows, boosting.drawn(1, (3 << 32) + 5, 7, n, 0.8))
    assert not np.array_equal(rows, boosting.drawn(1, (3 << 32) + 5, 8, n, 0.8))


def test_rounds_are_those_of_their_drawn_rows(some, monkeypatch):
    """Every node's figures, its split against all cuts of its chosen features, and the outputs, row by row."""
    monkeypatch.setattr(boosting, "CHECKPOINT_ROUNDS", 2)
    weights, depth, seed, step = np.array([0.75, 1.5]), 3, 3, 0.5
    booster = GBTClassifier(labelCol="y", weightCol="weight", maxDepth=depth, stepSize=step, subsamplingRate=0.7, featureSubsetStrategy="0.6", seed=seed)
    rows = VectorAssembler(inputCols=NAMES, outputCol="features").transform(some).withColumn("weight", F.lit(1.0))
    growth = boosting.Growth(rows, booster, 3000, (0.75, 1.5))
    growth.grow(2)
    growth.grow(4)
    states = growth._state.collect()
    assert len(growth.trees) == 4 and sum(c.shape[1] for _, c, _ in states) == 3000
    code = np.concatenate([c for _, c, _ in states], axis=1)
    bins, label = code >> 1, code[0] & 1
    sign, w = 2.0 * label - 1, weights[label]
    margin = np.zeros(3000)
    for t, tree in enumerate(growth.trees):
        draws = np.concatenate([np.isin(np.arange(c.shape[1]), boosting.drawn(seed, b, t, c.shape[1], 0.7)) for b, c, _ in states])
        wanted = 4 * sign / (1 + np.exp(2 * sign * margin)) if t else sign

        def figures(mask):
            return np.array([mask.sum(), w[mask].sum(), (w * wanted)[mask].sum(), (w * wanted ** 2)[mask].sum()])

        def spread(mask):
            n, total, s, q = figures(mask)
            return q / total - (s / total) ** 2

        front, added = [(0, draws, np.ones(3000, bool))], np.zeros(3000)
        for level in range(depth + 1):
            chosen = forests.chosen_features(seed, t, level, len(front), 4, 3) if level < depth else [None] * len(front)
            behind = []
            for (node, mask, everyone), features in zip(front, chosen):
                assert tree.figures[node] == pytest.approx(figures(mask))
                if level < depth:
                    gains = {}
                    for f in features:
                        for c in range(len(growth.cuts[f])):
                            sides = [mask & (bins[f] <= c), mask & (bins[f] > c)]
                            if min(s.sum() for s in sides) >= 1:
                                gains[f, c] = spread(mask) - sum(w[s].sum() * spread(s) for s in sides) / w[mask].sum()
                    best = max(gains.values(), default=0.0)
                if tree.left[node] < 0:
                    assert level == depth or best < 1e-9
                    added[everyone] = tree.values()[node]
                    continue
                f, c, left = tree.feature[node], tree.cut[node], tree.left[node]
                assert gains[f, c] == pytest.approx(best, abs=1e-9) and tree.gain[node] == pytest.approx(best, abs=1e-9)
                behind += [(left, mask & (bins[f] <= c), everyone & (bins[f] <= c)), (left + 1, mask & (bins[f] > c), everyone & (bins[f] > c))]
            front = behind
        if t < 3:
            margin += (step if t else 1.0) * added
    # Outputs lie with the rows as they were when the last tree was begun.
    assert np.concatenate([m for _, _, m in states]) == pytest.approx(margin, abs=1e-12)
    growth.close()


def test_many_rows_get_a_boosted_model_of_the_library(spark, some, tmp_path, monkeypatch):
    """Above the limit Spark's trainer sees two rows only, and the model is as good, cut and saved as one of the library."""
    args = dict(key="id", features=NAMES, label="y", depth=4, step=0.1, patience=5, rounds=30)
    theirs = models.train_boosted(some, path=str(tmp_path / "theirs"), **args)
    seen, fit = [], GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    grown, judge = [], models.best_round
    monkeypatch.setattr(models, "best_round", lambda areas, patience: grown.append((list(areas), judge(areas, patience))) or grown[-1][1])
    ours = models.train_boosted(some, path=str(tmp_path / "ours"), spark_rows=2000, **args)
    assert seen == [2]
    for (before, _), (after, _) in zip(grown, grown[1:]):
        assert after[:len(before)] == pytest.approx(before, abs=1e-12) and len(after) > len(before)
    stage = ours.stages[-1]
    areas, (best, stopped) = grown[-1]
    assert len(stage.trees) == stage.getNumTrees == stage.getMaxIter() == best and (stopped or len(areas) == 30)
    assert stage.treeWeights == [1.0] + [0.1] * (best - 1) and stage.getSubsamplingRate() == 0.8
    area = [metrics.roc_auc(models.with_probability(m, some), "y", "probability").first()["roc_auc"] for m in (ours, theirs)]
    assert area[0] == pytest.approx(area[1], abs=0.02) and area[0] > 0.85
    ensemble = trees.stored_ensemble(spark, ours, str(tmp_path / "nodes"))
    assert ensemble.boosted and ensemble.trees == best
    inner = ensemble.feature >= 0
    assert np.allclose(ensemble.cover[ensemble.left[inner]] + ensemble.cover[ensemble.right[inner]], ensemble.cover[inner])
    walked = dict(trees.with_outputs(ensemble, some, NAMES, ["id"]).collect())
    stored = dict(models.with_probability(ours, some).select("id", "probability").collect())
    assert max(abs(walked[i] - stored[i]) for i in stored) < 1e-12
    models.save_model(ours, str(tmp_path / "m"))
    again = dict(models.with_probability(models.load_model(str(tmp_path / "m")), some).select("id", "probability").collect())
    assert again == stored


def test_many_rows_of_one_kind_and_odd_labels(spark, tmp_path):
    args = dict(key="id", path=str(tmp_path), features=["a"], label="y", rounds=4, depth=3, patience=2, spark_rows=5)
    flat = spark.createDataFrame([(i, 1.0, float(i % 2)) for i in range(40)], "id long, a double, y double")
    assert [t.numNodes for t in models.train_boosted(flat, **args).stages[-1].trees] == [1]
    one = flat.withColumn("y", F.lit(1.0))
    assert [t.numNodes for t in models.train_boosted(one, **args).stages[-1].trees] == [1]
    for odd in (flat.withColumn("y", F.lit(None).cast("double")), flat.withColumn("y", F.col("y") * 2), flat.withColumn("a", F.lit(None).cast("double"))):
        with pytest.raises(Exception):
            models.train_boosted(odd, **args)
