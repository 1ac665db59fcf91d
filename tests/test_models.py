from itertools import combinations
from math import factorial

import numpy as np
import pytest
from conftest import values
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from perilake.operators import attribution, metrics, models, sampling, trees
from perilake.plans import modeling
from perilake.sources.schemas import FEATURES


def leaves_of(ensemble):
    """Leaves as (value, [(feature, low, high, share of rows that stay), ...])."""
    out, pending = [], [(int(r), {}) for r in ensemble.roots]
    while pending:
        at, box = pending.pop()
        f = int(ensemble.feature[at])
        if f < 0:
            out.append((ensemble.value[at], [(k, *box[k]) for k in sorted(box)]))
            continue
        low, high, stay = box.get(f, (-np.inf, np.inf, 1.0))
        left, right, cut = int(ensemble.left[at]), int(ensemble.right[at]), ensemble.cut[at]
        share = ensemble.cover[left] / ensemble.cover[at]
        pending.append((left, {**box, f: (low, min(high, cut), stay * share)}))
        pending.append((right, {**box, f: (max(low, cut), high, stay * ensemble.cover[right] / ensemble.cover[at])}))
    return out


def expected(leaves, x, known):
    """Value of the ensemble when only some features are known."""
    total = 0.0
    for value, box in leaves:
        weight = 1.0
        for f, low, high, stay in box:
            weight *= float(low < x[f] <= high) if f in known else stay
        total += value * weight
    return total


def brute_force(leaves, x):
    d, out = len(x), np.zeros(len(x))
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for size in range(d):
            share = factorial(size) * factorial(d - size - 1) / factorial(d)
            for known in combinations(others, size):
                out[i] += share * (expected(leaves, x, {*known, i}) - expected(leaves, x, set(known)))
    return out


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (400, 4)).astype(float)
    y = ((x[:, 0] + x[:, 1] * 0.5 - x[:, 2] + rng.normal(0, 1, 400)) > 1.5).astype(float)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double"), x


NAMES = ["a", "b", "c", "d"]


def test_forest_shapley_is_exact(spark, small, tmp_path):
    df, x = small
    model = models.train_forest(df, NAMES, "y", n_trees=5, depth=4)
    ensemble = trees.stored_ensemble(spark, model, str(tmp_path / "forest"))
    for row, impact in zip(x[:15], ensemble.shapley(x[:15])):
        assert impact == pytest.approx(brute_force(leaves_of(ensemble), row), abs=1e-12)


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_impacts_add_up_to_the_model_output(spark, small, tmp_path, kind):
    df, _ = small
    if kind == "forest":
        model = models.train_forest(df, NAMES, "y", n_trees=6, depth=5)
    else:
        model = models.train_boosted(df, "id", str(tmp_path / "growth"), NAMES, "y", rounds=6, depth=3, step=0.3, patience=3)
    explained = attribution.attribute(model, df, str(tmp_path / kind), ["id"], NAMES)
    total = F.aggregate("impacts", F.lit(0.0), lambda t, e: t + e["impact"]) + F.col("base")
    p = models.with_probability(model, df).select("id", "probability")
    gap = explained.select("id", total.alias("total")).join(p, "id")
    output = F.col("probability") if kind == "forest" else F.log(F.col("probability") / (1 - F.col("probability")))
    assert gap.agg(F.max(F.abs(F.col("total") - output))).first()[0] < 1e-9
    assert explained.count() == 400


def grown(rng, depth, n_features, unbalanced=0.0):
    """A random declared tree; features come back on a path."""
    if depth == 0 or rng.random() < unbalanced:
        return float(rng.normal())
    return (int(rng.integers(n_features)), float(rng.normal()), float(rng.uniform(0.1, 0.9)),
            grown(rng, depth - 1, n_features, unbalanced), grown(rng, depth - 1, n_features, unbalanced))


@pytest.mark.parametrize("depth, n_features, unbalanced", [(1, 1, 0.0), (4, 3, 0.0), (6, 9, 0.1), (9, 8, 0.3), (7, 4, 0.2)])
def test_shapley_of_random_trees(depth, n_features, unbalanced):
    rng = np.random.default_rng(depth)
    ensemble = trees.declared_ensemble([grown(rng, depth, n_features, unbalanced) for _ in range(3)], 0.5, False)
    x = rng.normal(size=(4, n_features))
    got = ensemble.shapley(x)
    for row, impact in zip(x, got):
        assert impact == pytest.approx(brute_force(leaves_of(ensemble), row), abs=1e-12)
    assert got.sum(axis=1) + ensemble.base() == pytest.approx(ensemble.parts(x).sum(axis=1))


def test_shapley_with_more_bits_than_a_table_holds():
    """A path of 20 features: patterns are told apart by sorting, values add up."""
    rng = np.random.default_rng(8)
    tree = 1.0
    for f in range(20):
        tree = (f, 0.0, 0.4, tree, float(f))
    ensemble = trees.declared_ensemble([tree], 1.0, False)
    x = rng.normal(size=(50, 20)) - 1.0
    assert ensemble.shapley(x).sum(axis=1) + ensemble.base() == pytest.approx(ensemble.parts(x).sum(axis=1))


def test_missing_values_go_right(spark):
    ensemble = trees.declared_ensemble([(0, 1.0, 0.5, 0.25, 0.75)], 1.0, False)
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 2.0), (4, float("nan"))], "id long, a double")
    got = trees.with_outputs(ensemble, df, ["a"], ["id"], impacts="impacts").select("id", "probability", F.col("impacts")[0]["impact"])
    assert sorted(values(got)) == [(1, 0.25, -0.25), (2, 0.75, 0.25), (3, 0.75, 0.25), (4, 0.75, 0.25)]


def test_a_batch_larger_than_one_chunk(monkeypatch):
    rng = np.random.default_rng(1)
    ensemble = trees.declared_ensemble([grown(rng, 5, 4) for _ in range(3)], 1.0, False)
    x = rng.normal(size=(100, 4))
    want = ensemble.shapley(x)
    monkeypatch.setattr(trees, "ROWS_AT_ONCE", 7)
    assert np.abs(ensemble.shapley(x) - want).max() < 1e-12


def test_stored_nodes_come_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    ensemble = trees.declared_ensemble([grown(rng, 4, 3) for _ in range(3)], 1.0, True)
    trees.save_ensemble(spark, ensemble, str(tmp_path / "nodes"))
    again = trees.load_ensemble(spark, str(tmp_path / "nodes"))
    x = rng.normal(size=(20, 3))
    assert (again.probability(x) == ensemble.probability(x)).all() and again.base() == ensemble.base()


def test_walk_gives_the_probability_of_the_library(spark, small, tmp_path):
    df, x = small
    for model in (models.train_forest(df, NAMES, "y", n_trees=5, depth=4),
                  models.train_boosted(df, "id", str(tmp_path / "growth"), NAMES, "y", rounds=5, depth=3, patience=2)):
        ensemble = trees.stored_ensemble(spark, model, str(tmp_path / type(model.stages[-1]).__name__))
        ours = dict(values(trees.with_outputs(ensemble, df, NAMES, ["id"])))
        theirs = dict(values(models.with_probability(model, df), "id", "probability"))
        assert max(abs(ours[i] - theirs[i]) for i in theirs) < 1e-12


def test_best_round():
    assert models.best_round([0.5, 0.6, 0.55, 0.6, 0.58], 3) == (2, True)
    assert models.best_round([0.5, 0.6, 0.55, 0.6], 3) == (2, False)
    assert models.best_round([None, None], 1) == (1, True)
    # A higher area after the stop is not looked at.
    assert models.best_round([0.5, 0.4, 0.4, 0.9], 2) == (1, True)


def test_noise_rounds_are_cut(spark, tmp_path):
    """Labels follow one feature and noise: rounds after the first good ones only fit the noise."""
    rng = np.random.default_rng(11)
    rows = [(i, float(a), float(b), float(rng.random() < (0.9 if a > 0.5 else 0.1)))
            for i, (a, b) in enumerate(rng.random((600, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    args = dict(key="id", features=["a", "b"], label="y", depth=4, step=0.3, patience=4, validation_share=0.3)
    model = models.train_boosted(df, path=str(tmp_path / "long"), rounds=40, **args)
    kept = len(model.stages[-1].trees)
    assert 1 <= kept < 36
    # The kept trees are the first ones of the longer run, and survive saving.
    grown_stage = max((tmp_path / "long").glob("grown-*"), key=lambda p: int(p.name.split("-")[1]))
    assert kept < int(grown_stage.name.split("-")[1])
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    pick = ("id", "probability")
    assert sorted(values(models.with_probability(model, df), *pick)) == sorted(values(models.with_probability(again, df), *pick))


def test_constant_model_has_no_impacts(spark, tmp_path):
    df = spark.createDataFrame([(i, 1.0, 1.0, float(i % 2)) for i in range(20)], "id long, a double, b double, y double")
    model = models.train_forest(df, ["a", "b"], "y", n_trees=2, depth=3)
    explained = attribution.attribute(model, df, str(tmp_path / "flat"), ["id"], ["a", "b"])
    assert set(values(explained.select(F.inline("impacts")), "impact")) == {(0.0,)}


def test_saved_model_scores_the_same(spark, small, tmp_path):
    df, _ = small
    model = models.train_forest(df, NAMES, "y", n_trees=5, depth=4)
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    pick = ("id", "probability")
    assert sorted(values(models.with_probability(model, df), *pick)) == sorted(values(models.with_probability(again, df), *pick))


def test_models_beat_a_floor_on_claims(lake):
    for plan in (modeling.m02, modeling.m03):
        assert plan(lake).first()["roc_auc"] > 0.8


def test_scored_record(lake):
    model = modeling.forest(lake)
    gold = lake.gold("claims")
    scored = models.score(model, gold, ["ID"])
    assert scored.columns == ["ID", "claim_prediction", "claim_probability", "risk_tier", "risk_score"]
    # Inputs go by name: column order and stale derived columns do not matter.
    shuffled = gold.select(*reversed(gold.columns)).withColumn("risk_score", F.lit(0).cast("long"))
    assert sorted(values(models.score(model, shuffled, ["ID"]))) == sorted(values(scored))


def test_records_carry_the_largest_factors(lake):
    few = lake.gold("claims").where("ID % 20 = 0").cache()
    ensemble = modeling.nodes(lake, modeling.forest)
    records = {r["ID"]: r for r in models.score_records(ensemble, few, ["ID"], factors=5).collect()}
    plain = {r["ID"]: r for r in models.score(modeling.forest(lake), few, ["ID"]).collect()}
    impacts = {r["ID"]: r["impacts"] for r in attribution.attribute(ensemble, few, None, ["ID"]).collect()}
    assert records.keys() == plain.keys()
    for i, r in records.items():
        assert all(r[c] == plain[i][c] for c in plain[i].asDict())
        best = sorted(impacts[i], key=lambda e: (-abs(e["impact"]), e["feature"]))[:5]
        assert [e["feature"] for e in r["top_risk_factors"]] == [e["feature"] for e in best]
        assert [e["impact"] for e in r["top_risk_factors"]] == pytest.approx([e["impact"] for e in best], abs=5.1e-5)


def test_rounds_curve_has_a_row_per_tree(lake):
    model = modeling.boosted(lake)
    curve = modeling.m12(lake).collect()
    assert [r["round"] for r in curve] == list(range(1, len(model.stages[-1].trees) + 1))
    _, test = sampling.train_and_test(lake.gold("claims"), "ID")
    last = metrics.roc_auc(models.with_probability(model, test), "OUTCOME", "probability").first()[0]
    assert curve[-1]["roc_auc"] == pytest.approx(last, abs=1e-9)


def test_assembled_features_keep_their_order(lake):
    model = modeling.forest(lake)
    assert model.stages[0].getInputCols() == list(FEATURES)
    row = model.stages[0].transform(lake.gold("claims")).select(vector_to_array("features").alias("v"), *FEATURES).first()
    assert row["v"] == [float(row[f]) for f in FEATURES]


def test_factor_ranking(spark):
    df = spark.createDataFrame(
        [(1, [("b", -2.0), ("a", 2.0), ("c", 0.5), ("d", -3.0)])], "id int, impacts array<struct<feature:string,impact:double>>"
    )
    got = values(attribution.factor_rows(df, ["id"], 3), "rank", "feature", "impact", "direction")
    assert got == [(1, "d", -3.0, "reduces"), (2, "a", 2.0, "increases"), (3, "b", -2.0, "reduces")]
    assert values(attribution.importance(df)) == [("d", 3.0), ("a", 2.0), ("b", 2.0), ("c", 0.5)]


def test_forest_keeps_the_nodes_of_rows_between_levels(spark, monkeypatch):
    df = spark.range(400).selectExpr("double(id % 7) a", "double(id % 11) b", "double(id % 7 > 3) y")
    kept = models.train_forest(df, ["a", "b"], "y", n_trees=3, depth=4).stages[-1]
    assert kept.getCacheNodeIds()
    plain = models.RandomForestClassifier
    monkeypatch.setattr(models, "RandomForestClassifier", lambda **kw: plain(**{**kw, "cacheNodeIds": False}))
    assert models.train_forest(df, ["a", "b"], "y", n_trees=3, depth=4).stages[-1].toDebugString.split("\n")[1:] == \
        kept.toDebugString.split("\n")[1:]
