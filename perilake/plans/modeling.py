"""Model plans: split, training, scoring, quality figures, attribution.

Trained plans fit the full ensembles: 200 trees of depth 10, and up to 500 rounds of
depth 6. Plans named ``declared`` send the same operators over an ensemble that is written
out here, which SQL can score by CASE and attribute by enumerating subsets.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from perilake.functions.numeric import round_to
from perilake.functions.ordering import top
from perilake.operators import attribution, metrics, models, sampling, trees
from perilake.plans.catalog import plan
from perilake.plans.checksql import over_claims
from perilake.sources import files
from perilake.sources.schemas import FEATURES, TARGET


@plan(
    "m01_stratified_split",
    over_claims(
        """SELECT ID, OUTCOME, CAST(substr(md5(CAST(ID AS VARCHAR) || '-42'), 1, 8) < '33333333' AS INTEGER)
        AS is_test FROM gold_claims"""
    ),
)
def m01(lake):
    return sampling.stratified_split(lake.gold("claims"), "ID").select("ID", "OUTCOME", "is_test")


@plan(
    "m01_exact_split",
    over_claims(
        """SELECT ID, OUTCOME, CAST(row_number() OVER (PARTITION BY OUTCOME ORDER BY md5(CAST(ID AS VARCHAR) || '-42'))
        <= ceil(0.2 * count(*) OVER (PARTITION BY OUTCOME)) AS INTEGER) AS is_test FROM gold_claims"""
    ),
)
def m01_exact(lake):
    return sampling.exact_split(lake.gold("claims"), TARGET, "ID").select("ID", "OUTCOME", "is_test")


def split(lake) -> tuple[DataFrame, DataFrame]:
    return sampling.train_and_test(lake.gold("claims"), "ID")


def forest(lake):
    return lake.model("forest", lambda: models.train_forest(split(lake)[0]))


def boosted(lake):
    return lake.model(
        "boosted", lambda: models.train_boosted(split(lake)[0], "ID", lake.store.fresh_path("models", "boosted_growth")))


def nodes(lake, kind) -> trees.Ensemble:
    """Node arrays of a trained model, read from its saved form once per lake."""
    known = lake.__dict__.setdefault("ensembles", {})
    if kind not in known:
        known[kind] = trees.stored_ensemble(lake.spark, kind(lake), lake.store.fresh_path("models", "nodes"))
    return known[kind]


def held_out_scores(lake, model) -> DataFrame:
    scored = models.with_probability(model, split(lake)[1])
    return scored.select("ID", F.col(TARGET).cast("int").alias("label"), F.col("probability").alias("score"))


def quality(scores: DataFrame) -> DataFrame:
    return metrics.quality(scores, "label", "score")


@plan("m02_forest_quality")
def m02(lake):
    return quality(held_out_scores(lake, forest(lake)))


@plan("m03_boosted_quality")
def m03(lake):
    return quality(held_out_scores(lake, boosted(lake)))


@plan("m04_batch_scores")
def m04(lake):
    return models.score(forest(lake), lake.gold("claims"), keep=["ID"])


@plan("a08_reloaded_model_scores")
def a08(lake):
    path = lake.store.fresh_path("models", "forest_copy")
    models.save_model(forest(lake), path)
    return models.score(models.load_model(path), lake.gold("claims"), keep=["ID"])


# --- quality figures on a given score, checked by SQL ------------------------


def given_score() -> Column:
    return (F.col("risk_score") * 7 + F.col("ID") % 13) / F.lit(200.0)


def other_score() -> Column:
    return (F.col("risk_score") * 5 + F.col("ID") % 7) / F.lit(150.0)


def given(lake) -> DataFrame:
    return lake.gold("claims").select(
        "ID",
        F.col(TARGET).cast("int").alias("label"),
        given_score().alias("score"),
        (given_score() >= 0.5).cast("int").alias("said"),
    )


_GIVEN = """given AS (SELECT ID, CAST(OUTCOME AS INTEGER) AS label,
  (risk_score * 7 + ID % 13) / 200.0::DOUBLE AS score FROM gold_claims)"""
_CELLS = """cells AS (SELECT count(*) FILTER (label = 0 AND score < 0.5) AS tn,
  count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn,
  count(*) FILTER (label = 1 AND score >= 0.5) AS tp FROM given)"""
_AUC = """SELECT {by} CAST(sum(CASE WHEN a.score > b.score THEN 2 WHEN a.score = b.score THEN 1 ELSE 0 END
    * a.n::HUGEINT * b.n) AS DOUBLE) / 2 / (sum(a.n::HUGEINT * b.n)::DOUBLE) AS roc_auc
  FROM (SELECT {cols} score, count(*) AS n FROM given WHERE label = 1 GROUP BY ALL) a
  JOIN (SELECT {cols} score, count(*) AS n FROM given WHERE label = 0 GROUP BY ALL) b ON {on} {group}"""
_PLAIN_AUC = _AUC.format(by="", cols="", on="true", group="")


@plan(
    "m05_confusion",
    over_claims("SELECT *, (tn + tp)::DOUBLE / (tn + fp + fn + tp) AS accuracy FROM cells", _GIVEN, _CELLS),
)
def m05(lake):
    return metrics.accuracy(metrics.confusion(given(lake), "label", "said"))


@plan("m06_roc_auc", over_claims(_PLAIN_AUC, _GIVEN))
def m06(lake):
    return metrics.roc_auc(given(lake), "label", "score")


_REPORT = """per_class AS (
  SELECT '0' AS class, tn::DOUBLE / (tn + fn) AS precision, tn::DOUBLE / (tn + fp) AS recall, tn + fp AS support
  FROM cells UNION ALL
  SELECT '1', tp::DOUBLE / (tp + fp), tp::DOUBLE / (tp + fn), fn + tp FROM cells),
with_f1 AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM per_class)"""
_REPORT_ROWS = """SELECT class, precision, recall, f1, support FROM with_f1
UNION ALL SELECT 'accuracy', r, r, r, n
  FROM (SELECT (tn + tp)::DOUBLE / (tn + fp + fn + tp) AS r, tn + fp + fn + tp AS n FROM cells)
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM with_f1
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM with_f1"""


@plan("m07_classification_report", over_claims(_REPORT_ROWS, _GIVEN, _CELLS, _REPORT))
def m07(lake):
    return metrics.classification_report(metrics.confusion(given(lake), "label", "said"))


@plan(
    "m08_business_rates",
    over_claims(
        """SELECT round(tp::DOUBLE / (tp + fn) * 100, 1) AS detection_rate,
        round(fp::DOUBLE / (fp + tn) * 100, 1) AS false_alert_rate FROM cells""",
        _GIVEN,
        _CELLS,
    ),
)
def m08(lake):
    return metrics.business_rates(metrics.confusion(given(lake), "label", "said"))


_TWO = """given AS (
  SELECT 'first' AS model, CAST(OUTCOME AS INTEGER) AS label, (risk_score * 7 + ID % 13) / 200.0::DOUBLE AS score
  FROM gold_claims UNION ALL
  SELECT 'second', CAST(OUTCOME AS INTEGER), (risk_score * 5 + ID % 7) / 150.0::DOUBLE FROM gold_claims),
cells AS (SELECT model, count(*) FILTER (label = 0 AND score < 0.5) AS tn,
  count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn,
  count(*) FILTER (label = 1 AND score >= 0.5) AS tp FROM given GROUP BY model)"""
_TWO_AUC = "auc AS (" + _AUC.format(by="a.model,", cols="model,", on="a.model = b.model", group="GROUP BY a.model") + ")"
_TWO_LONG = """figures AS (
  SELECT model, 'accuracy' AS metric, (tn + tp)::DOUBLE / (tn + fp + fn + tp) AS value FROM cells
  UNION ALL SELECT model, 'recall_claim', tp::DOUBLE / (tp + fn) FROM cells
  UNION ALL SELECT model, 'detection_rate', round(tp::DOUBLE / (tp + fn) * 100, 1) FROM cells
  UNION ALL SELECT model, 'false_alert_rate', round(fp::DOUBLE / (fp + tn) * 100, 1) FROM cells
  UNION ALL SELECT model, 'roc_auc', roc_auc FROM auc)"""


def two_models(lake) -> DataFrame:
    """Rows (model, label, score), both scores from one scan."""
    both = F.array(
        F.struct(F.lit("first").alias("model"), given_score().alias("score")),
        F.struct(F.lit("second").alias("model"), other_score().alias("score")),
    )
    return lake.gold("claims").select(F.col(TARGET).cast("int").alias("label"), F.inline(both))


@plan(
    "m09_compare_models",
    over_claims(
        """SELECT metric, max(value) FILTER (model = 'first') AS first, max(value) FILTER (model = 'second') AS second
        FROM figures GROUP BY metric""",
        _TWO,
        _TWO_AUC,
        _TWO_LONG,
    ),
)
def m09(lake):
    return metrics.compare_models(two_models(lake), ["first", "second"], "label", "score")


@plan("m09_forest_and_boosted")
def m09_trained(lake):
    rows = held_out_scores(lake, forest(lake)).withColumn("model", F.lit("forest")).unionByName(
        held_out_scores(lake, boosted(lake)).withColumn("model", F.lit("boosted"))
    )
    return metrics.compare_models(rows, ["boosted", "forest"], "label", "score")


@plan(
    "a07_metrics_file",
    over_claims(
        "SELECT round((tn + tp)::DOUBLE / (tn + fp + fn + tp), 4) AS accuracy, round(roc_auc, 4) AS roc_auc FROM cells, auc",
        _GIVEN,
        _CELLS,
        f"auc AS ({_PLAIN_AUC})",
    ),
)
def a07(lake):
    path = lake.store.fresh_path("models", "metrics_json")
    both = quality(given(lake).select("label", "score"))
    rounded = both.select(*[round_to(F.col(c), 4).alias(c) for c in ("accuracy", "roc_auc")])
    files.write_metrics(rounded, path)
    return files.read_metrics(lake.spark, path, rounded.schema)


# --- attribution -------------------------------------------------------------


@plan("m10_attribution")
def m10(lake):
    explained = attribution.attribute(nodes(lake, forest), lake.gold("claims"), None, keep=["ID"])
    return explained.select("ID", "base", F.inline("impacts"))


@plan("m10_boosted_attribution")
def m10_boosted(lake):
    explained = attribution.attribute(nodes(lake, boosted), lake.gold("claims"), None, keep=["ID"])
    return attribution.factor_rows(explained, ["ID"], 3)


@plan("m11_forest_importance")
def m11_forest(lake):
    return attribution.importance(attribution.attribute(nodes(lake, forest), split(lake)[1], None, keep=["ID"]))


@plan("m12_rounds_curve")
def m12(lake):
    return models.rounds_curve(nodes(lake, boosted), split(lake)[1])


@plan("m04_scored_records")
def m04_records(lake):
    """Scored test rows of the trained forest with premium and the three largest factors."""
    records = models.score_records(nodes(lake, forest), split(lake)[1], keep=["ID"])
    return reasons(records)


def reasons(records: DataFrame) -> DataFrame:
    """One row per record and factor, so that no column is nested."""
    return records.select("*", F.posexplode("top_risk_factors").alias("place", "factor")).select(
        "ID", "claim_prediction", "claim_probability", "risk_tier", "risk_score", "suggested_premium",
        (F.col("place") + 1).alias("rank"), "factor.*")


# --- the same operators over a declared ensemble, checked by SQL ---------------

# (feature, cut, share that goes left, left, right); leaves are numbers. All figures are
# multiples of powers of two, so sums of a few of them are exact.
DECLARED = (
    ("risk_score", 4.0, 0.5,
     ("PAST_ACCIDENTS", 1.0, 0.75, 0.125, ("CREDIT_SCORE", 0.5, 0.5, 0.75, 0.375)),
     ("DUIS", 0.0, 0.25, ("SPEEDING_VIOLATIONS", 1.0, 0.5, 0.5, 0.875), ("risk_score", 8.0, 0.75, 0.625, 1.0))),
    ("AGE", 1.0, 0.5,
     ("risk_score", 6.0, 0.75, ("INCOME", 1.0, 0.5, 0.0, ("VEHICLE_YEAR", 0.0, 0.25, 0.25, 0.3125)), 0.875),
     ("ANNUAL_MILEAGE", 15000.0, 0.5, 0.375, ("AGE", 2.0, 0.5, 0.6875, 0.1875))),
    ("CREDIT_SCORE", 0.25, 0.25, 0.5, ("risk_score", 10.0, 0.875, ("CREDIT_SCORE", 0.75, 0.5, 0.4375, 0.25), 0.9375)),
    ("high_mileage_flag", 0.0, 0.75, ("GENDER", 0.0, 0.5, 0.25, 0.5), ("MARRIED", 0.0, 0.5, 0.75, ("CHILDREN", 0.0, 0.5, 0.5, 0.625))),
)
#: Log-odds of a boosted model of four rounds, by moving the same leaves around nothing.
SHIFT = 0.5


def numbered_tree(node, shift: float = 0.0):
    """A declared tree with the places of its features, leaves moved by ``-shift``."""
    if not isinstance(node, tuple):
        return node - shift
    return (FEATURES.index(node[0]), node[1], node[2], numbered_tree(node[3], shift), numbered_tree(node[4], shift))


def declared(boosted: bool = False) -> trees.Ensemble:
    shift, weight = (SHIFT, 1.0) if boosted else (0.0, 1.0 / len(DECLARED))
    return trees.declared_ensemble([numbered_tree(t, shift) for t in DECLARED], weight, boosted)


def _case(node, shift: float = 0.0) -> str:
    if not isinstance(node, tuple):
        return f"{node - shift}::DOUBLE"
    return f"CASE WHEN {node[0]} <= {node[1]} THEN {_case(node[3], shift)} ELSE {_case(node[4], shift)} END"


def _paths(node, box=()):
    """Leaves as (value, {feature: (conditions, share that stays)})."""
    if not isinstance(node, tuple):
        merged: dict[str, tuple[list[str], float]] = {}
        for name, condition, share in box:
            had, stay = merged.get(name, ([], 1.0))
            merged[name] = ([*had, condition], stay * share)
        return [(node, merged)]
    name, cut, share, left, right = node
    return _paths(left, (*box, (name, f"{name} <= {cut}", share))) + _paths(right, (*box, (name, f"NOT {name} <= {cut}", 1 - share)))


def _shapley_sql(feature: str, weight: float, shift: float) -> str:
    """Sum over leaves and over subsets of the other features of the leaf's path."""
    terms = ["0.0::DOUBLE"]
    for value, path in [leaf for tree in DECLARED for leaf in _paths(tree)]:
        if feature not in path:
            continue
        bit = {n: "CASE WHEN " + " AND ".join(c) + " THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for n, (c, _) in path.items()}
        others = [n for n in path if n != feature]
        subsets = []
        for size in range(len(others) + 1):
            share = factorial(size) * factorial(len(others) - size) / factorial(len(others) + 1)
            for known in combinations(others, size):
                product = [f"({bit[n]})" if n in known else f"{path[n][1]}::DOUBLE" for n in others]
                subsets.append(" * ".join([f"{share!r}::DOUBLE", *product]))
        terms.append(f"{(value - shift) * weight!r}::DOUBLE * (({bit[feature]}) - {path[feature][1]}::DOUBLE) * ({' + '.join(subsets)})")
    return " + ".join(terms)


_SHARES = " + ".join(f"({_case(t)})" for t in DECLARED)
_ODDS = " + ".join(f"({_case(t, SHIFT)})" for t in DECLARED)
_DECLARED = f"""outputs AS (SELECT *, ({_SHARES}) / {len(DECLARED)}.0::DOUBLE AS forest_score,
    1.0::DOUBLE / (1.0::DOUBLE + exp(-({_ODDS}))) AS boosted_score FROM gold_claims)"""


def _impacts_sql(boosted: bool) -> str:
    shift, weight = (SHIFT, 1.0) if boosted else (0.0, 1.0 / len(DECLARED))
    return "impacts AS (" + " UNION ALL ".join(
        f"SELECT ID, '{n}' AS feature, round({_shapley_sql(n, weight, shift)}, 9) + 0.0 AS impact FROM gold_claims" for n in FEATURES) + ")"


def _base(boosted: bool) -> float:
    shift, weight = (SHIFT, 1.0) if boosted else (0.0, 1.0 / len(DECLARED))
    total = 0.0
    for value, path in [leaf for tree in DECLARED for leaf in _paths(tree)]:
        for _, stay in path.values():
            value *= stay
        total += value * weight
    return total - (shift * weight * len(DECLARED))


def held_out_sql(score: str) -> str:
    return f"""given AS (SELECT ID, CAST(OUTCOME AS INTEGER) AS label, {score} AS score FROM outputs
      WHERE substr(md5(CAST(ID AS VARCHAR) || '-42'), 1, 8) < '33333333')"""


_QUALITY = f"SELECT *, (tn + tp)::DOUBLE / (tn + fp + fn + tp) AS accuracy, (SELECT roc_auc FROM ({_PLAIN_AUC})) AS roc_auc FROM cells"


def declared_scores(lake, boosted: bool = False) -> DataFrame:
    scored = trees.with_outputs(declared(boosted), split(lake)[1], FEATURES, ["ID", TARGET])
    return scored.select("ID", F.col(TARGET).cast("int").alias("label"), F.col("probability").alias("score"))


@plan("m02_declared_forest_quality", over_claims(_QUALITY, _DECLARED, held_out_sql("forest_score"), _CELLS))
def m02_declared(lake):
    return quality(declared_scores(lake))


@plan("m03_declared_boosted_quality", over_claims(_QUALITY, _DECLARED, held_out_sql("round(boosted_score, 12)"), _CELLS))
def m03_declared(lake):
    return quality(declared_scores(lake, True).withColumn("score", round_to(F.col("score"), 12)))


_RECORD = """ID, CAST(forest_score >= 0.5 AS INTEGER) AS claim_prediction, round(forest_score, 4) AS claim_probability,
    CASE WHEN risk_score >= 6 THEN 'High' WHEN risk_score >= 3 THEN 'Medium' ELSE 'Low' END AS risk_tier, risk_score"""


@plan(
    "m04_declared_records",
    over_claims(
        f"""SELECT {_RECORD.replace("ID,", "outputs.ID,", 1)}, 400 + 100 * risk_score + 150 * PAST_ACCIDENTS AS suggested_premium,
        CAST(rank AS INTEGER) AS rank, feature, round(impact, 4) + 0.0 AS impact,
        CASE WHEN impact > 0 THEN 'increases' ELSE 'reduces' END AS direction
        FROM outputs JOIN ranked ON outputs.ID = ranked.ID WHERE rank <= 3""",
        _DECLARED,
        _impacts_sql(False),
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY abs(impact) DESC, feature) AS rank FROM impacts)""",
    ),
)
def m04_declared(lake):
    return reasons(models.score_records(declared(), lake.gold("claims"), keep=["ID"], digits=9))


@plan("a08_declared_reloaded_scores", over_claims("SELECT ID, forest_score AS probability FROM outputs", _DECLARED))
def a08_declared(lake):
    path = lake.store.fresh_path("models", "declared")
    trees.save_ensemble(lake.spark, declared(), path)
    return trees.with_outputs(trees.load_ensemble(lake.spark, path), lake.gold("claims"), FEATURES, ["ID"])


@plan(
    "m09_declared_models",
    over_claims(
        """SELECT metric, max(value) FILTER (model = 'boosted') AS boosted, max(value) FILTER (model = 'forest') AS forest
        FROM figures GROUP BY metric""",
        _DECLARED,
        held_out_sql("forest_score").replace("given AS", "one AS"),
        held_out_sql("round(boosted_score, 12)").replace("given AS", "two AS"),
        "given AS (SELECT 'forest' AS model, label, score FROM one UNION ALL SELECT 'boosted', label, score FROM two)",
        """cells AS (SELECT model, count(*) FILTER (label = 0 AND score < 0.5) AS tn,
          count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn,
          count(*) FILTER (label = 1 AND score >= 0.5) AS tp FROM given GROUP BY model)""",
        _TWO_AUC,
        _TWO_LONG,
    ),
)
def m09_declared(lake):
    rounded = declared_scores(lake, True).withColumn("score", round_to(F.col("score"), 12))
    rows = declared_scores(lake).withColumn("model", F.lit("forest")).unionByName(rounded.withColumn("model", F.lit("boosted")))
    return metrics.compare_models(rows, ["boosted", "forest"], "label", "score")


def declared_impacts(lake, boosted: bool = False) -> DataFrame:
    """Attribution of the declared ensemble, impacts to nine digits."""
    explained = attribution.attribute(declared(boosted), lake.gold("claims"), None, keep=["ID"])
    rounded = F.transform(
        "impacts", lambda e: F.struct(e["feature"].alias("feature"), (round_to(e["impact"], 9) + 0.0).alias("impact")))
    return explained.withColumn("impacts", rounded)


@plan("m10_declared_attribution", over_claims(f"SELECT ID, {_base(False)!r}::DOUBLE AS base, feature, impact FROM impacts", _impacts_sql(False)))
def m10_declared(lake):
    return declared_impacts(lake).select("ID", round_to(F.col("base"), 12).alias("base"), F.inline("impacts"))


@plan(
    "m10_declared_boosted_factors",
    over_claims(
        """SELECT ID, CAST(rank AS INTEGER) AS rank, feature, impact, abs(impact) AS size,
        CASE WHEN impact > 0 THEN 'increases' ELSE 'reduces' END AS direction FROM
        (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY abs(impact) DESC, feature) AS rank FROM impacts) WHERE rank <= 5""",
        _impacts_sql(True),
    ),
)
def m10_declared_boosted(lake):
    return attribution.factor_rows(declared_impacts(lake, True), ["ID"], 5)


_STORED = """SELECT feature, CAST(sum(CAST(abs(impact) AS DECIMAL(24,10))) AS DOUBLE) / count(*) AS importance
    FROM impacts GROUP BY feature"""


@plan("m11_declared_importance", over_claims(_STORED, _impacts_sql(False)))
def m11_declared(lake):
    return attribution.importance(declared_impacts(lake))


@plan("a07_importance_file", over_claims(f"SELECT feature, round(importance, 6) AS importance FROM ({_STORED})", _impacts_sql(False)))
def a07_importance(lake):
    """Importance stored beside the model and read back, as a report shows it."""
    path = lake.store.fresh_path("models", "importance_json")
    rows = attribution.importance(declared_impacts(lake))
    files.write_metrics(rows.select("feature", round_to(F.col("importance"), 6).alias("importance")), path)
    return files.read_metrics(lake.spark, path, rows.select("feature", "importance").schema)


_CURVE = "curve AS (" + " UNION ALL ".join(
    f"SELECT CAST({n} AS INTEGER) AS round, ID, {' + '.join(f'({_case(t, SHIFT)})' for t in DECLARED[:n])} AS score FROM gold_claims"
    for n in range(1, len(DECLARED) + 1)) + ")"


@plan(
    "m12_declared_rounds_curve",
    over_claims(
        """SELECT losses.round, loss, roc_auc FROM (SELECT round, round(avg(2 * ln(1 + exp(CASE WHEN label = 1 THEN -score ELSE score END))), 8)
          AS loss FROM given GROUP BY round) losses JOIN auc ON auc.round = losses.round ORDER BY losses.round""",
        _CURVE,
        """given AS (SELECT round, CAST(OUTCOME AS INTEGER) AS label, score FROM curve JOIN gold_claims ON curve.ID = gold_claims.ID
          WHERE substr(md5(CAST(curve.ID AS VARCHAR) || '-42'), 1, 8) < '33333333')""",
        "auc AS (" + _AUC.format(by="a.round,", cols="round,", on="a.round = b.round", group="GROUP BY a.round") + ")",
    ),
)
def m12_declared(lake):
    curve = models.rounds_curve(declared(True), split(lake)[1])
    return curve.select("round", round_to(F.col("loss"), 8).alias("loss"), "roc_auc")


def given_impacts(lake) -> DataFrame:
    """A computable impact table: one signed figure per driver and feature."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                (((F.col("ID") * (31 + 2 * i) + F.col("risk_score") * 17) % 201 - 100) / F.lit(1000.0)).alias("impact"),
            )
            for i, name in enumerate(FEATURES)
        ]
    )
    return lake.gold("claims").select("ID", entries.alias("impacts"))


_IMPACTS = "impacts AS (" + " UNION ALL ".join(
    f"""SELECT ID, '{name}' AS feature, ((ID * {31 + 2 * i} + risk_score * 17) % 201 - 100) / 1000.0::DOUBLE AS impact
    FROM gold_claims"""
    for i, name in enumerate(FEATURES)
) + ")"
_MEAN = "CAST(sum(CAST(abs(impact) AS DECIMAL(24,10))) AS DOUBLE) / count(*)"
_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY abs(impact) DESC, feature) AS rank
  FROM impacts)"""


def _ranked_sql(k: int) -> str:
    return over_claims(
        f"""SELECT ID, CAST(rank AS INTEGER) AS rank, feature, impact, abs(impact) AS size,
        CASE WHEN impact > 0 THEN 'increases' ELSE 'reduces' END AS direction FROM ranked WHERE rank <= {k}""",
        _IMPACTS,
        _RANKED,
    )


@plan("t04_top3_factors", _ranked_sql(3))
def t04(lake):
    return attribution.factor_rows(given_impacts(lake), ["ID"], 3)


@plan("t04_top5_factors", _ranked_sql(5))
def t04_five(lake):
    return attribution.factor_rows(given_impacts(lake), ["ID"], 5)


@plan(
    "c17_direction",
    over_claims(
        """SELECT ID, feature, CASE WHEN impact > 0 THEN 'increases' ELSE 'reduces' END AS direction,
        abs(impact) AS size FROM ranked WHERE rank <= 17""",
        _IMPACTS,
        _RANKED,
    ),
)
def c17(lake):
    return attribution.factor_rows(given_impacts(lake), ["ID"], len(FEATURES)).select(
        "ID", "feature", "direction", "size"
    )


@plan("c18_absolute", over_claims("SELECT ID, feature, abs(impact) AS size FROM impacts", _IMPACTS))
def c18(lake):
    long = given_impacts(lake).select("ID", F.inline("impacts"))
    return long.select("ID", "feature", F.abs("impact").alias("size"))


@plan("m11_importance", over_claims(f"SELECT feature, {_MEAN} AS importance FROM impacts GROUP BY feature", _IMPACTS))
def m11(lake):
    return attribution.importance(given_impacts(lake))


@plan(
    "t03_top_importance",
    over_claims(
        f"""SELECT feature, {_MEAN} AS importance FROM impacts GROUP BY feature
        ORDER BY importance DESC, feature LIMIT 10""",
        _IMPACTS,
    ),
)
def t03(lake):
    return top(attribution.importance(given_impacts(lake)), "importance", ["feature"], 10)
