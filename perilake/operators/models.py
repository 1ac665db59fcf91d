"""Claim models on Spark ML: training, scoring and learning curves."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from perilake.functions import risk
from perilake.functions.numeric import exact_sum, round_to
from perilake.operators import boosting, forests, trees
from perilake.operators.attribution import top_factors
from perilake.operators.features import add_driver_features
from perilake.operators.metrics import score_quality
from perilake.operators.profiling import add_class_weight
from perilake.operators.sampling import hash_below
from perilake.sources.schemas import FEATURES, TARGET

#: Statistics of a forest's nodes that are gathered at a time; fewer passes over the rows than with Spark's 256.
FOREST_MB = 1024
#: Rows up to which Spark's trainers grow the trees; for 200 trees it keeps 1.8 KB a row. See ``forests`` and ``boosting`` for more rows.
SPARK_ROWS = 1_000_000


def train_forest(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    label: str = TARGET,
    n_trees: int = 200,
    depth: int = 10,
    seed: int = 42,
    spark_rows: int = SPARK_ROWS,
) -> PipelineModel:
    """Random forest with classes weighted to equal total weight.

    Up to ``spark_rows`` rows, Spark's trainer keeps each row's node in each tree from level
    to level, so that no level walks the trees from their roots again. The few levels need no
    checkpoint. More rows are counted by ``forests``, by the same rules with other draws.
    """
    rows = add_class_weight(df.select(*features, label), label)
    forest = RandomForestClassifier(
        labelCol=label, weightCol="weight", numTrees=n_trees, maxDepth=depth, seed=seed, maxMemoryInMB=FOREST_MB,
        cacheNodeIds=True, checkpointInterval=-1,
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    n, zero, one = df.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    if n <= spark_rows:
        return Pipeline(stages=[assembler, forest]).fit(rows)
    weights = tuple((zero + one) / (2.0 * k) if k else 1.0 for k in (zero, one))
    return PipelineModel([assembler, forests.fit(assembler.transform(rows), forest, n, weights)])


def train_boosted(
    df: DataFrame,
    key: str,
    path: str,
    features: Sequence[str] = FEATURES,
    label: str = TARGET,
    rounds: int = 500,
    depth: int = 6,
    step: float = 0.05,
    row_share: float = 0.8,
    column_share: float = 0.8,
    validation_share: float = 0.1,
    patience: int = 20,
    seed: int = 42,
    spark_rows: int = SPARK_ROWS,
) -> PipelineModel:
    """Boosted trees, positives weighted by neg/pos, cut where the area under the curve stops rising.

    Rounds are grown in runs of twice the length, until the area on held-back rows has
    not risen for ``patience`` rounds or there are ``rounds`` of them; the trees up to
    the best round stay. A longer run repeats a shorter one's rounds, so the result is
    that of growing all rounds first. The rows that decide are part of the training
    input, never of the test set. Stored ensembles go below ``path``. More rows than
    ``spark_rows`` are grown by ``boosting``, by the same rules with other draws; there a
    growth goes on from the rounds it has.
    """
    balanced = add_class_weight(df.select(key, *features, label), label)
    held = hash_below(F.col(key), validation_share, seed + 1)
    rows, judged = balanced.where(~held), balanced.where(held)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    boosted = GBTClassifier(
        labelCol=label,
        weightCol="weight",
        maxDepth=depth,
        stepSize=step,
        subsamplingRate=row_share,
        featureSubsetStrategy=str(column_share),
        seed=seed,
    )
    n, zero, one = df.agg(F.count_if(~held), F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    if n > spark_rows:
        weights = tuple((zero + one) / (2.0 * k) if k else 1.0 for k in (zero, one))
        growth = boosting.Growth(assembler.transform(rows), boosted, n, weights)
        grown = min(rounds, patience + 1)
        while True:
            growth.grow(grown)
            best, stopped = best_round(round_areas(growth.ensemble(), judged, label, features), patience)
            if stopped or grown >= rounds:
                break
            # No earlier round can be the last one; a few more are grown, so that areas are not taken every round.
            grown = min(rounds, max(best + patience, grown + patience // 2 + 1))
        model = growth.model(best)
        growth.close()
        return PipelineModel([assembler, model])
    grown = min(rounds, 2 * patience)
    while True:
        model = Pipeline(stages=[assembler, boosted.copy({boosted.maxIter: grown})]).fit(rows)
        ensemble = trees.stored_ensemble(df.sparkSession, model, f"{path}/grown-{grown}")
        best, stopped = best_round(round_areas(ensemble, judged, label, features), patience)
        if stopped or grown >= rounds:
            return first_rounds(model, best, f"{path}/grown-{grown}", f"{path}/kept")
        grown = min(rounds, 2 * grown)


def best_round(areas: Sequence[float | None], patience: int) -> tuple[int, bool]:
    """The round (from 1) after which no higher area came for ``patience`` rounds, and whether so many came."""
    best, top = 1, -1.0
    for i, area in enumerate(areas, start=1):
        if area is not None and area > top:
            best, top = i, area
        elif i - best >= patience:
            return best, True
    return best, False


def first_rounds(model: PipelineModel, rounds: int, stored: str, path: str) -> PipelineModel:
    """The pipeline with only the first rounds of its boosted stage, whose saved form lies at ``stored``."""
    spark = SparkSession.getActiveSession()
    for part, tree in (("data", "treeID"), ("treesMetadata", "_1")):
        spark.read.parquet(f"{stored}/{part}").where(F.col(tree) < rounds).coalesce(1).write.mode("overwrite").parquet(f"{path}/{part}")
    about = json.loads(spark.read.text(f"{stored}/metadata").first()[0])
    about["numTrees"] = rounds
    about["paramMap"]["maxIter"] = rounds
    boosting.write_about(spark, about, f"{path}/metadata")
    return PipelineModel([*model.stages[:-1], GBTClassificationModel.load(path)])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def with_probability(model: PipelineModel, df: DataFrame, name: str = "probability") -> DataFrame:
    """Add the probability of a claim; the model's own columns are dropped."""
    scored = model.transform(df).withColumn("_p", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("_p", name)


def score(model: PipelineModel, drivers: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Scored records; derived features are computed here, inputs go by name."""
    scored = with_probability(model, add_driver_features(drivers))
    return scored.select(
        *keep,
        risk.threshold(F.col("probability")).alias("claim_prediction"),
        round_to(F.col("probability"), 4).alias("claim_probability"),
        risk.risk_tier_label(F.col("risk_score")).alias("risk_tier"),
        "risk_score",
    )


def score_records(
    ensemble: trees.Ensemble, drivers: DataFrame, keep: Sequence[str] = (), factors: int = 3, features: Sequence[str] = FEATURES,
    digits: int | None = None,
) -> DataFrame:
    """Scored records with their reasons, from one pass over the rows.

    To the columns of ``score`` come ``suggested_premium`` and ``top_risk_factors``, the
    ``factors`` largest impacts: feature, impact to 4 digits and direction. ``digits``
    rounds impacts before they are ranked.
    """
    rows = add_driver_features(drivers)
    needed = list(dict.fromkeys([*keep, "risk_score", "PAST_ACCIDENTS"]))
    scored = trees.with_outputs(ensemble, rows, features, needed, impacts="impacts")
    impacts = F.col("impacts")
    if digits is not None:
        impacts = F.transform(impacts, lambda e: F.struct(e["feature"].alias("feature"), round_to(e["impact"], digits).alias("impact")))
    reasons = F.transform(
        top_factors(impacts, factors),
        lambda e: F.struct(e["feature"].alias("feature"), (round_to(e["impact"], 4) + 0.0).alias("impact"),
                           risk.direction(e["impact"]).alias("direction")),
    )
    return scored.select(
        *keep,
        risk.threshold(F.col("probability")).alias("claim_prediction"),
        round_to(F.col("probability"), 4).alias("claim_probability"),
        risk.risk_tier_label(F.col("risk_score")).alias("risk_tier"),
        "risk_score",
        risk.suggested_premium(F.col("risk_score"), F.col("PAST_ACCIDENTS")).alias("suggested_premium"),
        reasons.alias("top_risk_factors"),
    )


def rounds_curve(ensemble: trees.Ensemble, df: DataFrame, label: str = TARGET, features: Sequence[str] = FEATURES) -> DataFrame:
    """Loss and ROC-AUC on the given rows after each boosting round: round, loss, roc_auc."""
    ties = round_ties(ensemble, df, label, features)
    # The same loss as that of training: twice the log-loss, by log-odds.
    loss = F.lit(2.0) * (F.col("pos") * F.log1p(F.exp(-F.col("_s"))) + F.col("neg") * F.log1p(F.exp(F.col("_s"))))
    losses = ties.groupBy("round").agg(F.try_divide(exact_sum(loss, 9), F.sum(F.col("pos") + F.col("neg")).cast("double")).alias("loss"))
    return losses.join(score_quality(ties, ["round"], at=0.0).select("round", "roc_auc"), "round", "left").orderBy("round")


def round_areas(
    ensemble: trees.Ensemble, df: DataFrame, label: str = TARGET, features: Sequence[str] = FEATURES,
) -> list[float | None]:
    """ROC-AUC on the given rows after each boosting round."""
    areas = score_quality(round_ties(ensemble, df, label, features), ["round"], at=0.0)
    return [r["roc_auc"] for r in areas.select("round", "roc_auc").orderBy("round").collect()]


def round_ties(ensemble: trees.Ensemble, df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Rows (round, _s, pos, neg): the labels met at each log-odds after each round.

    One pass over the rows: a task walks its batch through all trees, adds the trees'
    parts up round by round, and sends one row per round and distinct log-odds. The
    plan is the same for any number of rounds.
    """
    shared = df.sparkSession.sparkContext.broadcast(ensemble)
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(features))])
            hit = batch.column("_y").to_numpy(zero_copy_only=False) == 1
            margins = np.cumsum(shared.value.parts(x), axis=1)
            for i in range(shared.value.trees):
                score, which = np.unique(margins[:, i], return_inverse=True)
                pos = np.bincount(which, hit, len(score)).astype(np.int64)
                neg = np.bincount(which, minlength=len(score)) - pos
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), i + 1, np.int32)), pa.array(score), pa.array(pos), pa.array(neg)],
                    names=["round", "_s", "pos", "neg"])

    return rows.mapInArrow(run, "round int, _s double, pos long, neg long").groupBy("round", "_s") \
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
