"""Additive feature attribution of tree ensembles, and what is read from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from perilake.functions import risk
from perilake.functions.numeric import exact_avg
from perilake.functions.ordering import down, up
from perilake.operators import trees
from perilake.sources.schemas import FEATURES

IMPACT_SCALE = 10


def attribute(
    model: PipelineModel | trees.Ensemble,
    df: DataFrame,
    path: str | None,
    keep: Sequence[str],
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Columns ``keep``, ``base`` and ``impacts`` array<struct<feature, impact>>.

    Nodes of a fitted pipeline are stored at ``path`` on the way.
    """
    ensemble = model if isinstance(model, trees.Ensemble) else trees.stored_ensemble(df.sparkSession, model, path)
    explained = trees.with_outputs(ensemble, df, features, keep, probability=None, impacts="impacts")
    return explained.select(*keep, F.lit(ensemble.base()).alias("base"), "impacts")


def top_factors(impacts: Column, k: int) -> Column:
    """The k entries of largest absolute impact, ties by feature name; no shuffle."""
    keyed = F.transform(
        impacts, lambda e: F.struct((-F.abs(e["impact"])).alias("rank_key"), e["feature"].alias("feature"), e["impact"].alias("impact"))
    )
    return F.transform(
        F.slice(F.sort_array(keyed), 1, k),
        lambda e: F.struct(e["feature"].alias("feature"), e["impact"].alias("impact")),
    )


def factor_rows(df: DataFrame, keep: Sequence[str], k: int) -> DataFrame:
    """Ranked factors per record with the direction they push the risk."""
    ranked = df.select(*keep, F.posexplode(top_factors(F.col("impacts"), k)).alias("place", "factor"))
    impact = F.col("factor.impact")
    return ranked.select(
        *keep,
        (F.col("place") + 1).alias("rank"),
        F.col("factor.feature").alias("feature"),
        impact.alias("impact"),
        F.abs(impact).alias("size"),
        risk.direction(impact).alias("direction"),
    )


def importance(df: DataFrame) -> DataFrame:
    """Mean absolute impact per feature, largest first."""
    long = df.select(F.inline("impacts"))
    return (
        long.groupBy("feature")
        .agg(exact_avg(F.abs("impact"), IMPACT_SCALE).alias("importance"))
        .orderBy(down("importance"), up("feature"))
    )
