"""Classifier quality from (label, prediction) and (label, score) rows.

Every function takes optional ``by`` columns, so several models kept in one
long frame are measured in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from perilake.functions.numeric import round_to


def confusion(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    actual, said = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(*by).agg(
        F.count_if(~actual & ~said).alias("tn"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
        F.count_if(actual & said).alias("tp"),
    )


def _ratio(num: Column, den: Column) -> Column:
    """Quotient of two counts, zero where it is undefined."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def accuracy(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.select(*by, "tn", "fp", "fn", "tp", _ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"))


def business_rates(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of claims caught and of harmless drivers flagged, in percent."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def rate(part, rest):
        whole = (part + rest).cast("double")
        return round_to(F.try_divide(part.cast("double"), whole) * F.lit(100.0), 1)

    return cells.select(*by, rate(tp, fn).alias("detection_rate"), rate(fp, tn).alias("false_alert_rate"))


def classification_report(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows 0, 1, accuracy, macro avg, weighted avg from confusion cells."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def figures(hit, wrong, missed):
        precision, recall = _ratio(hit, hit + wrong), _ratio(hit, hit + missed)
        f1 = F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))
        return precision, recall, f1

    zero, one = figures(tn, fn, fp), figures(tp, fp, fn)
    n0, n1 = tn + fp, fn + tp
    total = n0 + n1
    right = _ratio(tn + tp, total)
    macro = [(a + b) / F.lit(2.0) for a, b in zip(zero, one)]
    weighted = [
        F.coalesce(F.try_divide(a * n0.cast("double") + b * n1.cast("double"), total.cast("double")), F.lit(0.0))
        for a, b in zip(zero, one)
    ]

    def row(name, values, support):
        names = ("precision", "recall", "f1")
        return F.struct(
            F.lit(name).alias("class"), *[v.alias(n) for n, v in zip(names, values)], support.alias("support")
        )

    rows = F.array(
        row("0", zero, n0), row("1", one, n1), row("accuracy", [right] * 3, total),
        row("macro avg", macro, total), row("weighted avg", weighted, total),
    )
    return cells.select(*by, F.inline(rows))


def score_table(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: ``_s``, ``pos``, ``neg``. A hot score is reduced in each task."""
    scored = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return scored.groupBy(*by, F.col(score).alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )


def score_quality(ties: DataFrame, by: Sequence[str] = (), at: float = 0.5) -> DataFrame:
    """Confusion cells at a threshold and the exact area under the ROC curve, ties counted half.

    ``ties`` is a score table. Its scores are range-partitioned, so scores that crowd in
    one place are spread like any others; running sums are made inside each range, and
    only the ranges' totals meet in one sum per model. Scores may be any numbers. An area
    of one class only is null.
    """
    by, wide = list(by), T.DecimalType(38, 0)
    ranged = ties.repartitionByRange(*by, "_s").withColumn("_part", F.spark_partition_id())
    upto = Window.partitionBy(*by, "_part").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    below = F.sum("neg").over(upto) - F.col("neg")
    # Twice the number of ordered pairs, so that half credit stays a whole number.
    inside = (F.col("pos").cast(T.DecimalType(18, 0)) * (below * 2 + F.col("neg")).cast(T.DecimalType(19, 0))).cast(wide)
    said = F.col("_s") >= F.lit(at)
    parts = ranged.withColumn("inside", inside).groupBy(*by, "_part").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("inside").alias("inside"),
        F.sum(F.when(said, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(said, F.col("neg")).otherwise(0)).alias("fp"))
    earlier = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("neg").over(earlier), F.lit(0))
    across = (F.col("pos").cast(T.DecimalType(18, 0)) * (before * 2).cast(T.DecimalType(19, 0))).cast(wide)
    total = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("pos", "neg", "tp", "fp")}
    return parts.withColumn("twice", F.col("inside") + across).groupBy(*by).agg(
        (total["neg"] - total["fp"]).alias("tn"), total["fp"].alias("fp"), (total["pos"] - total["tp"]).alias("fn"),
        total["tp"].alias("tp"),
        F.try_divide(F.sum("twice").cast("double") / F.lit(2.0), F.sum("pos").cast("double") * F.sum("neg").cast("double"))
        .alias("roc_auc"))


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve of each model, see ``score_quality``."""
    return score_quality(score_table(df, label, score, by), by).select(*by, "roc_auc")


def quality(df: DataFrame, label: str, score: str, by: Sequence[str] = (), at: float = 0.5) -> DataFrame:
    """Confusion cells, accuracy and area under the curve from one pass over the rows."""
    cells = score_quality(score_table(df, label, score, by), by, at)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.select(*by, "tn", "fp", "fn", "tp", _ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"), "roc_auc")


def compare_models(df: DataFrame, models: Sequence[str], label: str, score: str, at: float = 0.5) -> DataFrame:
    """Metric table with one column per model, from rows (model, label, score), each read once."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    rates = [round_to(F.try_divide(part.cast("double"), (part + rest).cast("double")) * F.lit(100.0), 1) for part, rest in ((tp, fn), (fp, tn))]
    figures = {"accuracy": F.col("accuracy"), "roc_auc": F.col("roc_auc"), "recall_claim": _ratio(tp, tp + fn),
               "detection_rate": rates[0], "false_alert_rate": rates[1]}
    long = F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in figures.items()])
    rows = quality(df, label, score, ["model"], at).select("model", F.inline(long))
    return rows.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))
