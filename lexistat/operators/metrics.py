"""Scores of long prediction tables (by..., y, p). Confusion counts come first, so classes and
groups of any size are added up inside the tasks before anything is shuffled."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSIFICATION = ("accuracy", "balanced_accuracy", "precision", "recall", "f1")
REGRESSION = ("r2", "mae", "mse", "rmse")
PRIMARY = {"classification": "accuracy", "regression": "r2"}


def class_counts(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., label, support, predicted, hits) for every true or predicted class."""
    pairs = predictions.groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(
        F.struct(F.col("y").cast("double").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("p").cast("double").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    ))
    return pairs.select(*by, sides.alias("s")).select(*by, "s.*").groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )


def classification_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, and support-weighted precision, recall and F1 (0 when undefined)."""
    counts = class_counts(predictions, by)
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    recall = F.when(support > 0, hits / support)
    precision = F.when(predicted > 0, hits / predicted).otherwise(0.0)
    f1 = F.when(support + predicted > 0, 2 * hits / (support + predicted)).otherwise(0.0)

    def weighted(x: Column) -> Column:
        return F.sum(support * F.coalesce(x, F.lit(0.0))) / F.sum(support)

    return counts.groupBy(*by).agg(
        (F.sum(hits) / F.sum(support)).alias("accuracy"),
        F.avg(recall).alias("balanced_accuracy"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
        weighted(f1).alias("f1"),
    )


def regression_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """R2, mean absolute error, mean squared error and its root, in one pass."""
    gap = F.col("y") - F.col("p")
    residual = F.sum(gap * gap)
    spread = F.var_pop("y") * F.count("y")
    r2 = (
        F.when(F.count("y") < 2, F.lit(None).cast("double"))
        .when(spread > 0, F.lit(1.0) - F.try_divide(residual, spread))
        .when(residual == 0, 1.0).otherwise(0.0)
    )
    return predictions.groupBy(*by).agg(
        r2.alias("r2"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
    )


def task_metrics(predictions: DataFrame, task: str, by: Sequence[str] = ()) -> DataFrame:
    return classification_metrics(predictions, by) if task == "classification" else regression_metrics(predictions, by)


def cv_score(predictions: DataFrame, task: str, by: Sequence[str] = ("target",)) -> DataFrame:
    """(by..., observed, cv_scores, cv_folds_used): the mean of the scores of the folds."""
    scores = task_metrics(predictions, task, [*by, "fold"]).select(
        *by, "fold", F.col(PRIMARY[task]).alias("score")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("fold", "score"))), lambda s: s["score"])
    return scores.groupBy(*by).agg(
        F.avg("score").alias("observed"), ordered.alias("cv_scores"),
        F.count(F.lit(1)).cast("int").alias("cv_folds_used"),
    )


def extra_metrics(
    predictions: DataFrame, task: str, names: Sequence[str], by: Sequence[str] = ("target",)
) -> DataFrame:
    """(by..., metric_<name>): pooled over all rows, unlike the observed score."""
    wanted = [n.strip().lower() for n in names if str(n).strip()]
    unknown = sorted(set(wanted) - set(CLASSIFICATION) - set(REGRESSION))
    if unknown:
        warnings.warn(f"Skipping unsupported metrics: {', '.join(unknown)}", RuntimeWarning)
    known = CLASSIFICATION if task == "classification" else REGRESSION
    table = task_metrics(predictions, task, by)
    return table.select(*by, *[F.col(n).alias(f"metric_{n}") for n in known if n in wanted])
