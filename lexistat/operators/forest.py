"""Random forests over folds and permutations: MLlib fits, a few at a time; the rows stay distributed."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexistat.operators.metrics import PRIMARY, task_metrics

DEEPEST = 30  # the greatest depth MLlib grows; stands for "no limit"
PARALLEL_FITS = 4


def make_forest(task: str, params: Mapping[str, Any], seed: int):
    depth = params.get("max_depth")
    common = dict(
        featuresCol="vector", labelCol="y", predictionCol="p", seed=seed,
        numTrees=int(params.get("n_estimators", 200)), maxDepth=DEEPEST if depth is None else int(depth),
    )
    if task == "classification":
        return RandomForestClassifier(featureSubsetStrategy="sqrt", **common)
    return RandomForestRegressor(featureSubsetStrategy="all", **common)


def _rows(data: DataFrame, perm: int, fold: Column) -> DataFrame:
    return data.select(
        "key", array_to_vector(F.col("features").cast("array<double>")).alias("vector"),
        F.element_at("ys", perm + 1).cast("double").alias("y"), fold.alias("fold"),
    )


def forest_predictions(
    data: DataFrame, task: str, folds: int, perms: int, grid: list[Mapping[str, Any]], seed: int,
    inner_k: int = 0,
) -> DataFrame:
    """(perm, key, fold, y, p): held-out predictions of every permutation, the observed labels first.

    `data` has key, features, ys, folds and, for tuning, inners. The driver only submits fits.
    """

    def fit_one(perm: int, fold: int) -> DataFrame:
        rows = _rows(data, perm, F.element_at("folds", perm + 1))
        params = grid[0]
        if len(grid) > 1 and inner_k:
            inner = F.element_at("inners", perm * folds + fold + 1)
            nested = _rows(data.where(F.element_at("folds", perm + 1) != fold), perm, inner)
            best = None
            for candidate in grid:
                scores = []
                for g in range(inner_k):
                    model = make_forest(task, candidate, seed).fit(nested.where(F.col("fold") != g))
                    held = model.transform(nested.where(F.col("fold") == g)).select("y", "p")
                    scores.append(task_metrics(held, task).first()[PRIMARY[task]])
                mean = sum(scores) / len(scores)
                if best is None or mean > best[0]:
                    best = (mean, candidate)
            params = best[1]
        model = make_forest(task, params, seed).fit(rows.where(F.col("fold") != fold))
        held = model.transform(rows.where(F.col("fold") == fold))
        return held.select(F.lit(perm).alias("perm"), "key", "fold", "y", "p")

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        jobs = [pool.submit(fit_one, p, f) for p in range(perms + 1) for f in range(folds)]
        parts = [job.result() for job in jobs]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
