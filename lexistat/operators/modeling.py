"""Cross-validated models with permutation p-values for one or more targets."""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexistat.functions.ranks import hash_order, number_by_hash
from lexistat.functions.sums import matrix
from lexistat.operators import batched, gram
from lexistat.operators.embed import mean_pool_by_row, select_feature_set
from lexistat.operators.folds import (
    _by_size,
    _snake,
    detect_task,
    encode_label,
    fold_count,
    permute_labels,
    resolve_task,
)
from lexistat.operators.forest import forest_predictions
from lexistat.operators.inference import SCOPE_COLUMNS, adjust_pvalues, permutation_pvalue
from lexistat.operators.metrics import PRIMARY, cv_score, extra_metrics, task_metrics
from lexistat.operators.preprocess import Prep, max_components, resolve_components
from lexistat.operators.stack import align_features_targets, union_results

CLASSIFIERS = ("logistic", "linear_svm", "random_forest")
REGRESSORS = ("ridge", "lasso", "random_forest")
# Parameters each model starts from.
DEFAULTS: Mapping[str, Mapping[str, Any]] = {
    "logistic": {"C": 1.0}, "linear_svm": {"C": 1.0}, "ridge": {"alpha": 1.0}, "lasso": {"alpha": 0.1},
    "random_forest": {"n_estimators": 200, "max_depth": None},
}
METRIC_COLUMNS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "r2", "mae", "mse", "rmse")
RESULT_SCHEMA = (
    "target string, task string, metric_name string, observed double, p_value double, "
    "cv_scores array<double>, perm_scores array<double>, cv_folds_used int"
)
PREDICTION_SCHEMA = "target string, row_key string, fold int, y_true double, y_pred double"


@dataclass(frozen=True)
class ModelOptions:
    cv: int = 5
    n_permutations: int = 200
    run_permutation: bool = True
    seed: int = 42
    max_unique_for_class: int = 20
    classifier: str = "logistic"
    regressor: str = "ridge"
    classifier_params: Mapping[str, Any] = field(default_factory=dict)
    regressor_params: Mapping[str, Any] = field(default_factory=dict)
    scale: bool = True
    report_metrics: Sequence[str] = ()
    tune: bool = False
    classifier_grid: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    regressor_grid: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    feature_selection: str | None = None
    k_best: int = 200
    percentile: int = 20
    variance_threshold: float = 0.0
    reduce_method: str | None = None
    reduce_n_components: int | None = None
    reduce_components_grid: Sequence[int] = ()
    k_best_grid: Sequence[int] = ()
    percentile_grid: Sequence[int] = ()
    variance_threshold_grid: Sequence[float] = ()
    correction_method: str | None = "fdr_bh"
    task_mode: str = "auto"
    target_task_overrides: Mapping[str, str] = field(default_factory=dict)


def model_grid(options: ModelOptions, task: str, limit: int, d: int) -> list[tuple[Prep, dict[str, Any]]]:
    """Grid points in a fixed order; invalid values are left out. Without tuning, one point."""
    name = options.classifier if task == "classification" else options.regressor
    given = options.classifier_params if task == "classification" else options.regressor_params
    params = {**DEFAULTS[name], **given}
    components = resolve_components(options.reduce_method, options.reduce_n_components, limit)
    width = components or d
    base = Prep(
        options.scale, components, options.feature_selection, min(max(1, options.k_best), width),
        min(max(1, options.percentile), 100), options.variance_threshold,
    )
    if not options.tune:
        return [(base, params)]
    axes: list[tuple[str, list]] = []
    model_grid_values = options.classifier_grid if task == "classification" else options.regressor_grid
    for key in sorted(model_grid_values):
        axes.append((f"model.{key}", list(model_grid_values[key])))
    if options.reduce_components_grid and components is not None:
        values = sorted({int(c) for c in options.reduce_components_grid if 1 <= int(c) <= limit})
        _add_axis(axes, "n_components", values, "Reduction grid")
    if options.feature_selection == "kbest" and options.k_best_grid:
        values = sorted({int(k) for k in options.k_best_grid if 1 <= int(k) <= width})
        _add_axis(axes, "k_best", values, "KBest grid")
    elif options.feature_selection == "percentile" and options.percentile_grid:
        values = sorted({int(p) for p in options.percentile_grid if 1 <= int(p) <= 100})
        _add_axis(axes, "percentile", values, "Percentile grid")
    elif options.feature_selection == "variance" and options.variance_threshold_grid:
        _add_axis(axes, "variance_threshold", sorted({float(v) for v in options.variance_threshold_grid}),
                  "Variance threshold grid")
    if not axes:
        warnings.warn("No hyperparameter grid; skipping tuning.", RuntimeWarning)
        return [(base, params)]
    points = []
    for values in itertools.product(*[v for _, v in axes]):
        prep, own = base, dict(params)
        for (key, _), value in zip(axes, values):
            if key.startswith("model."):
                own[key[6:]] = value
            else:
                prep = replace(prep, **{key: value})
        points.append((prep, own))
    return points


def _add_axis(axes: list, name: str, values: list, title: str) -> None:
    if values:
        axes.append((name, values))
    else:
        warnings.warn(f"{title} empty after filtering invalid values.", RuntimeWarning)


def labelled_rows(
    aligned: DataFrame, task: str, k: int, seed: int, n_perm: int, inner_k: int, grouped: bool
) -> DataFrame:
    """(key, features, ys, folds, inners): labels and folds of every permutation on each row.

    Position 0 is the observed data. Class folds are dealt anew for each permutation, because they
    depend on the labels; regression folds are the same for all. `inners` holds, per permutation and
    outer fold, the inner fold of the row, or -1.
    """
    observed = aligned.select("key", F.lit(0).alias("perm"), "y")
    labels = observed
    if n_perm:
        labels = observed.unionByName(permute_labels(aligned.select("key", "y"), "key", "y", n_perm, seed))
    if grouped:
        labels = labels.join(aligned.select("key", "group"), "key")
    by_label = task == "classification"
    fixed = labels.where("perm = 0") if not by_label else labels
    dealt = _deal(fixed, k, f"{seed}", ["perm"], by_label, grouped, "fold")
    tables = [
        labels.groupBy("key").agg(_in_order("perm", F.col("y").cast("double")).alias("ys")),
        dealt.groupBy("key").agg(_in_order("perm", F.col("fold")).alias("folds")),
    ]
    if inner_k:
        outers = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        train = dealt.withColumn("outer", outers).where("fold <> outer")
        nested = _deal(train.drop("fold"), inner_k, f"{seed}:inner", ["perm", "outer"], by_label, grouped, "g")
        held = dealt.select("key", "perm", F.col("fold").alias("outer"), F.lit(-1).alias("g"))
        complete = nested.select("key", "perm", "outer", "g").unionByName(held).withColumn(
            "at", F.col("perm") * k + F.col("outer"))
        tables.append(complete.groupBy("key").agg(_in_order("at", F.col("g")).alias("inners")))
    out = aligned.select("key", "features")
    for table in tables:
        out = out.join(table, "key")
    return out


def _in_order(place: str, value) -> Any:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), value.alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


def _deal(
    rows: DataFrame, k: int, seed: str, within: list[str], by_label: bool, grouped: bool, out: str
) -> DataFrame:
    if grouped:
        sizes = rows.groupBy(*within, "group", "y").agg(F.count(F.lit(1)).alias("_n")).groupBy(
            *within, "group"
        ).agg(F.sum("_n").alias("_size"), F.max_by("y", F.struct(F.col("_n"), -F.col("y"))).alias("_main"))
        strata = [*within, "_main"] if by_label else within
        folds = _by_size(sizes, "group", "_size", strata).select(
            *within, "group", _snake(F.col("_rank"), k).alias(out)
        )
        return rows.join(folds, [*within, "group"])
    hashed = rows.withColumn("_hash", hash_order(seed, F.col("key")))
    strata = [*within, "y"] if by_label else within
    ranked = number_by_hash(hashed, "_hash", ["key"], strata, "_rank")
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_hash", "_rank")


@dataclass
class TargetRun:
    """What one target gave: scores[permutation, fold], and the held-out predictions."""

    scores: np.ndarray
    predictions: DataFrame


def _predict(data: DataFrame, heads: list, classify: bool) -> DataFrame:
    """(key, fold, y, p) of the observed labels, with the model of each row's own fold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["features"])
            fold = batch["fold"].to_numpy()
            p = np.empty(len(batch))
            for f in np.unique(fold):
                rows = fold == f
                if classify:
                    p[rows] = batched.predict_codes(x[rows], heads[f])
                else:
                    p[rows] = x[rows] @ heads[f].weights + heads[f].intercept
            yield pd.DataFrame({"key": batch["key"], "fold": fold, "y": batch["y"], "p": p})

    rows = data.select("key", "features", F.element_at("folds", 1).alias("fold"), F.element_at("ys", 1).alias("y"))
    kind = data.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, fold int, y double, p double")


def _run_linear(data: DataFrame, grid: list, model: str, k: int, inner_k: int) -> TargetRun:
    table = data.withColumn("fold", F.element_at("folds", 1))
    if inner_k:
        table = table.withColumnRenamed("inners", "inner")
    outer, nested = gram.fold_sums(table, k, inner_k)
    fits, scores, _ = gram.fit_folds(outer, nested, model, grid)
    return TargetRun(scores, _predict(data, [row[0] for row in fits], classify=False))


def _run_batched(
    data: DataFrame, grid: list, model: str, k: int, inner_k: int, perms: int, classes: int, d: int
) -> TargetRun:
    loss = "logistic" if model == "logistic" else "squared_hinge"
    cells = [(p, f) for p in range(perms + 1) for f in range(k)]
    choice = {cell: 0 for cell in cells}
    if len(grid) > 1 and inner_k:
        tried = [
            batched.ModelSpec(p, f, g, float(params["C"]), prep)
            for p, f in cells for prep, params in grid for g in range(inner_k)
        ]
        fitted = batched.train_models(data, tried, classes, d, k, loss)
        scores = batched.held_out_accuracy(data, tried, fitted, k).reshape(len(cells), len(grid), inner_k)
        choice = dict(zip(cells, scores.mean(axis=2).argmax(axis=1).tolist()))
    specs = [
        batched.ModelSpec(p, f, -1, float(grid[choice[p, f]][1]["C"]), grid[choice[p, f]][0]) for p, f in cells
    ]
    fitted = batched.train_models(data, specs, classes, d, k, loss)
    scores = batched.held_out_accuracy(data, specs, fitted, k).reshape(perms + 1, k)
    return TargetRun(scores, _predict(data, fitted[:k], classify=True))


def _run_forest(data: DataFrame, grid: list, task: str, k: int, inner_k: int, perms: int, seed: int) -> TargetRun:
    if task == "regression":  # the folds and inner folds are the same for all permutations
        data = data.withColumn("folds", F.flatten(F.array_repeat("folds", perms + 1)))
        if inner_k:
            data = data.withColumn("inners", F.flatten(F.array_repeat("inners", perms + 1)))
    if any(p.n_components is not None or p.selection is not None for p, _ in grid):
        raise ValueError("reduction and selection are available for the linear models only")
    held = forest_predictions(data, task, k, perms, [p for _, p in grid], seed, inner_k).persist()
    table = task_metrics(held, task, ["perm", "fold"]).select("perm", "fold", PRIMARY[task]).collect()
    scores = np.full((perms + 1, k), np.nan)
    for perm, fold, score in table:
        scores[perm, fold] = np.nan if score is None else score
    return TargetRun(scores, held.where("perm = 0").select("key", "fold", "y", "p"))


def _around_means(x: DataFrame) -> DataFrame:
    """The features less their means over all rows, so that sums of squares keep their digits.

    No result changes: every model has a free intercept, and each fold still takes its own training means off.
    """
    mean = x.where(F.col("features").isNotNull()).agg(
        vector_to_array(Summarizer.mean(array_to_vector("features"))).alias("mean")
    ).first()["mean"]
    if not mean:
        return x
    middle = F.lit(mean)
    return x.withColumn("features", F.zip_with("features", middle, lambda v, m: v - m))


def cross_validate(
    features: DataFrame, targets: DataFrame, key: str, names: Sequence[str],
    options: ModelOptions = ModelOptions(), groups: DataFrame | None = None, group: str | None = None,
    vector: str = "embedding",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, held-out predictions, skipped targets).

    `observed` is the mean of the fold scores; the extra metrics are pooled over all rows.
    """
    spark = features.sparkSession
    x = features.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("features"))
    shaped = x.agg(F.max(F.size("features"))).first()[0]
    x = _around_means(x)
    perms = int(options.n_permutations) if options.run_permutation else 0
    detected = {r["target"]: r["task"] for r in detect_task(targets, names, options.max_unique_for_class).collect()}
    rows, scored, held, skipped, kinds = [], [], [], [], {}
    for name in names:
        task = resolve_task(name, detected[name], options.task_mode, options.target_task_overrides)
        kinds[name] = task
        run, k, reason = _one_target(x, targets, key, name, task, shaped, perms, options, groups, group)
        if run is None or not np.isfinite(run.scores[0]).all():
            skipped.append((name, reason or "Non-finite CV score encountered"))
            warnings.warn(f"Skipping {name}: {skipped[-1][1]}", RuntimeWarning)
            continue
        means = run.scores.mean(axis=1)
        rows.append((name, task, PRIMARY[task], float(means[0]), [float(s) for s in run.scores[0]],
                     [float(s) for s in means[1:]], k))
        scored += [(name, i, float(s)) for i, s in enumerate(means[1:], start=1)]
        held.append(run.predictions.select(
            F.lit(name).alias("target"), F.col("key").cast("string").alias("row_key"), "fold",
            F.col("y").alias("y_true"), F.col("p").alias("y_pred"),
        ))
    results = spark.createDataFrame(
        rows, "target string, task string, metric_name string, observed double, cv_scores array<double>, "
        "perm_scores array<double>, cv_folds_used int"
    )
    tests = permutation_pvalue(
        spark.createDataFrame(scored, "target string, perm int, score double"), results
    ).select("target", "p_value")
    ordered = results.join(tests, "target", "left")
    predictions = union_results(held) if held else spark.createDataFrame([], PREDICTION_SCHEMA)
    for task in ("classification", "regression"):
        mine = [n for n in names if kinds[n] == task]
        wanted = [m for m in options.report_metrics]
        if mine and wanted and held:
            long = predictions.where(F.col("target").isin(*mine)).select(
                "target", F.col("y_true").alias("y"), F.col("y_pred").alias("p"))
            ordered = _join_metrics(ordered, extra_metrics(long, task, wanted))
    method = options.correction_method if perms else None
    adjusted = adjust_pvalues(ordered, method, None, "all_tests")
    missing = spark.createDataFrame(skipped, "target string, reason string")
    return adjusted, predictions, missing


def _join_metrics(results: DataFrame, extra: DataFrame) -> DataFrame:
    """Metric columns on the results; a metric of both tasks keeps the value that is there."""
    joined = results.join(extra.select("target", *[
        F.col(c).alias(f"_{c}") for c in extra.columns if c != "target"]), "target", "left")
    for c in extra.columns:
        if c != "target":
            old = F.col(c) if c in results.columns else F.lit(None).cast("double")
            joined = joined.withColumn(c, F.coalesce(old, F.col(f"_{c}"))).drop(f"_{c}")
    return joined


def _one_target(
    x: DataFrame, targets: DataFrame, key: str, name: str, task: str, d: int, perms: int,
    options: ModelOptions, groups: DataFrame | None, group: str | None,
) -> tuple[TargetRun | None, int, str | None]:
    y_table = targets.select(F.col(key).alias("key"), F.col(name).alias("target_value"))
    g_table = None if groups is None else groups.select(F.col(key).alias("key"), F.col(group).alias("group"))
    aligned = align_features_targets(x, y_table, "key", "target_value", g_table, "group" if group else None)
    if task == "classification":
        aligned = encode_label(aligned, "target_value", "y")
    else:
        if isinstance(targets.schema[name].dataType, (T.StringType, T.BooleanType)):
            raise ValueError(f"target {name!r} is not numeric")
        aligned = aligned.withColumn("y", F.col("target_value").cast("double"))
    aligned = aligned.select("key", "features", "y", *(["group"] if group else [])).persist()
    try:
        n, classes = aligned.agg(F.count(F.lit(1)), F.count_distinct("y")).first()
        if n < 2:
            return None, 0, "fewer than two samples remain after alignment"
        if task == "classification" and classes < 2:
            return None, 0, "only a single class after alignment"
        allowed = fold_count(aligned, task, "y", options.cv, "group" if group else None).first()
        if allowed["folds"] is None:
            return None, 0, allowed["reason"]
        k = int(allowed["folds"])
        if k < options.cv:
            warnings.warn(f"Reducing CV folds from {options.cv} to {k} for {name}", RuntimeWarning)
        grid = model_grid(options, task, max_components(n, d, k), d)
        inner_k = 0
        if len(grid) > 1:
            inner = fold_count(aligned, task, "y", 3, "group" if group else None).first()["folds"]
            if inner is None:
                warnings.warn(f"Skipping hyperparameter tuning for {name}: too few rows", RuntimeWarning)
                grid = grid[:1]
            inner_k = int(inner or 0)
        data = labelled_rows(aligned, task, k, options.seed, perms, inner_k, bool(group)).persist()
        model = options.classifier if task == "classification" else options.regressor
        if model not in (CLASSIFIERS if task == "classification" else REGRESSORS):
            raise ValueError(f"unknown model {model!r}")
        if model == "random_forest":
            run = _run_forest(data, grid, task, k, inner_k, perms, options.seed)
        elif task == "classification":
            run = _run_batched(data, grid, model, k, inner_k, perms, classes, d)
        else:
            run = _run_linear(data, grid, model, k, inner_k)
        return run, k, None
    finally:
        aligned.unpersist()


def run_feature_sets(
    embedded: DataFrame, targets: DataFrame, key: str, names: Sequence[str], mode: str = "average",
    options: ModelOptions = ModelOptions(), scope: str = "all_tests", sources: Sequence[str] = (),
    groups: DataFrame | None = None, group: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Models on the mean vector of each row, or one run per text column with one joint correction."""
    if mode == "average" or len(sources) < 2:
        pooled = mean_pool_by_row(embedded).withColumnRenamed("index", key)
        return cross_validate(pooled, targets, key, names, options, groups, group)
    parts, held, skipped = [], [], []
    for source in sources:
        features = select_feature_set(embedded, source).withColumnRenamed("index", key)
        part, predictions, missing = cross_validate(
            features, targets, key, names, replace(options, correction_method=None), groups, group
        )
        label = F.concat(F.lit(f"{source} :: "), F.col("target"))
        parts.append(part.withColumn("feature_set", F.lit(source)).withColumn("target_name", F.col("target"))
                     .withColumn("target", label))
        held.append(predictions.withColumn("target", label))
        skipped.append(missing.withColumn("target", label))
    results = adjust_pvalues(
        union_results(parts), options.correction_method if options.run_permutation else None,
        SCOPE_COLUMNS[scope], scope,
    )
    return results, union_results(held), union_results(skipped)


__all__ = ["ModelOptions", "cross_validate", "cv_score", "labelled_rows", "model_grid", "run_feature_sets"]
