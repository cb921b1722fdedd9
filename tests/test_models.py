import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexistat.operators import batched, folds, gram, inference, metrics, modeling, report
from lexistat.operators.preprocess import Prep, keep_mask, max_components, resolve_components
from lexistat.operators.stack import align_features_targets

RNG = np.random.RandomState(3)


def features(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "key int, embedding array<double>")


def test_alignment_drops_missing_targets_and_groups(spark):
    x = features(spark, [(.1, 1.), (.2, .9), (.8, .2), (.9, .1), (1., 0.), (1.1, -.1)], range(10, 16))
    y = spark.createDataFrame(list(zip(range(10, 16), ["cat", "cat", "dog", "dog", None, "dog"])), "key int, label string")
    g = spark.createDataFrame(list(zip(range(10, 16), ["g1", "g1", "g2", "g2", "g3", None])), "key int, g string")
    rows = align_features_targets(x, y, "key", "label", g, "g")
    coded = folds.encode_label(rows, "label").orderBy("key").collect()
    assert [(r["y"], r["g"]) for r in coded] == [(0, "g1"), (0, "g1"), (1, "g2"), (1, "g2")]


def test_tasks(spark):
    df = spark.createDataFrame([(1.0, "a", i / 7) for i in range(30)] + [(2.0, "b", float("nan"))], "few double, name string, many double")
    got = {r["target"]: r["task"] for r in folds.detect_task(df, ["few", "name", "many"]).collect()}
    assert got == {"few": "classification", "name": "classification", "many": "regression"}
    assert folds.resolve_task("t", "classification", "regress") == "regression"
    assert folds.resolve_task("t", "classification", "auto", {"t": "regressor"}) == "regression"
    assert folds.resolve_task("t", "classification", "regression", {"t": "auto"}) == "classification"
    with pytest.raises(ValueError):
        folds.normalize_task_mode("cluster")


def rows(spark, y, g=None):
    data = [(i, float(v), None if g is None else str(g[i])) for i, v in enumerate(y)]
    return spark.createDataFrame(data, "key int, y double, g string")


def test_fold_counts_and_reasons(spark):
    def count(y, task, cv=5, g=None):
        return folds.fold_count(rows(spark, y, g), task, "y", cv, "g" if g else None).first()

    assert "at least 2 samples in each class" in count([0, 0, 0, 1], "classification")["reason"]
    assert count([0, 0, 0, 1, 1, 1], "classification")["folds"] == 3
    assert count(range(7), "regression")["folds"] == 3
    assert "at least 4 samples" in count(range(3), "regression")["reason"]
    assert count(range(4), "regression", 5, [1, 1, 2, 2])["folds"] == 2
    assert "two unique groups" in count(range(4), "regression", 5, [1, 1, 1, 1])["reason"]
    assert "groups per class" in count([0, 0, 1, 1], "classification", 5, [1, 1, 1, 2])["reason"]
    assert folds.inner_fold_count(rows(spark, [0, 0, 1, 1], [1, 1, 1, 2]), "classification", "y", "g") is None


def test_groups_never_split_and_folds_are_balanced(spark):
    df = spark.range(400).select(F.col("id").alias("key"), F.expr("case when id < 130 then 0 else id % 37 end").cast("string").alias("g"),
                                 (F.col("id") % 3).alias("y"))
    for table in (folds.group_kfold(df, "g", 4), folds.stratified_group_kfold(df, "g", "y", 4)):
        assert table.count() == 400
        assert table.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
        assert table.select("fold").distinct().count() == 4
    sizes = [r["count"] for r in folds.stratified_kfold(df, "key", "y", 5).groupBy("y", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_permutations_keep_the_labels(spark):
    df = spark.range(50).select(F.col("id").alias("key"), (F.col("id") % 4).alias("y"))
    got = folds.permute_labels(df, "key", "y", 6).toPandas()
    orders = set()
    for _, part in got.groupby("perm"):
        assert sorted(part["y"]) == sorted(i % 4 for i in range(50))
        orders.add(tuple(part.sort_values("key")["y"]))
    assert len(orders) == 6


def ridge_by_hand(x, y, alpha):
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return w / sd, y.mean() - (w / sd) @ mean


def test_ridge_scores_and_predictions_equal_direct_fits(spark):
    x = RNG.randn(60, 4) * [1, 5, 2, 1] + 3
    x[:, 3] = 7.0  # a constant feature
    y = x[:, 0] * 2 - x[:, 1] + RNG.randn(60)
    target = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "key int, score double")
    options = modeling.ModelOptions(n_permutations=30, report_metrics=("mae", "r2", "unknown"))
    with pytest.warns(RuntimeWarning, match="unsupported"):
        results, held, skipped = modeling.cross_validate(features(spark, x), target, "key", ["score"], options)
    table = held.toPandas().astype({"row_key": int}).sort_values("row_key")
    fold, expected = table["fold"].to_numpy(), np.empty(60)
    scores = []
    for f in range(5):
        w, b = ridge_by_hand(x[fold != f], y[fold != f], 1.0)
        expected[fold == f] = x[fold == f] @ w + b
        t = y[fold == f]
        scores.append(1 - ((t - expected[fold == f]) ** 2).sum() / ((t - t.mean()) ** 2).sum())
    assert np.allclose(table["y_pred"], expected, atol=1e-8)
    row = results.first()
    assert row["observed"] == pytest.approx(np.mean(scores)) and np.allclose(row["cv_scores"], scores)
    assert row["metric_mae"] == pytest.approx(np.abs(y - expected).mean())
    assert row["p_value"] == pytest.approx((1 + sum(s >= row["observed"] for s in row["perm_scores"])) / 31)
    assert len(row["perm_scores"]) == 30 and row["p_adjust_scope"] == "all_tests" and skipped.count() == 0


def test_lasso_meets_its_optimality_conditions():
    x = RNG.randn(80, 6)
    x -= x.mean(0)
    y = x[:, 0] * 3 + RNG.randn(80)
    y -= y.mean()
    w = gram.lasso_path_point(x.T @ x, (x.T @ y)[:, None], 80 * 0.3)[:, 0]
    slope = x.T @ (y - x @ w) / 80
    assert np.all(np.abs(slope) <= 0.3 + 1e-8) and (w == 0).any()
    assert np.allclose(slope[w != 0], 0.3 * np.sign(w[w != 0]), atol=1e-8)


def test_selection_and_reduction_inside_folds_equal_direct_fits(spark):
    x = RNG.randn(50, 6)
    y = x[:, 2] * 2 + RNG.randn(50) * 0.3
    target = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "key int, score double")
    base = dict(run_permutation=False)
    kbest = modeling.ModelOptions(feature_selection="kbest", k_best=2, **base)
    pca = modeling.ModelOptions(reduce_method="pca", reduce_n_components=3, **base)
    for options in (kbest, pca):
        held = modeling.cross_validate(features(spark, x), target, "key", ["score"], options)[1]
        table = held.toPandas().astype({"row_key": int}).sort_values("row_key")
        fold = table["fold"].to_numpy()
        for f in range(5):
            train = fold != f
            mean, sd = x[train].mean(0), x[train].std(0)
            z = (x - mean) / sd
            if options is kbest:
                r = np.abs([np.corrcoef(z[train, j], y[train])[0, 1] for j in range(6)])
                z = z[:, np.sort(np.argsort(r)[-2:])]
            else:
                z = z @ np.linalg.svd(z[train], full_matrices=False)[2][:3].T
            zt = z[train] - z[train].mean(0)
            w = np.linalg.solve(zt.T @ zt + np.eye(z.shape[1]), zt.T @ (y[train] - y[train].mean()))
            p = (z[~train] - z[train].mean(0)) @ w + y[train].mean()
            assert np.allclose(table["y_pred"].to_numpy()[~train], p, atol=1e-7)


def blobs(spark):
    x = np.vstack([RNG.randn(12, 3) * 0.2 - 1, RNG.randn(12, 3) * 0.2 + 1])
    y = spark.createDataFrame([(i, "a" if i < 12 else "b") for i in range(24)], "key int, label string")
    return features(spark, x), y


@pytest.mark.parametrize("model", ["logistic", "linear_svm", "random_forest"])
def test_classifiers_separate_blobs(spark, model):
    x, y = blobs(spark)
    params = {"n_estimators": 5} if model == "random_forest" else {}
    options = modeling.ModelOptions(
        cv=4, n_permutations=0 if model == "random_forest" else 9, run_permutation=model != "random_forest",
        classifier=model, classifier_params=params, report_metrics=("balanced_accuracy",))
    results, held, _ = modeling.cross_validate(x, y, "key", ["label"], options)
    row = results.first()
    assert (row["task"], row["metric_name"], row["cv_folds_used"]) == ("classification", "accuracy", 4)
    assert row["observed"] == 1.0 and row["metric_balanced_accuracy"] == 1.0 and held.count() == 24
    if model == "random_forest":
        assert row["p_value"] is None and row["p_adjusted"] is None
    else:
        assert row["p_value"] == pytest.approx(0.1, abs=0.1)


@pytest.mark.parametrize("loss,classes,newton", [
    ("logistic", 2, True), ("logistic", 3, True), ("logistic", 3, False), ("squared_hinge", 3, True),
    ("squared_hinge", 2, False)])
def test_batched_fits_are_optimal(spark, monkeypatch, loss, classes, newton):
    monkeypatch.setattr(batched, "NEWTON_JOBS", 1 if newton else 10**9)
    n, d = 90, 4
    x = RNG.randn(n, d) * [1, 3, 1, 2] + 1
    y = (x[:, :classes] + RNG.randn(n, classes)).argmax(1)
    fold = np.arange(n) % 3
    df = spark.createDataFrame(
        [(i, [float(v) for v in x[i]], [float(y[i])], [int(fold[i])]) for i in range(n)],
        "key int, features array<double>, ys array<double>, folds array<int>").repartition(3)
    specs = [batched.ModelSpec(0, f, -1, 0.7, Prep()) for f in range(3)]
    for f, model in enumerate(batched.train_models(df, specs, classes, d, 3, loss, tol=1e-7)):
        train = fold != f
        mean, sd = x[train].mean(0), x[train].std(0)
        z = (x[train] - mean) / sd
        w, b = model.weights * sd, model.intercepts + model.weights @ mean
        score = z @ w.T + b
        own = y[train][:, None] == (np.array([1]) if classes == 2 else np.arange(classes))
        if loss == "logistic":
            chance = 1 / (1 + np.exp(-score)) if classes == 2 else np.exp(score) / np.exp(score).sum(1, keepdims=True)
            pull, on_b = chance - own, 0.0
        else:
            side = np.where(own, 1.0, -1.0)
            pull, on_b = -2 * side * np.maximum(1 - side * score, 0), b / 0.7
        assert np.abs(pull.T @ z + w / 0.7).max() < 1e-3 and np.abs(pull.sum(0) + on_b).max() < 1e-3


def test_tuning_picks_the_better_grid_point(spark):
    x = RNG.randn(60, 5)
    y = x @ np.array([3., -2, 1, 0, 0]) + RNG.randn(60) * 0.1
    target = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "key int, score double")
    plain = modeling.ModelOptions(run_permutation=False, regressor_params={"alpha": 1e4})
    tuned = modeling.ModelOptions(run_permutation=False, tune=True, regressor_grid={"alpha": [1e4, 0.1]})
    low = modeling.cross_validate(features(spark, x), target, "key", ["score"], plain)[0].first()["observed"]
    high = modeling.cross_validate(features(spark, x), target, "key", ["score"], tuned)[0].first()["observed"]
    assert high > 0.95 > low
    bx, by = blobs(spark)
    options = modeling.ModelOptions(cv=3, run_permutation=False, tune=True, classifier_grid={"C": [1e-6, 1.0]})
    assert modeling.cross_validate(bx, by, "key", ["label"], options)[0].first()["observed"] == 1.0


def test_grid_leaves_out_invalid_values():
    options = modeling.ModelOptions(
        tune=True, regressor_grid={"alpha": [0.1, 1]}, feature_selection="kbest", k_best=3, k_best_grid=(0, 2, 99),
        reduce_method="pca", reduce_n_components=4, reduce_components_grid=(0, 2, 99))
    grid = modeling.model_grid(options, "regression", max_components(12, 6, 5), 6)
    assert [(p.n_components, p.k_best, m["alpha"]) for p, m in grid] == [(2, 2, 0.1), (2, 2, 1)]
    with pytest.warns(RuntimeWarning, match="exceeds"):
        assert resolve_components("pca", 99, 5) == 5
    with pytest.warns(RuntimeWarning, match="Unknown"):
        assert resolve_components("nmf", 2, 5) is None
    assert resolve_components("pca", None, 70) == 50
    f = np.array([1., 5, 3, np.nan, 4])
    assert list(keep_mask(f, f, Prep(selection="kbest", k_best=99))) == [0, 1, 2, 3, 4]
    assert list(keep_mask(f, f, Prep(selection="kbest", k_best=2))) == [1, 4]
    assert list(keep_mask(f, f, Prep(selection="percentile", percentile=300))) == [0, 1, 2, 3, 4]


def test_single_class_gives_an_empty_result_with_columns(spark):
    x = features(spark, RNG.randn(8, 2))
    y = spark.createDataFrame([(i, "same") for i in range(8)], "key int, label string")
    results, held, skipped = modeling.cross_validate(x, y, "key", ["label"], modeling.ModelOptions(n_permutations=3))
    assert results.count() == 0 and held.count() == 0 and skipped.first()["target"] == "label"
    assert {"target", "task", "metric_name", "observed", "p_value", "p_fdr", "p_adjusted", "p_adjust_method",
            "cv_scores", "perm_scores", "cv_folds_used"} <= set(results.columns)


def test_forced_task_and_groups(spark):
    x = RNG.randn(30, 6)
    y = spark.createDataFrame([(i, i % 5, f"g{i % 7}") for i in range(30)], "key int, score int, g string")
    options = modeling.ModelOptions(task_mode="auto", target_task_overrides={"score": "regression"}, n_permutations=5)
    row = modeling.cross_validate(features(spark, x), y, "key", ["score"], options, y, "g")[0].first()
    assert row["task"] == "regression" and row["cv_folds_used"] == 5


FAMILY = [
    ("text_a :: rating", "rating", "text_a", 0.01), ("text_b :: rating", "rating", "text_b", 0.04),
    ("text_a :: score", "score", "text_a", 0.03), ("text_b :: score", "score", "text_b", 0.20),
]


@pytest.mark.parametrize("method,groups,expected", [
    ("bonferroni", [], [.04, .16, .12, .80]), ("bonferroni", ["target_name"], [.02, .08, .06, .40]),
    ("bonferroni", ["feature_set"], [.02, .08, .06, .40]), ("holm", [], [.04, .09, .09, .20]),
    ("hochberg", [], [.04, .08, .08, .20]), ("fdr_bh", [], [.04, .053333, .053333, .20])])
def test_corrections(spark, method, groups, expected):
    df = spark.createDataFrame(FAMILY, "target string, target_name string, feature_set string, p_value double")
    got = {r["target"]: r["p_adjusted"] for r in inference.adjust_pvalues(df, method, groups).collect()}
    assert [got[t[0]] for t in FAMILY] == pytest.approx(expected, abs=1e-5)


def test_hommel_equals_closed_testing(spark):
    """The adjusted value is the greatest Simes p-value of all sets of tests that hold the test."""
    p = [.01, .04, .03, .20, .04, .5]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "target string, p_value double")
    got = {int(r["target"]): r["p_adjusted"] for r in inference.adjust_pvalues(df, "hommel").collect()}

    def simes(members):
        ordered = sorted(p[i] for i in members)
        return min(len(ordered) * v / rank for rank, v in enumerate(ordered, start=1))

    sets = [c for n in range(1, 7) for c in itertools.combinations(range(6), n)]
    for i in range(6):
        assert got[i] == pytest.approx(max(simes(c) for c in sets if i in c))


def test_unknown_or_disabled_correction(spark):
    df = spark.createDataFrame(FAMILY, "target string, target_name string, feature_set string, p_value double")
    with pytest.warns(RuntimeWarning, match="Unknown"):
        assert inference.adjust_pvalues(df, "magic").where("p_adjusted IS NOT NULL").isEmpty()
    for off in ("none", "No", "N/A", None):
        assert inference.normalize_correction_method(off) is None


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from([0.001, 0.01, 0.01, 0.04, 0.2, 0.5, 1.0]), min_size=1, max_size=9))
def test_adjusted_values_never_fall_below_and_keep_the_order(spark, values):
    df = spark.createDataFrame([(f"t{i}", v) for i, v in enumerate(values)] + [("null", None)], "target string, p_value double")
    for method in inference.METHODS:
        got = inference.adjust_pvalues(df, method).toPandas()
        assert len(got) == len(values) + 1 and got["p_adjusted"].isna().sum() == 1
        part = got.dropna(subset=["p_value"]).sort_values("p_value")
        assert part["p_adjusted"].is_monotonic_increasing and (part["p_adjusted"] <= 1).all()
        if method not in ("fdr_tsbh", "fdr_tsbky", "fdr_gbs"):
            assert (part["p_adjusted"] >= part["p_value"] - 1e-12).all()


def test_permutation_pvalue_for_losses(spark):
    scores = spark.createDataFrame([("t", .1), ("t", .2), ("t", .4)], "target string, score double")
    observed = spark.createDataFrame([("t", .2)], "target string, observed double")
    assert inference.permutation_pvalue(scores, observed, larger_is_better=False).first()["p_value"] == 0.75


def test_metrics_of_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert metrics.regression_metrics(df).first()["r2"] == 1.0
    assert metrics.regression_metrics(df.withColumn("p", F.lit(2.0))).first()["r2"] == 0.0
    assert metrics.regression_metrics(df.limit(1)).first()["r2"] is None
    row = metrics.classification_metrics(spark.createDataFrame([(0, 0), (0, 2), (1, 0)], "y int, p int")).first()
    assert row["balanced_accuracy"] == 0.25 and row["precision"] == pytest.approx(1 / 3)


def advanced_line(spark, config):
    row = [("mood", "classification", "f1", .6, .2)]
    df = spark.createDataFrame(row, "target string, task string, metric_name string, observed double, p_value double")
    return [r["line"] for r in report.interpret_model_rows(df, config).collect() if r["line"].startswith("Advanced")]


@pytest.mark.parametrize("config, notes", [
    ({"feature_selection": "Percentile", "percentile": 35, "reduce_method": "UMAP"},
     ["Percentile feature selection (35%)", "UMAP dimensionality reduction"]),
    ({"feature_selection": "variance threshold", "variance_threshold": 0.2, "tune_hyperparams": True},
     ["variance-threshold feature selection (0.2)", "light-grid hyperparameter tuning"]),
    ({"feature_selection": "lasso path", "reduce_method": "PCA"},
     ["feature selection (lasso path)", "PCA dimensionality reduction"]),
    ({"tune_hyperparams": True, "regressor_param_grid": {"alpha": [3]}, "percentile_grid": [10], "k_best_grid": []},
     ["hyperparameter tuning with custom regressor grid, feature-selection grid"]),
    ({"text_cols": ["a", "b", "c"], "text_feature_mode": "Average", "group_col": " clinic ", "n_perm": 40},
     ["group-aware CV using clinic", "mean-pooled embeddings across selected text columns", "permutation testing (40 iterations)"]),
    ({"correction_method": "none", "task_mode": "classification"}, ["forced task mode (classification)"]),
    ({"correction_method_label": "Sidak", "correction_scope": "all_tests", "target_task_overrides": {"mood": "classification"}},
     ["multiple-comparisons correction (Sidak; scope: across all tested target/feature-set combinations)",
      "explicit task override (classification) for this target"]),
])
def test_notes_follow_the_settings(spark, config, notes):
    assert advanced_line(spark, config) == ["Advanced settings used: " + "; ".join(notes) + "."]


def test_no_note_without_settings(spark):
    assert advanced_line(spark, None) == advanced_line(spark, {"text_cols": ["a"], "feature_selection": "none"}) == []


def test_negative_r2_is_called_out(spark):
    df = spark.createDataFrame(
        [("t", "regression", "r2", -.12, .01, .02, "bonferroni", 5)],
        "target string, task string, metric_name string, observed double, p_value double, p_adjusted double, p_adjust_method string, cv_folds_used int")
    lines = " ".join(r["line"] for r in report.interpret_model_rows(df).collect())
    assert "worse than a constant baseline" in lines and "Cross validation used 5 folds." in lines
    assert "adjusted p=0.0200 (bonferroni)" in report.summarize_model_rows(df).first()["summary"]


@pytest.mark.parametrize("fmt", ["markdown", "html"])
def test_report_with_and_without_data(spark, fmt):
    empty = [r["line"] for r in report.report_lines(spark, [], "now", fmt=fmt).orderBy("ord").collect()]
    assert sum(" were available. " in line for line in empty) == 3
    results = spark.createDataFrame(
        [("a", "classification", "accuracy", .9, .03, .04, "holm", 5), ("b", "classification", "accuracy", .7, .2, .2, "holm", 5)],
        "target string, task string, metric_name string, observed double, p_value double, p_adjusted double, p_adjust_method string, cv_folds_used int")
    plot = spark.createDataFrame([(0.1, 0.2)], "dim_1 double, dim_2 double")
    summary = spark.createDataFrame([("note", 2)], "Corpus string, `N Texts` bigint")
    lines = [r["line"] for r in report.report_lines(
        spark, ["note"], "now", summary, None, plot, results, None, {"reduce_method": "pca", "tsne_metric": "x"}, {"cv": 5},
        fmt).orderBy("ord").collect()]
    whole = "\n".join(lines)
    assert "Summary table" in whole and "Projection computed with 2 dimensions" in whole and "tsne_metric" not in whole
    assert "Permutation testing gave p=0.0300 and adjusted p=0.0400 (holm)" in whole


def test_feature_sets_share_one_correction(spark):
    x = RNG.randn(40, 3)
    both = [("q1", i, [float(v) for v in x[i]]) for i in range(40)] + [("q2", i, [float(v) for v in -x[i]]) for i in range(40)]
    embedded = spark.createDataFrame(both, "source_column string, index int, embedding array<double>")
    y = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1])) for i in range(40)], "key int, s double, t double")
    options = modeling.ModelOptions(n_permutations=19, correction_method="bonferroni")
    results, _, _ = modeling.run_feature_sets(embedded, y, "key", ["s", "t"], "separate", options, "within_target", ["q1", "q2"])
    table = results.toPandas()
    assert set(table["target"]) == {"q1 :: s", "q1 :: t", "q2 :: s", "q2 :: t"}
    assert np.allclose(table["p_adjusted"], np.minimum(table["p_value"] * 2, 1))
    assert isinstance(table, pd.DataFrame) and (table["p_adjust_scope"] == "within_target").all()
