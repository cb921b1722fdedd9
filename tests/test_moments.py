import numpy as np
import pytest

from lexistat.operators import preprocess
from lexistat.operators.modeling import ModelOptions, cross_validate


def far_columns(spark, n=400):
    """(frame, x, label, target): noise around 1e9, a constant, and noise around 0."""
    rng = np.random.default_rng(3)
    label, noise = rng.integers(0, 2, n), rng.normal(size=(n, 2))
    x = np.stack([1e9 + noise[:, 0] + label, np.full(n, 0.1), noise[:, 1] - label], 1)
    rows = [(i % 4, p, int(label[i]), float(noise[i, 0]), float(x[i, p])) for i in range(n) for p in range(3)]
    return spark.createDataFrame(rows, "fold int, pos int, label int, target double, x double"), x, label, noise[:, 0]


def test_features_far_from_zero_keep_their_digits(spark):
    long, x, _, _ = far_columns(spark)
    fold = np.arange(len(x)) % 4
    for r in preprocess.scaler_statistics(long).collect():
        own = x[fold != r["fold"], r["pos"]]
        assert r["mean"] == pytest.approx(own.mean(), rel=1e-15)
        assert r["sd"] == (1.0 if r["pos"] == 1 else pytest.approx((own - 1e9 * (r["pos"] == 0)).std(), rel=1e-6))
    assert {r["pos"] for r in preprocess.variance_threshold(long).collect()} == {0, 2}


def test_scores_of_features_far_from_zero(spark):
    long, x, label, target = far_columns(spark)
    fold = np.arange(len(x)) % 4
    f = {(r["fold"], r["pos"]): r["f"] for r in preprocess.f_class_scores(long, "label").collect()}
    g = {(r["fold"], r["pos"]): r["f"] for r in preprocess.f_regression_scores(long, "target").collect()}
    for k in range(4):
        own, c, t = x[fold != k, 0] - 1e9, label[fold != k], target[fold != k]
        between = sum((c == v).sum() * (own[c == v].mean() - own.mean()) ** 2 for v in (0, 1))
        within = sum(((own[c == v] - own[c == v].mean()) ** 2).sum() for v in (0, 1))
        assert f[k, 0] == pytest.approx(between / (within / (len(own) - 2)), rel=1e-5)
        r2 = np.corrcoef(own, t)[0, 1] ** 2
        assert g[k, 0] == pytest.approx(r2 * (len(own) - 2) / (1 - r2), rel=1e-5)


@pytest.mark.parametrize("reduction", [None, "pca"])
def test_models_do_not_change_when_features_move(spark, reduction):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.1 * rng.normal(size=120)
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id bigint, score double")
    options = ModelOptions(run_permutation=False, reduce_method=reduction, reduce_n_components=2 if reduction else None)
    scores = []
    for shift in (0.0, 1e8):
        rows = spark.createDataFrame([(i, (v + shift).tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
        scores.append(cross_validate(rows, targets, "id", ["score"], options)[0].first()["observed"])
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)
