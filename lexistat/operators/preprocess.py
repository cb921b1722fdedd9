"""Per-fold scaling, reduction and selection.

The first half works on long feature tables with SQL aggregates. The second half turns sums over the
training rows of one fold into one linear map z = A (x - mean), which the trainers apply to their
weights instead of to the rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDING = 1e-13  # a variance below this share of the sums it comes from is rounding


@dataclass(frozen=True)
class Prep:
    """Steps before the model, in this order: scale, reduce, select."""

    scale: bool = True
    n_components: int | None = None
    selection: str | None = None
    k_best: int = 200
    percentile: int = 20
    variance_threshold: float = 0.0


def long_features(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def train_statistics(long: DataFrame, y: str | None = None) -> DataFrame:
    """(fold, pos[, y], n, middle, sx, sxx): sums of x - middle and of its square over the rows outside each fold.

    Spark's mean and variance are states that merge without cancellation; the sums are taken around the mean of the
    whole feature (`middle`), so a feature far from zero loses no digits.
    """
    extra = [y] if y else []
    parts = long.groupBy("fold", "pos", *extra).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("spread")
    )
    # One row per fold, position and class from here on.
    whole = Window.partitionBy("pos", *extra)
    middle = F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy("pos")) / F.sum("n").over(Window.partitionBy("pos"))
    off = F.col("mean") - F.col("middle")
    sums = parts.withColumn("middle", middle).select(
        "fold", "pos", *extra, "n", "middle", (F.col("n") * off).alias("sx"),
        (F.col("n") * (F.col("spread") + off * off)).alias("sxx"),
    )
    cells = sums.select("fold").distinct().join(sums.select("pos", *extra, "middle").distinct())
    filled = cells.join(sums.drop("middle"), ["fold", "pos", *extra], "left")
    outside = {c: F.sum(c).over(whole) - F.coalesce(c, F.lit(0)) for c in ("n", "sx", "sxx")}
    return filled.select("fold", "pos", *extra, "middle", *[v.alias(c) for c, v in outside.items()])


def _mean_and_variance() -> tuple[Column, Column]:
    """The mean and population variance of a row of `train_statistics`; what rounding leaves of a constant is 0."""
    off, second = F.col("sx") / F.col("n"), F.col("sxx") / F.col("n")
    mean, variance = F.col("middle") + off, second - off * off
    least = F.greatest(ROUNDING * second, ROUNDING * mean * ROUNDING * mean)
    return mean, F.when(variance > least, variance).otherwise(0.0)


def scaler_statistics(long: DataFrame) -> DataFrame:
    """(fold, pos, mean, sd): training mean and population deviation; a constant feature gets 1."""
    mean, variance = _mean_and_variance()
    return train_statistics(long).select(
        "fold", "pos", mean.alias("mean"), F.when(variance > 0, F.sqrt(variance)).otherwise(1.0).alias("sd")
    )


def standardize(long: DataFrame) -> DataFrame:
    """Add z to the rows of each fold, scaled with the statistics of the other folds."""
    stats = scaler_statistics(long)
    return long.join(stats, ["fold", "pos"]).withColumn("z", (F.col("x") - F.col("mean")) / F.col("sd")).drop(
        "mean", "sd"
    )


def variance_threshold(long: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(fold, pos, variance) of the features whose training population variance is above it."""
    _, variance = _mean_and_variance()
    return train_statistics(long).select("fold", "pos", variance.alias("variance")).where(F.col("variance") > threshold)


def f_class_scores(long: DataFrame, y: str) -> DataFrame:
    """(fold, pos, f): analysis-of-variance F of each feature against the classes, on training rows."""
    train = train_statistics(long, y).where("n > 0")
    per = train.groupBy("fold", "pos").agg(
        F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"),
        F.sum(F.col("sx") * F.col("sx") / F.col("n")).alias("group_ss"), F.count(F.lit(1)).alias("classes"),
    )
    between = F.col("group_ss") - F.col("sx") * F.col("sx") / F.col("n")
    within = F.col("sxx") - F.col("group_ss")
    return per.select(
        "fold", "pos",
        # Null where training rows hold one class, or as many classes as rows.
        F.try_divide(
            F.try_divide(between, F.col("classes") - 1), F.try_divide(within, F.col("n") - F.col("classes"))
        ).alias("f"),
    )


def f_regression_scores(long: DataFrame, y: str) -> DataFrame:
    """(fold, pos, f) from the squared correlation of each feature with the target."""
    x, t = F.col("x"), F.col(y).cast("double")
    parts = long.groupBy("fold", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(t).alias("my"), F.var_pop(x).alias("vx"),
        F.var_pop(t).alias("vy"), F.covar_pop(x, t).alias("vxy"),
    )
    # Sums around the means of the whole feature and target, as in train_statistics.
    total = Window.partitionBy("pos")
    mid = {c: F.sum(F.col("n") * F.col(c)).over(total) / F.sum("n").over(total) for c in ("mx", "my")}
    off = parts.withColumns({"ox": F.col("mx") - mid["mx"], "oy": F.col("my") - mid["my"]})
    count, ox, oy = F.col("n"), F.col("ox"), F.col("oy")
    sums = off.select(
        "fold", "pos", "n", (count * ox).alias("sx"), (count * oy).alias("sy"),
        (count * (F.col("vx") + ox * ox)).alias("sxx"), (count * (F.col("vy") + oy * oy)).alias("syy"),
        (count * (F.col("vxy") + ox * oy)).alias("sxy"),
    )
    whole = Window.partitionBy("pos")
    out = sums.select("fold", "pos", *[
        (F.sum(c).over(whole) - F.col(c)).alias(c) for c in ("n", "sx", "sxx", "sy", "syy", "sxy")
    ])
    n = F.col("n")
    cxy = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    cxx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    cyy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    r2 = F.try_divide(cxy * cxy, cxx * cyy)
    return out.select("fold", "pos", F.try_divide(r2 * (n - 2), 1 - r2).alias("f"))


def select_kbest(scores: DataFrame, k: int) -> DataFrame:
    """The k features with the greatest F of each fold; of equal ones the later position."""
    order = Window.partitionBy("fold").orderBy(F.desc_nulls_last("f"), F.desc("pos"))
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(1, int(k)))


def select_percentile(scores: DataFrame, percent: int) -> DataFrame:
    """The features above the (100 - percent)-th percentile of F, and earlier ones at it up to the share."""
    pct = min(max(1, int(percent)), 100)
    d = F.count(F.lit(1)).over(Window.partitionBy("fold"))
    order = Window.partitionBy("fold").orderBy(F.desc_nulls_last("f"), F.col("pos"))
    ranked = scores.withColumns({"place": F.row_number().over(order), "_d": d})
    keep: Column = F.greatest(F.floor(F.col("_d") * pct / 100), F.lit(1)) if pct < 100 else F.col("_d")
    return ranked.where(F.col("place") <= keep).drop("_d")


def max_components(n: int, d: int, folds: int) -> int:
    train = n - math.ceil(n / folds) if folds > 1 else n
    return max(1, min(d, train))


def resolve_components(method: str | None, wanted: int | None, limit: int) -> int | None:
    """Number of components of the reducer; None without one."""
    if not method or limit < 1:
        return None
    if str(method).lower() != "pca":
        warnings.warn(f"Unknown reduction method '{method}'. Skipping reduction.", RuntimeWarning)
        return None
    n = min(50, limit) if wanted is None else int(wanted)
    if n < 1:
        return None
    if n > limit:
        warnings.warn(f"Requested n_components={n} exceeds max={limit}. Using {limit}.", RuntimeWarning)
    return min(n, limit)


@dataclass
class TrainSums:
    """Sums over training rows. `sxx` is the d x d matrix, or its diagonal when that is enough."""

    n: float
    sx: np.ndarray
    sxx: np.ndarray
    class_n: np.ndarray | None = None
    class_sx: np.ndarray | None = None


def fit_map(sums: TrainSums, prep: Prep) -> tuple[np.ndarray, np.ndarray]:
    """(A, mean) of the scaling and reduction steps."""
    d = len(sums.sx)
    mean = sums.sx / sums.n
    diagonal = sums.sxx if sums.sxx.ndim == 1 else np.diag(sums.sxx)
    variance = np.maximum(diagonal / sums.n - mean * mean, 0.0)
    sd = np.where(variance > ROUNDING * diagonal / sums.n, np.sqrt(variance), 1.0) if prep.scale else np.ones(d)
    a = np.diag(1.0 / sd)
    if prep.n_components is not None:
        spread = a @ (sums.sxx - sums.n * np.outer(mean, mean)) @ a
        _, vectors = np.linalg.eigh(spread)
        loadings = vectors[:, ::-1][:, :prep.n_components].T
        top = np.abs(loadings).argmax(axis=1)
        loadings = loadings * np.where(loadings[np.arange(len(top)), top] < 0, -1.0, 1.0)[:, None]
        a = loadings @ a
    return a, mean


def keep_mask(scores: np.ndarray, variances: np.ndarray, prep: Prep) -> np.ndarray:
    """Indices of the selected features; `scores` has one F per feature, more is better."""
    q = len(scores)
    if prep.selection is None:
        return np.arange(q)
    if prep.selection == "variance":
        kept = np.flatnonzero(variances > prep.variance_threshold)
        if not len(kept):
            raise ValueError("No feature meets the variance threshold")
        return kept
    safe = np.where(np.isnan(scores), -np.inf, scores)
    if prep.selection == "kbest":
        k = min(max(1, int(prep.k_best)), q)
        return np.sort(np.argsort(safe, kind="mergesort")[-k:])
    if prep.selection == "percentile":
        pct = min(max(1, int(prep.percentile)), 100)
        if pct == 100:
            return np.arange(q)
        k = max(1, int(q * pct / 100))
        return np.sort(np.argsort(-safe, kind="mergesort")[:k])
    raise ValueError("feature_selection must be one of: kbest, percentile, variance")


def class_scores(sums: TrainSums, a: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(F, variance) of the mapped features against the classes."""
    present = sums.class_n > 0
    n, k = sums.n, int(present.sum())
    centred = (sums.class_sx[present] - sums.class_n[present, None] * mean) @ a.T
    between = (centred**2 / sums.class_n[present, None]).sum(0)
    if sums.sxx.ndim == 1:
        total = np.diag(a) ** 2 * (sums.sxx - n * mean * mean)
    else:
        total = np.einsum("ij,jk,ik->i", a, sums.sxx - n * np.outer(mean, mean), a)
    within = np.maximum(total - between, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (between / max(k - 1, 1)) / (within / max(n - k, 1))
    return f, total / n
