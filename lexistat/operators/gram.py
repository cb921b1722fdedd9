"""Ridge and lasso for all folds and permutations from one pass over the rows.

Regression folds do not depend on the labels, so the sums of 1, x, x x', x y and y y per fold are
enough: a fold is trained on the total without its own sums, and its R2 also follows from sums. One
Spark job serves every permutation, every fold and every point of the grid.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lexistat.functions.sums import matrix, table_sums
from lexistat.operators.preprocess import Prep, TrainSums, fit_map, keep_mask


@dataclass
class FoldSums:
    """Sums of one set of rows: g is [1 x]'[1 x], h is [1 x]'Y, yy is the column sums of Y squared."""

    g: np.ndarray
    h: np.ndarray
    yy: np.ndarray

    def __add__(self, other: FoldSums) -> FoldSums:
        return FoldSums(self.g + other.g, self.h + other.h, self.yy + other.yy)

    def __sub__(self, other: FoldSums) -> FoldSums:
        return FoldSums(self.g - other.g, self.h - other.h, self.yy - other.yy)

    @property
    def n(self) -> float:
        return float(self.g[0, 0])


@dataclass(frozen=True)
class LinearFit:
    """Weights on the raw features and the intercept."""

    weights: np.ndarray
    intercept: float


def fold_sums(data: DataFrame, folds: int, inner: int = 0) -> tuple[list[FoldSums], list[list[FoldSums]]]:
    """(sums of each outer fold, sums of each inner fold inside each outer training set).

    `data` has features, ys (observed labels first, then one per permutation), fold and, for tuning,
    inner: the inner fold of the row for each outer fold.
    """

    def accumulate(batch: pd.DataFrame) -> np.ndarray:
        x = matrix(batch["features"])
        z = np.hstack([np.ones((len(x), 1)), x])
        y = matrix(batch["ys"])
        fold = batch["fold"].to_numpy()
        groups = [fold == f for f in range(folds)]
        if inner:
            within = matrix(batch["inner"])
            groups += [within[:, f] == g for f in range(folds) for g in range(inner)]
        parts = []
        for rows in groups:
            zr, yr = z[rows], y[rows]
            top = np.hstack([zr.T @ zr, zr.T @ yr])
            last = np.concatenate([np.zeros(z.shape[1]), (yr * yr).sum(0)])
            parts.append(np.vstack([top, last]))
        return np.vstack(parts)

    columns = ["features", "ys", "fold"] + (["inner"] if inner else [])
    total = table_sums(data.select(*columns), accumulate)
    count = folds + (folds * inner if inner else 0)
    blocks = total.reshape(count, total.shape[0] // count, total.shape[1])
    p = blocks.shape[1] - 1
    sums = [FoldSums(b[:p, :p], b[:p, p:], b[p, p:]) for b in blocks]
    nested = [sums[folds + f * inner: folds + (f + 1) * inner] for f in range(folds)] if inner else []
    return sums[:folds], nested


def solve(train: FoldSums, prep: Prep, model: str, alpha: float, first_only: bool = False) -> list[LinearFit]:
    """One fit per label column."""
    n, d = train.n, train.g.shape[0] - 1
    labels = 1 if first_only else train.h.shape[1]
    a, mean = fit_map(TrainSums(n, train.g[0, 1:], train.g[1:, 1:]), prep)
    spread = a @ (train.g[1:, 1:] - n * np.outer(mean, mean)) @ a.T
    y_mean = train.h[0, :labels] / n
    cross = a @ (train.h[1:, :labels] - np.outer(mean, train.h[0, :labels]))
    yy = train.yy[:labels] - n * y_mean**2
    if prep.selection in ("kbest", "percentile"):
        w = np.zeros((len(a), labels))
        with np.errstate(divide="ignore", invalid="ignore"):
            r2 = cross**2 / (np.diag(spread)[:, None] * yy[None, :])
            scores = r2 / np.maximum(1.0 - r2, 0.0) * (n - 2)
        for j in range(labels):
            kept = keep_mask(scores[:, j], np.diag(spread) / n, prep)
            w[kept, j] = _coefficients(spread[np.ix_(kept, kept)], cross[kept, j:j + 1], n, model, alpha)[:, 0]
    else:
        kept = keep_mask(np.zeros(len(a)), np.diag(spread) / n, prep)
        w = np.zeros((len(a), labels))
        w[kept] = _coefficients(spread[np.ix_(kept, kept)], cross[kept], n, model, alpha)
    raw = a.T @ w
    return [LinearFit(raw[:, j], float(y_mean[j] - raw[:, j] @ mean)) for j in range(labels)]


def _coefficients(spread: np.ndarray, cross: np.ndarray, n: float, model: str, alpha: float) -> np.ndarray:
    if model == "ridge":
        return np.linalg.solve(spread + alpha * np.eye(len(spread)), cross)
    if model == "lasso":
        return lasso_path_point(spread, cross, n * alpha)
    raise ValueError("regressor must be one of: ridge, lasso, random_forest")


def lasso_path_point(
    spread: np.ndarray, cross: np.ndarray, penalty: float, max_iter: int = 1000, tol: float = 1e-10
) -> np.ndarray:
    """Coordinate descent on the sums, for all label columns together."""
    w = np.zeros_like(cross)
    curve = np.diag(spread)
    fitted = np.zeros_like(cross)
    for _ in range(max_iter):
        moved = 0.0
        for j in range(len(w)):
            if curve[j] <= 0:
                continue
            rho = cross[j] - fitted[j] + curve[j] * w[j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - penalty, 0.0) / curve[j]
            step = new - w[j]
            if np.any(step):
                fitted += np.outer(spread[:, j], step)
                moved = max(moved, float(np.max(np.abs(step) * np.sqrt(curve[j]))))
                w[j] = new
        if moved < tol * max(1.0, float(np.sqrt(np.max(np.abs(cross))))):
            return w
    warnings.warn(f"lasso did not converge in {max_iter} rounds", RuntimeWarning, stacklevel=2)
    return w


def r2_from_sums(test: FoldSums, fit: LinearFit, label: int) -> float:
    n, w, b = test.n, fit.weights, fit.intercept
    sy, syy = test.h[0, label], test.yy[label]
    fitted = n * b * b + 2 * b * (w @ test.g[0, 1:]) + w @ test.g[1:, 1:] @ w
    residual = syy - 2 * (b * sy + w @ test.h[1:, label]) + fitted
    spread = syy - sy * sy / n
    if n < 2:
        return float("nan")
    if spread <= 0:
        return 1.0 if residual <= 0 else 0.0
    return float(1.0 - residual / spread)


def fit_folds(
    outer: list[FoldSums], nested: list[list[FoldSums]], model: str, grid: list[tuple[Prep, dict]],
) -> tuple[list[list[LinearFit]], np.ndarray, list[list[int]]]:
    """(fits[fold][label], scores[label, fold], chosen grid point per fold and label)."""
    total = outer[0]
    for part in outer[1:]:
        total = total + part
    labels = total.h.shape[1]
    scores = np.empty((labels, len(outer)))
    fits: list[list[LinearFit]] = []
    chosen: list[list[int]] = []
    for f, test in enumerate(outer):
        train = total - test
        best = np.zeros(labels, dtype=int)
        if len(grid) > 1 and nested:
            best = _tune(nested[f], model, grid, labels)
        row: list[LinearFit] = [None] * labels  # type: ignore[list-item]
        for point in sorted(set(best.tolist())):
            prep, params = grid[point]
            solved = solve(train, prep, model, float(params["alpha"]))
            for j in np.flatnonzero(best == point):
                row[j] = solved[j]
        fits.append(row)
        chosen.append(best.tolist())
        scores[:, f] = [r2_from_sums(test, row[j], j) for j in range(labels)]
    return fits, scores, chosen


def _tune(parts: list[FoldSums], model: str, grid: list[tuple[Prep, dict]], labels: int) -> np.ndarray:
    """The grid point with the best mean inner score of each label column; the first one of equals."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole + part
    means = np.zeros((len(grid), labels))
    for i, (prep, params) in enumerate(grid):
        for part in parts:
            train = whole - part
            limit = max(1, min(train.g.shape[0] - 1, int(train.n)))
            fitted = prep if prep.n_components is None else replace(
                prep, n_components=min(prep.n_components, limit))
            solved = solve(train, fitted, model, float(params["alpha"]))
            means[i] += [r2_from_sums(part, solved[j], j) for j in range(labels)]
    return np.nanargmax(np.where(np.isnan(means), -np.inf, means), axis=0)
