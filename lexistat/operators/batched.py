"""Logistic regression and linear SVM for many folds, permutations and grid points together.

Every model has its own training rows, but all of them read the same features: one Spark job gives
the loss and gradient of all models, so the number of jobs is the number of iterations, not of
models. Scaling, reduction and selection are linear maps of each model and never touch the rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lexistat.functions.sums import matrix, table_sums
from lexistat.operators.preprocess import Prep, TrainSums, class_scores, fit_map, keep_mask

BLOCK_NUMBERS = 4_000_000  # sums that one job adds up: weights, or curvatures for Newton steps
NEWTON_JOBS, GRADIENT_JOBS = 10, 60  # jobs that one block of models usually takes
CHUNK_NUMBERS = 4_000_000  # scores of one chunk of rows
MEMORY = 8


@dataclass(frozen=True)
class ModelSpec:
    """One model: trained where the fold of `perm` is not `fold`, and the inner fold is not `inner`."""

    perm: int
    fold: int
    inner: int
    c: float
    prep: Prep


@dataclass
class Fitted:
    """weights[class, feature] and intercepts[class] on raw features; one row when there are two classes."""

    weights: np.ndarray
    intercepts: np.ndarray


def _masks(batch: pd.DataFrame, specs: list[ModelSpec], n_folds: int) -> tuple[np.ndarray, ...]:
    """(x with a leading 1, label of each row for each model, training rows, test rows)."""
    x = matrix(batch["features"])
    x1 = np.hstack([np.ones((len(x), 1)), x])
    perm = np.array([s.perm for s in specs])
    fold = np.array([s.fold for s in specs])
    inner = np.array([s.inner for s in specs])
    labels = matrix(batch["ys"]).astype(int)[:, perm]
    outside = matrix(batch["folds"]).astype(int)[:, perm] != fold
    if (inner >= 0).any():
        own = matrix(batch["inners"]).astype(int)[:, perm * n_folds + fold]
        tuned = inner >= 0
        train = outside & (~tuned | (own != inner))
        test = np.where(tuned, outside & (own == inner), ~outside)
    else:
        train, test = outside, ~outside
    return x1, labels, train, test


def _chunks(batch: pd.DataFrame, width: int):
    step = max(1, CHUNK_NUMBERS // max(1, width))
    for start in range(0, len(batch), step):
        yield batch.iloc[start:start + step]


def _statistics(data: DataFrame, specs: list[ModelSpec], classes: int, d: int, n_folds: int) -> list[TrainSums]:
    full = any(s.prep.n_components is not None for s in specs)
    by_class = any(s.prep.selection in ("kbest", "percentile") for s in specs)

    def accumulate(batch: pd.DataFrame) -> np.ndarray:
        total = 0.0
        for part in _chunks(batch, len(specs) * (classes if by_class else 1)):
            x1, labels, train, _ = _masks(part, specs, n_folds)
            x = x1[:, 1:]
            w = train.astype(float)
            pieces = [w.sum(0)[:, None], w.T @ x]
            if full:
                pairs = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                pieces.append(w.T @ pairs)
            else:
                pieces.append(w.T @ (x * x))
            if by_class:
                for c in range(classes):
                    wc = w * (labels == c)
                    pieces += [wc.sum(0)[:, None], wc.T @ x]
            total = total + np.hstack(pieces)
        return total

    sums = table_sums(data, accumulate)
    out = []
    for row in sums:
        end = 1 + d + (d * d if full else d)
        sxx = row[1 + d:end].reshape(d, d) if full else row[1 + d:end]
        per = row[end:].reshape(classes, 1 + d) if by_class else None
        out.append(TrainSums(
            row[0], row[1:1 + d], sxx,
            None if per is None else per[:, 0], None if per is None else per[:, 1:],
        ))
    return out


def _map_of(sums: TrainSums, prep: Prep) -> tuple[np.ndarray, np.ndarray]:
    a, mean = fit_map(sums, prep)
    if prep.selection is None:
        return a, mean
    if prep.selection == "variance":
        if sums.sxx.ndim == 1:
            variance = np.diag(a) ** 2 * (sums.sxx / sums.n - mean * mean)
        else:
            variance = np.einsum("ij,jk,ik->i", a, sums.sxx / sums.n - np.outer(mean, mean), a)
        return a[keep_mask(variance, variance, prep)], mean
    f, variance = class_scores(sums, a, mean)
    return a[keep_mask(f, variance, prep)], mean


def train_models(
    data: DataFrame, specs: list[ModelSpec], classes: int, d: int, n_folds: int, loss: str = "logistic",
    max_iter: int = 1000, tol: float = 1e-4,
) -> list[Fitted]:
    """Fit all models. `data` has features, ys, folds and, for inner models, inners."""
    heads = 1 if classes == 2 else classes
    weights = heads * (d + 1)
    curvature = weights * (d + 1) * (1 if loss == "squared_hinge" else heads)
    # Newton steps need few jobs but many sums per model; otherwise only gradients are added up.
    newton_blocks = -(-len(specs) * curvature // BLOCK_NUMBERS)
    gradient_blocks = -(-len(specs) * weights // BLOCK_NUMBERS)
    newton = curvature <= BLOCK_NUMBERS and newton_blocks * NEWTON_JOBS <= gradient_blocks * GRADIENT_JOBS
    block = max(1, BLOCK_NUMBERS // (curvature if newton else weights))
    gram = None if newton else _total_gram(data)
    fitted: list[Fitted] = []
    for start in range(0, len(specs), block):
        part = specs[start:start + block]
        fitted += _train_block(data, part, classes, heads, d, n_folds, loss, gram, max_iter, tol)
    return fitted


def _total_gram(data: DataFrame) -> np.ndarray:
    def accumulate(batch: pd.DataFrame) -> np.ndarray:
        x = matrix(batch["features"])
        x1 = np.hstack([np.ones((len(x), 1)), x])
        return x1.T @ x1

    return table_sums(data.select("features"), accumulate)


def _train_block(
    data: DataFrame, specs: list[ModelSpec], classes: int, heads: int, d: int, n_folds: int, loss: str,
    gram: np.ndarray | None, max_iter: int, tol: float,
) -> list[Fitted]:
    sums = _statistics(data, specs, classes, d, n_folds)
    size = np.array([s.n for s in sums])
    maps = [_map_of(s, spec.prep) for s, spec in zip(sums, specs)]
    q = max(len(a) for a, _ in maps)
    # z1 = t x1 with a leading 1: the affine map of every model as one (q + 1) x (d + 1) matrix.
    t = np.zeros((len(specs), q + 1, d + 1))
    t[:, 0, 0] = 1.0
    for m, (a, mean) in enumerate(maps):
        t[m, 1:1 + len(a), 1:] = a
        t[m, 1:1 + len(a), 0] = -a @ mean
    ridge = np.full((len(specs), q + 1), 1.0)
    if loss == "logistic":
        ridge[:, 0] = 0.0  # the intercept is free; the SVM penalises it
    scale = np.array([1.0 / s.c for s in specs])[:, None] * ridge  # per unit of summed loss

    newton = gram is None
    q1 = q + 1

    def evaluate(w: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        chosen = [specs[m] for m in active]
        ta, penalty = t[active], scale[active]
        raw = np.einsum("mhi,mij->mhj", w[active], ta)  # weights on [1 x]
        got = table_sums(data, _loss_job(chosen, raw, loss, n_folds, newton))
        value = got[:, 0] + 0.5 * (penalty[:, None, :] * w[active] ** 2).sum((1, 2))
        end = 1 + heads * (d + 1)
        slope = got[:, 1:end].reshape(len(active), heads, d + 1)
        grad = np.einsum("mij,mhj->mhi", ta, slope) + penalty[:, None, :] * w[active]
        if not newton:
            return value, grad, None
        blocks = got[:, end:].reshape(len(active), -1, d + 1, d + 1)
        bent = np.einsum("mij,mpjk,mlk->mpil", ta, blocks, ta, optimize=True)
        return value, grad, _newton_steps(bent, grad, penalty, heads, loss)

    start = np.zeros((len(specs), heads, q1))
    if newton:
        w = _newton(evaluate, start, size, max_iter, tol)
    else:
        # A bound of the curvature of every loss, from the sums over all rows: the shape of each step.
        bend = {"logistic": 0.25 if classes == 2 else 0.5, "squared_hinge": 2.0}[loss]
        curve = np.einsum("mij,jk,mlk->mil", t, gram * bend, t, optimize=True)
        idx = np.arange(q1)
        curve[:, idx, idx] += scale + 1e-9
        w = _minimise(evaluate, start, np.linalg.inv(curve), size, max_iter, tol)
    raw = np.einsum("mhi,mij->mhj", w, t)
    return [Fitted(r[:, 1:], r[:, 0]) for r in raw]


def _newton_steps(
    bent: np.ndarray, grad: np.ndarray, penalty: np.ndarray, heads: int, loss: str
) -> np.ndarray:
    """The step of every model: minus the inverse curvature times the gradient."""
    models, _, q1 = grad.shape
    idx = np.arange(q1)
    tiny = 1e-9
    if loss == "squared_hinge" or heads == 1:
        bent[:, :, idx, idx] += penalty[:, None, :] + tiny
        return -np.linalg.solve(bent, grad[..., None])[..., 0]
    full = bent.reshape(models, heads, heads, q1, q1).transpose(0, 1, 3, 2, 4).reshape(
        models, heads * q1, heads * q1).copy()
    wide = np.arange(heads * q1)
    full[:, wide, wide] += np.tile(penalty, heads) + 1e-6
    return -np.linalg.solve(full, grad.reshape(models, -1, 1)).reshape(grad.shape)


def _newton(evaluate: Callable, w: np.ndarray, size: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Newton steps, halved per model while its loss does not fall; one job per round."""
    models = len(w)
    value, grad, direction = evaluate(w, np.arange(models))
    step = np.ones(models)
    for _ in range(max_iter):
        still = np.flatnonzero((np.abs(grad).max((1, 2)) > tol * size) & (step > 1e-10))
        if not len(still):
            break
        trial = w.copy()
        trial[still] += step[still, None, None] * direction[still]
        new_value, new_grad, new_direction = evaluate(trial, still)
        slope = (grad[still] * direction[still]).sum((1, 2))
        good = new_value <= value[still] + 1e-4 * step[still] * slope + 1e-10 * np.abs(value[still])
        took = still[good]
        w[took], value[took], grad[took], direction[took] = (
            trial[took], new_value[good], new_grad[good], new_direction[good])
        step[took] = 1.0
        step[still[~good]] *= 0.5
    _warn_open(grad, size, tol)
    return w


def _warn_open(grad: np.ndarray, size: np.ndarray, tol: float) -> None:
    left = int((np.abs(grad).max((1, 2)) > tol * size).sum())
    if left:
        warnings.warn(f"{left} of {len(grad)} models did not converge", RuntimeWarning, stacklevel=3)


def _loss_job(
    specs: list[ModelSpec], raw: np.ndarray, loss: str, n_folds: int, curvature: bool
) -> Callable[[pd.DataFrame], np.ndarray]:
    """Per model: the loss, its gradient on [1 x], and on request its curvature, over training rows."""
    models, heads, width = raw.shape
    flat = raw.reshape(models * heads, width)
    pairs = heads if loss == "squared_hinge" or heads == 1 else heads * heads
    extra = pairs * width * width if curvature else 0

    def accumulate(batch: pd.DataFrame) -> np.ndarray:
        total = np.zeros((models, 1 + heads * width + extra))
        for part in _chunks(batch, max(models * (pairs if curvature else heads), width * width)):
            x1, labels, train, _ = _masks(part, specs, n_folds)
            keep = train.astype(float)[:, :, None]
            score = (x1 @ flat.T).reshape(len(x1), models, heads)
            if loss == "logistic" and heads == 1:
                y = labels[:, :, None]
                chance = 1.0 / (1.0 + np.exp(-np.clip(score, -500, 500)))
                value = np.logaddexp(0.0, score) - y * score
                pull, bend = chance - y, chance * (1.0 - chance)
            elif loss == "logistic":
                top = score.max(axis=2, keepdims=True)
                e = np.exp(score - top)
                sum_e = e.sum(axis=2, keepdims=True)
                chance = e / sum_e
                own = labels[:, :, None] == np.arange(heads)
                value = np.log(sum_e) + top - (score * own).sum(axis=2, keepdims=True)
                pull = chance - own
                bend = chance[:, :, :, None] * (np.eye(heads) - chance[:, :, None, :]) if curvature else None
            else:
                target = labels[:, :, None] == (np.array([1]) if heads == 1 else np.arange(heads))
                side = np.where(target, 1.0, -1.0)
                gap = np.maximum(1.0 - side * score, 0.0)
                value, pull, bend = gap**2, -2.0 * side * gap, 2.0 * (gap > 0)
            total[:, 0] += (value * keep).sum((0, 2))
            pulled = (pull * keep).reshape(len(x1), models * heads)
            total[:, 1:1 + heads * width] += (pulled.T @ x1).reshape(models, heads * width)
            if curvature:
                weight = bend.reshape(len(x1), models, pairs) * keep
                products = (x1[:, :, None] * x1[:, None, :]).reshape(len(x1), -1)
                total[:, 1 + heads * width:] += (
                    weight.reshape(len(x1), -1).T @ products).reshape(models, extra)
        return total

    return accumulate


def _minimise(
    evaluate: Callable, w: np.ndarray, inverse: np.ndarray, size: np.ndarray, max_iter: int, tol: float
) -> np.ndarray:
    """Limited-memory quasi-Newton steps for all models at once; each evaluation is one Spark job."""
    models = len(w)
    everyone = np.arange(models)
    value, grad, _ = evaluate(w, everyone)
    past: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = np.ones(models)
    direction = -np.einsum("mij,mhj->mhi", inverse, grad)
    for _ in range(max_iter):
        open_models = np.flatnonzero(np.abs(grad).max((1, 2)) > tol * size)
        if not len(open_models):
            break
        trial = w.copy()
        trial[open_models] += step[open_models, None, None] * direction[open_models]
        new_value, new_grad, _ = evaluate(trial, open_models)
        slope = (grad[open_models] * direction[open_models]).sum((1, 2))
        good = new_value <= value[open_models] + 1e-4 * step[open_models] * slope + 1e-10 * np.abs(
            value[open_models])
        took = open_models[good]
        step[open_models[~good]] *= 0.5
        move = np.zeros_like(w)
        turn = np.zeros_like(w)
        move[took] = trial[took] - w[took]
        turn[took] = new_grad[good] - grad[took]
        w[took], value[took], grad[took] = trial[took], new_value[good], new_grad[good]
        if len(took):
            bend = (move * turn).sum((1, 2))
            past.append((move, turn, np.where(bend > 1e-14, bend, 0.0)))
            past = past[-MEMORY:]
            fresh = _direction(grad, past, inverse)
            uphill = (fresh * grad).sum((1, 2)) >= 0
            fresh[uphill] = -np.einsum("mij,mhj->mhi", inverse[uphill], grad[uphill])
            direction[took] = fresh[took]
            step[took] = 1.0
        if (step < 1e-12).all():
            break
    _warn_open(grad, size, tol)
    return w


def _direction(grad: np.ndarray, past: list, inverse: np.ndarray) -> np.ndarray:
    q = grad.copy()
    shares = []
    for move, turn, bend in reversed(past):
        rate = np.divide(1.0, bend, out=np.zeros_like(bend), where=bend > 0)
        a = rate * (move * q).sum((1, 2))
        q -= a[:, None, None] * turn
        shares.append((a, rate))
    r = np.einsum("mij,mhj->mhi", inverse, q)
    for (move, turn, _), (a, rate) in zip(past, reversed(shares)):
        b = rate * (turn * r).sum((1, 2))
        r += (a - b)[:, None, None] * move
    return -r


def predict_codes(x: np.ndarray, model: Fitted) -> np.ndarray:
    score = x @ model.weights.T + model.intercepts
    return (score[:, 0] > 0).astype(int) if score.shape[1] == 1 else score.argmax(axis=1)


def held_out_accuracy(data: DataFrame, specs: list[ModelSpec], fitted: list[Fitted], n_folds: int) -> np.ndarray:
    """Accuracy of every model on its test rows, in one job."""
    raw = np.stack([np.hstack([f.intercepts[:, None], f.weights]) for f in fitted])
    models, heads, width = raw.shape
    flat = raw.reshape(models * heads, width)

    def accumulate(batch: pd.DataFrame) -> np.ndarray:
        total = np.zeros((models, 2))
        for part in _chunks(batch, models * heads):
            x1, labels, _, test = _masks(part, specs, n_folds)
            score = (x1 @ flat.T).reshape(len(x1), models, heads)
            guess = (score[:, :, 0] > 0).astype(int) if heads == 1 else score.argmax(axis=2)
            total[:, 0] += ((guess == labels) & test).sum(0)
            total[:, 1] += test.sum(0)
        return total

    sums = np.rint(table_sums(data, accumulate))  # counts; equal accuracies must compare as equal
    return np.divide(sums[:, 0], sums[:, 1], out=np.full(models, np.nan), where=sums[:, 1] > 0)



