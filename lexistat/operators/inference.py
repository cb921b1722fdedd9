"""Permutation p-values and corrections for many tests."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of the correction methods and the other names each one goes by.
METHODS = {
    "bonferroni": ("b", "bonf", "bonferroni"),
    "sidak": ("s", "sidak"),
    "holm-sidak": ("hs", "holm-sidak"),
    "holm": ("h", "holm"),
    "simes-hochberg": ("sh", "simes-hochberg", "hochberg"),
    "hommel": ("ho", "hommel"),
    "fdr_bh": ("fdr_bh", "fdr_i", "fdr_p", "fdri", "fdrp"),
    "fdr_by": ("fdr_by", "fdr_n", "fdr_c", "fdrn", "fdrcorr"),
    "fdr_tsbh": ("fdr_tsbh", "fdr_2sbh"),
    "fdr_tsbky": ("fdr_tsbky", "fdr_2sbky", "fdr_twostage"),
    "fdr_gbs": ("fdr_gbs",),
}
OFF = {"none", "no", "off", "false", "0", "na", "n/a"}
SCOPE_COLUMNS = {"all_tests": [], "within_target": ["target_name"], "within_feature_set": ["feature_set"]}
EULER = 0.5772156649015329
ALPHA = 0.05


def permutation_pvalue(
    scores: DataFrame, observed: DataFrame, by: Sequence[str] = ("target",), larger_is_better: bool = True
) -> DataFrame:
    """(by..., observed, n_permutations, p_value): (1 + as good or better) / (permutations + 1)."""
    joined = scores.join(observed.select(*by, "observed"), list(by))
    good = F.col("score") >= F.col("observed") if larger_is_better else F.col("score") <= F.col("observed")
    return joined.groupBy(*by, "observed").agg(
        F.count(F.lit(1)).alias("n_permutations"),
        ((F.lit(1.0) + F.count_if(good)) / (F.count(F.lit(1)) + F.lit(1.0))).alias("p_value"),
    )


def normalize_correction_method(method: str | None) -> str | None:
    name = "none" if method is None else str(method).strip().lower()
    return None if name in OFF else name


def canonical_method(method: str) -> str | None:
    return next((name for name, others in METHODS.items() if method in others), None)


def adjust_pvalues(
    results: DataFrame, method: str | None = "fdr_bh", group_cols: Sequence[str] | None = None,
    scope_label: str | None = None,
) -> DataFrame:
    """Add p_adjusted, p_adjust_method, p_fdr and p_adjust_scope; null p-values stay null.

    Equal p-values of a family get equal results, so the work is done on the distinct p-values with
    their counts: at most one more than there are permutations, however many tests there are.
    """
    if "p_value" not in results.columns:
        return results
    name = normalize_correction_method(method)
    known = canonical_method(name) if name else None
    if name and known is None:
        warnings.warn(f"Unknown correction method '{method}'. Skipping adjustment.", RuntimeWarning)
    base = results.drop("p_adjusted", "p_adjust_method", "p_fdr", "p_adjust_scope")
    if known is None:
        return base.withColumns(
            {"p_adjusted": F.lit(None).cast("double"), "p_adjust_method": F.lit(None).cast("string"),
             "p_fdr": F.lit(None).cast("double"), "p_adjust_scope": F.lit(None).cast("string")}
        )
    groups = [c for c in group_cols or [] if c in base.columns]
    family = F.to_json(F.struct(F.lit(0).alias("all"), *[F.col(c) for c in groups]))
    p = F.when(~F.isnan(F.col("p_value").cast("double")), F.col("p_value").cast("double"))
    keyed = base.withColumns({"_family": family, "_p": p})
    levels = keyed.where("_p IS NOT NULL").groupBy("_family", "_p").agg(F.count(F.lit(1)).alias("c"))
    solved = _adjust_levels(_ranked_levels(levels), known)
    joined = keyed.join(solved.select("_family", "_p", "p_adjusted"), ["_family", "_p"], "left")
    done = F.col("p_adjusted").isNotNull()
    scope = F.lit(None if scope_label is None else str(scope_label)).cast("string")
    return joined.select(
        *base.columns, "p_adjusted", F.when(done, name).alias("p_adjust_method"),
        (F.col("p_adjusted") if name == "fdr_bh" else F.lit(None).cast("double")).alias("p_fdr"),
        scope.alias("p_adjust_scope"),
    )


def _ranked_levels(levels: DataFrame) -> DataFrame:
    """Add m (tests of the family) and the first and last rank of each distinct p-value."""
    rising = Window.partitionBy("_family").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = levels.withColumn("last", F.sum("c").over(rising))
    return ranked.withColumns(
        {"first": F.col("last") - F.col("c") + 1, "m": F.sum("c").over(Window.partitionBy("_family"))}
    )


def _harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m; beyond 1,000 by its expansion, whose error is below 1e-20 there."""
    short = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.least(m, F.lit(1000).cast("bigint"))),
                        F.lit(0.0), lambda s, j: s + 1.0 / j)
    square = m.cast("double") * m
    long = F.log(m.cast("double")) + EULER + 0.5 / m - 1.0 / (12.0 * square) + 1.0 / (120.0 * square * square)
    return F.when(m <= 1000, short).otherwise(long)


def _adjust_levels(levels: DataFrame, method: str) -> DataFrame:
    if method == "hommel":
        return _hommel(levels)
    p, m = F.col("_p"), F.col("m")
    by_p = Window.partitionBy("_family").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    from_top = Window.partitionBy("_family").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)

    def none_of(times: Column) -> Column:
        """1 - (1 - p) ** times without losing small p."""
        return F.when(p >= 1, 1.0).otherwise(-F.expm1(times * F.log1p(-F.when(p < 1, p))))

    step_up = F.min(p * m / F.col("last")).over(from_top)
    remaining = m - F.col("first") + 1
    if method == "bonferroni":
        value = p * m
    elif method == "sidak":
        value = none_of(m)
    elif method == "holm":
        value = F.max(remaining * p).over(by_p)
    elif method == "holm-sidak":
        value = F.max(none_of(remaining)).over(by_p)
    elif method == "simes-hochberg":
        value = F.min((m - F.col("last") + 1) * p).over(from_top)
    elif method == "fdr_bh":
        value = step_up
    elif method == "fdr_by":
        value = step_up * _harmonic(m)
    elif method == "fdr_gbs":
        odds = F.when(p < 1, p / (1 - F.when(p < 1, p))).otherwise(F.lit(float("inf")))
        value = F.max(remaining / F.col("first") * odds).over(by_p)
    else:  # two-stage: a first pass estimates how many hypotheses are true
        factor = 1.0 + ALPHA if method == "fdr_tsbky" else 1.0
        first = levels.withColumn("bh", F.least(step_up, F.lit(1.0)))
        rejected = F.sum(F.when(F.col("bh") <= ALPHA / factor, F.col("c")).otherwise(0)).over(
            Window.partitionBy("_family")
        )
        share = F.when((rejected > 0) & (rejected < m), (m - rejected) / m).otherwise(1.0)
        return first.withColumn("p_adjusted", F.least(F.col("bh") * share * factor, F.lit(1.0)))
    return levels.withColumn("p_adjusted", F.least(value, F.lit(1.0)))


PIECES = 64  # parts of a family, by the hash of the p-value


def lower_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of the corners of the lower convex hull of points with ascending x."""
    kept: list[int] = []
    for i in range(len(x)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if (x[b] - x[a]) * (y[i] - y[a]) > (x[i] - x[a]) * (y[b] - y[a]):
                break
            kept.pop()
        kept.append(i)
    return np.array(kept, dtype=int)


def least_bounds(sizes: np.ndarray, x: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """For each size k, k times the least p / (rank - (m - k)) over the ranks beyond m - k.

    That is the flattest line from (m - k, 0) to a level; it touches the hull (x, y) of all levels, because levels
    to the left lie above it anyway. Size 0 has no bound, sizes beyond m have none left.
    """
    start = m - sizes
    with np.errstate(divide="ignore", invalid="ignore"):
        rise = np.diff(y)
        cross = np.where(rise > 0, x[:-1] - y[:-1] * np.diff(x) / rise, -np.inf)
        at = np.searchsorted(np.maximum.accumulate(cross), start, side="right") if len(cross) else np.zeros(len(sizes), int)
        best = np.full(len(sizes), np.inf)
        for step in (-1, 0, 1):  # the neighbours too, where rounding moved a corner
            q = np.clip(at + step, 0, len(x) - 1)
            room = x[q] - start
            best = np.minimum(best, np.where(room > 0, sizes * y[q] / room, np.inf))
    return np.where(sizes > m, 0.0, np.where(sizes < 1, np.inf, best))


def _hommel(levels: DataFrame) -> DataFrame:
    """Hommel's procedure on the distinct p-values of each family.

    With c_k = least_bounds(k), which falls as k grows, a p-value is adjusted to min(k p, c_k) for the smallest k
    with k p >= c_(k + 1). Hulls are built in hash pieces and merged, so a task gets a piece of a family or the
    corners of its hull, and each piece searches k for its own p-values by halving.
    """
    piece = F.pmod(F.xxhash64("_p"), F.lit(PIECES)).cast("int")
    rows = levels.select(F.col("_family"), "_p", F.col("last").cast("double").alias("last"), "m", piece.alias("piece"))

    def hull_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, y = pdf["last"].to_numpy(), pdf["_p"].to_numpy()
        order = np.argsort(x, kind="stable")
        kept = order[lower_hull(x[order], y[order])]
        return x[kept], y[kept]

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = hull_of(pdf)
        return pd.DataFrame({"_family": [str(pdf["_family"].iloc[0])] * len(x), "_p": y, "last": x})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = hull_of(pdf)
        return pd.DataFrame({"_family": [str(pdf["_family"].iloc[0])], "x": [x], "y": [y]})

    parts = rows.groupBy("_family", "piece").applyInPandas(corners, "_family string, _p double, last double")
    hulls = parts.groupBy("_family").applyInPandas(whole, "_family string, x array<double>, y array<double>")
    # One hull for each piece of a family.
    dealt = hulls.select("_family", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece"))

    def solve(own: pd.DataFrame, hull: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame()
        x, y = (np.asarray(hull[c].iloc[0], dtype=float) for c in ("x", "y"))
        p, m = own["_p"].to_numpy(), int(own["m"].iloc[0])
        low, high = np.zeros(len(p), np.int64), np.full(len(p), m, np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            enough = middle * p >= least_bounds(middle + 1, x, y, m)
            high, low = np.where(enough, middle, high), np.where(enough, low, middle + 1)
        out = np.minimum(low * p, least_bounds(low, x, y, m))
        return pd.DataFrame({"_family": [str(own["_family"].iloc[0])] * len(p), "_p": p, "p_adjusted": np.clip(out, p, 1.0)})

    return rows.groupBy("_family", "piece").cogroup(dealt.groupBy("_family", "piece")).applyInPandas(
        solve, "_family string, _p double, p_adjusted double"
    )


def permutation_histogram(
    scores: DataFrame, observed: DataFrame, nbins: int = 30, by: Sequence[str] = ("target",)
) -> DataFrame:
    """(by..., bin, low, high, n, observed): equal-width bins over the scores, empty ones included."""
    if nbins < 1:
        raise ValueError("nbins must be at least 1")
    ends = scores.groupBy(*by).agg(F.min("score").alias("least"), F.max("score").alias("most"))
    width = (F.col("most") - F.col("least")) / nbins
    number = F.when(F.col("most") > F.col("least"),
                    F.least(F.floor(F.try_divide(F.col("score") - F.col("least"), width)), F.lit(nbins - 1))
                    ).otherwise(0)
    counts = scores.join(ends, list(by)).groupBy(*by, number.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    bins = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))))
    return (
        bins.join(counts, [*by, "bin"], "left").join(observed.select(*by, "observed"), list(by), "left")
        .select(*by, "bin", (F.col("least") + F.col("bin") * width).alias("low"),
                (F.col("least") + (F.col("bin") + 1) * width).alias("high"),
                F.coalesce("n", F.lit(0)).alias("n"), "observed")
    )
