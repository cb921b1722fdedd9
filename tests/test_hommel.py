"""Hommel's procedure against its definition over all sizes."""

from __future__ import annotations

import time

import numpy as np
import pytest
from lexistat.operators import inference
from pyspark.sql import functions as F


def defined(p):
    order = np.argsort(p, kind="stable")
    p, m = np.sort(p), len(p)
    out = p.copy()
    for k in range(2, m + 1):
        ranks = np.arange(m - k, m)
        least = np.min(k * p[ranks] / (ranks - (m - k) + 1))
        out = np.maximum(out, np.where(np.arange(m) >= m - k, least, np.minimum(k * p, least)))
    back = np.empty(m)
    back[order] = np.minimum(out, 1)
    return back


@pytest.mark.parametrize("kind", ["uniform", "ties", "small", "convex", "zeros"])
def test_adjusted_values_follow_the_definition(kind):
    rng = np.random.default_rng(4)
    for m in (1, 2, 3, 17, 200):
        p = {"uniform": rng.uniform(size=m), "ties": rng.integers(1, 12, m) / 11, "small": rng.uniform(size=m) ** 6,
             "convex": (np.arange(1, m + 1) / m) ** 2, "zeros": np.where(rng.uniform(size=m) < 0.4, 0, rng.uniform(size=m))}[kind]
        levels, counts = np.unique(p, return_counts=True)
        last = np.cumsum(counts).astype(float)
        hull = inference.lower_hull(last, levels)
        x, y = last[hull], levels[hull]
        bounds = inference.least_bounds(np.arange(1, m + 1), x, y, m)
        exact = [min(k * levels[last > m - k] / (last[last > m - k] - (m - k))) for k in range(1, m + 1)]
        assert np.allclose(bounds, exact) and (np.diff(bounds) <= 1e-12).all()


def test_families_of_a_table(spark):
    rng = np.random.default_rng(5)
    rows = [(f"{f}-{i}", f, float(p)) for f, n in (("a", 300), ("b", 1), ("c", 40)) for i, p in enumerate(rng.uniform(size=n) ** 3)]
    rows += [(f"d-{i}", "d", (i % 5 + 1) / 40) for i in range(60)] + [("none", "a", None)]
    df = spark.createDataFrame(rows, "target string, feature_set string, p_value double")
    got = {r["target"]: r["p_adjusted"] for r in inference.adjust_pvalues(df, "hommel", ["feature_set"]).collect()}
    assert got.pop("none") is None
    for family in "abcd":
        names, values = zip(*[(t, p) for t, f, p in rows if f == family and p is not None])
        assert np.allclose([got[t] for t in names], defined(np.array(values)))


def test_a_large_family_takes_seconds(spark):
    df = spark.range(1_000_000).select(
        F.col("id").cast("string").alias("target"), F.lit("one").alias("feature_set"),
        ((F.xxhash64("id") % 1_000_000_000).cast("double") / 2e9 + 0.5).alias("p_value"))
    start = time.time()
    n, least = inference.adjust_pvalues(df, "hommel", ["feature_set"]).where("p_adjusted >= p_value").agg(
        F.count("*"), F.min("p_adjusted")).first()
    assert n == 1_000_000 and 0 < least <= 1 and time.time() - start < 90
