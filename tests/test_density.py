"""Density clusters against a plain implementation over all pairs, whole and in many small runs."""

from __future__ import annotations

import numpy as np
import pytest
from lexistat.operators import density
from lexistat.operators.density import snapped, spanning_links


def plain_clusters(points, k, least):
    """Label of each row by single linkage over mutual reachability, excess of mass, and its smallest row."""
    n = len(points)
    gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    core = np.sort(gap + np.where(np.eye(n, dtype=bool), np.inf, 0), axis=1)[:, k - 1]
    far = snapped(np.maximum(gap, np.maximum(core[:, None], core[None, :])))
    home = np.arange(n)
    tree, cluster = [], {}  # clusters by number; smallest row of a group -> its cluster

    def best(c):
        return max(tree[c]["stable"], sum(best(x) for x in tree[c]["inner"]))

    for w in np.unique(far[~np.eye(n, dtype=bool)]):
        before = home.copy()
        for i, j in zip(*np.nonzero(np.triu(far == w, 1))):
            home[home == home[j]] = home[i]
        for h in np.unique(home[home != before]):
            rows = np.flatnonzero(home == h)
            parts = [cluster.pop(g) for g in np.unique(before[rows]) if g in cluster]
            dense = 1 / max(w, 1e-12)
            if len(parts) == 1:
                c = parts[0]
                tree[c]["mass"] += (len(rows) - len(tree[c]["rows"])) * dense
                tree[c]["rows"] = rows
            elif len(rows) >= least:
                for c in parts:
                    tree[c]["stable"] = tree[c]["mass"] - len(tree[c]["rows"]) * dense
                c = len(tree)
                tree.append({"rows": rows, "mass": len(rows) * dense, "inner": parts, "stable": -1})
            else:
                continue
            cluster[h] = c
    label = [None] * n
    open_ = [x for c in cluster.values() for x in tree[c]["inner"]]
    while open_:
        c = open_.pop()
        if tree[c]["stable"] >= sum(best(x) for x in tree[c]["inner"]):
            for r in tree[c]["rows"]:
                label[r] = int(min(tree[c]["rows"]))
        else:
            open_ += tree[c]["inner"]
    return label


def samples():
    rng = np.random.default_rng(3)
    blobs = np.vstack([rng.normal(size=(n, 2)) * s + c for n, s, c in (
        (60, 0.3, (0, 0)), (40, 0.2, (2, 0)), (50, 1.0, (9, 9)), (30, 0.1, (-6, 4)))])
    flat = rng.uniform(-12, 12, (80, 2))
    copies = np.repeat(rng.uniform(-3, 3, (4, 2)), (1, 7, 25, 40), axis=0)
    return {
        "blobs": np.vstack([blobs, flat]), "copies": np.vstack([blobs[:90], copies, flat[:20]]),
        "line": np.cumsum(rng.uniform(0.1, 1, (150, 1)), axis=0) * np.ones((1, 2)),
        "far": np.vstack([blobs, [[1e6, -1e6]]]), "wide": rng.normal(size=(120, 6)),
    }


def found(spark, points, k, least, **options):
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id bigint, embedding array<double>")
    got = density.density_cluster(rows, "id", min_cluster_size=least, min_samples=k, **options)
    return [r["root"] for r in sorted(got.collect(), key=lambda r: r["key"])]


@pytest.mark.parametrize("name", sorted(samples()))
def test_clusters_equal_the_plain_ones(spark, name):
    points = samples()[name]
    expected = plain_clusters(points, 5, 10)
    assert found(spark, points, 5, 10, cell_rows=60, block_rows=40) == expected
    if name in ("blobs", "copies"):
        assert len(set(expected)) > 3


def test_many_runs_equal_one(spark):
    points = samples()["blobs"][:90]  # one cell, so one link fewer than points
    assert found(spark, points, 4, 8, run_links=60) == plain_clusters(points, 4, 8)


def test_small_tables(spark):
    rng = np.random.default_rng(1)
    assert found(spark, rng.normal(size=(4, 2)), 5, 5) == [None] * 4  # fewer rows than a core needs
    assert found(spark, np.zeros((30, 2)), 5, 5) == [None] * 30  # one group that holds everything is no choice
    empty = spark.createDataFrame([], "id bigint, embedding array<double>")
    assert density.density_cluster(empty, "id").collect() == []


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 5), (30, 30)])
def test_forests_are_lightest(shape):
    rng = np.random.default_rng(2)
    w = np.round(rng.uniform(0, 1, shape), 2)
    w[rng.uniform(size=shape) < 0.3] = np.inf

    def weight(links):
        root = list(range(sum(shape)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        total = count = 0
        for v, i, j in sorted(links):
            a, b = find(i), find(j)
            if a != b:
                root[a], total, count = b, total + v, count + 1
        return round(total, 6), count

    every = [(w[i, j], i, shape[0] + j) for i in range(shape[0]) for j in range(shape[1]) if np.isfinite(w[i, j])]
    a, b = spanning_links(w, False)
    assert weight([(w[i, j], i, shape[0] + j) for i, j in zip(a, b)]) == weight(every) and len(a) == weight(every)[1]
