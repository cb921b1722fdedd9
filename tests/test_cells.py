"""Exact searches send a vector once to each group of cells."""

import numpy as np
from lexistat.operators import cells, neighbours


def test_groups_hold_all_cells_and_few_rows():
    pivots = np.random.default_rng(1).normal(size=(50, 3))
    rows = np.arange(50)
    group = cells.cell_groups(pivots, rows, 60)
    sizes = np.bincount(group, weights=rows)
    assert sorted(set(group)) == list(range(len(sizes))) and sizes.sum() == rows.sum()
    assert all(size <= 60 for size in sizes) and len(sizes) < 50
    assert set(cells.cell_groups(pivots, np.zeros(50, int), 60)) == {0}


def test_manhattan_tiles_equal_plain_sums():
    a, b = np.random.default_rng(2).normal(size=(70, 5)), np.random.default_rng(3).normal(size=(1100, 5))
    assert np.allclose(cells.distances(a, b, "manhattan"), np.abs(a[:, None] - b[None]).sum(2), atol=1e-12)


def test_a_vector_is_one_row_for_each_group(spark, monkeypatch):
    """In many dimensions every cell is in reach: 300 rows went to 17 cells each, and go to 3 groups."""
    monkeypatch.setattr(neighbours, "GROUPS", 3)
    points = np.random.default_rng(4).normal(size=(300, 40))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, embedding array<double>")
    sent, real = [], neighbours.block_pairs

    def counted(left, right, *rest):
        sent.append(right.count())
        return real(left, right, *rest)

    monkeypatch.setattr(neighbours, "block_pairs", counted)
    for metric, plain in (("euclidean", lambda g: np.sqrt((g * g).sum(1))), ("manhattan", lambda g: np.abs(g).sum(1))):
        got = neighbours.knn_graph(df, 3, "id", metric=metric, block_rows=20).collect()
        found = {(r.key, r.place): r.neighbour for r in got}
        for i in range(300):
            gaps = plain(points - points[i])
            gaps[i] = np.inf
            assert [found[i, p] for p in (1, 2, 3)] == np.argsort(gaps, kind="stable")[:3].tolist()
    assert max(sent) <= 300 * 8


def test_distances_that_single_precision_cannot_tell_apart(spark):
    """Values of 1e6 that differ in the eighth digit, and one of 1e12, have the right neighbours."""
    points = np.round(1e6 + np.random.default_rng(5).normal(size=(60, 4)), 3)
    points[7] = 1e12
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, embedding array<double>")
    for row in neighbours.knn_graph(df, 2, "id", metric="manhattan").collect():
        gaps = np.abs(points - points[row.key]).sum(1)
        gaps[row.key] = np.inf
        assert row.distance == np.sort(gaps)[row.place - 1]
