"""Manhattan neighbours settled from 16-bit sums."""

import numpy as np
import pytest

from lexistat.operators import cells, neighbours


@pytest.mark.parametrize("dims", [2, 5, 64, 700])
def test_whole_numbers_are_off_by_a_step_for_each_dimension(dims):
    rng = np.random.default_rng(dims)
    a, b = rng.normal(size=(130, dims)) + 1e3, rng.normal(size=(2_300, dims)) * 2 + 1e3
    one, two = cells.whole_numbers(a, b)
    assert one.dtype == np.uint16 and one.sum(1, dtype=np.int64).max() <= 65_535 and two.sum(1, dtype=np.int64).max() <= 65_535
    found = cells.whole_order(one, two) + one.sum(1, dtype=np.int64)[:, None]
    assert (found[:, :50] == np.abs(one[:, None].astype(int) - two[None, :50]).sum(2)).all()
    low, high = np.minimum(a.min(0), b.min(0)), np.maximum(a.max(0), b.max(0))
    step = (high - low).max() / (65_535 // dims)
    assert np.abs(found * step - cells.distances(a, b, "manhattan")).max() <= (dims + 0.01) * step


def test_steps_too_coarse_are_refused():
    ones = np.ones((3, 4))
    assert cells.whole_numbers(ones, ones) is None
    assert cells.whole_numbers(np.zeros((2, 2_000)), np.ones((2, 2_000))) is None


@pytest.mark.parametrize("wide", [1.0, 1e7])
def test_manhattan_neighbours_are_exact(spark, wide):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[0, 0] *= wide  # so that one step may be wider than all other distances
    x[1::40] = x[2::40]  # copies
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id bigint, embedding array<double>")
    found = {}
    for r in neighbours.knn_graph(df, 4, "id", metric="manhattan", block_rows=100).collect():
        found.setdefault(r["key"], []).append((r["distance"], r["neighbour"], r["place"]))
    gaps = np.abs(x[:, None] - x[None]).sum(2)
    np.fill_diagonal(gaps, np.inf)
    for i in range(400):
        best = sorted((gaps[i, j], j) for j in range(400))[:4]
        got = sorted(found[i], key=lambda t: t[2])
        assert [g[1] for g in got] == [b[1] for b in best] and np.allclose([g[0] for g in got], [b[0] for b in best])
