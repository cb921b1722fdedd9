import numpy as np
import pyarrow as pa
import pytest

from lexistat.functions.sums import arrow_matrix
from lexistat.operators import neighbours
from lexistat.operators.descent import _met_neighbours, _orders, approximate_neighbours


def clustered(spark, n, dims=16, seed=1):
    """Overlapping clusters, one of them with a third of all vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 50, dims))
    at = np.where(rng.random(n) < 1 / 3, 0, rng.integers(len(centres), size=n))
    rows = centres[at] + 0.4 * rng.normal(size=(n, dims))
    return rows, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id bigint, vector array<double>")


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_lists_get_better_until_the_recall_is_reached(spark, metric):
    rows, points = clustered(spark, 3000)
    graph, reached = approximate_neighbours(points, 3000, 5, metric, recall=0.95, run=32)
    gaps = np.abs(rows[:, None] - rows[None]).sum(2) if metric == "manhattan" else np.linalg.norm(rows[:, None] - rows[None], axis=2)
    np.fill_diagonal(gaps, np.inf)
    nearest = np.argsort(gaps, axis=1)[:, :5]
    lists = {}
    for r in graph.collect():
        assert r["distance"] == pytest.approx(gaps[r["id"], r["other"]], abs=1e-6)
        lists.setdefault(r["id"], set()).add(r["other"])
    assert set(map(len, lists.values())) and min(map(len, lists.values())) >= 5 and len(lists) == 3000
    hits = np.mean([len(lists[i] & set(nearest[i])) / 5 for i in range(3000)])
    assert reached >= 0.95 and hits >= 0.92


def test_every_vector_gets_all_others_of_a_small_table(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "id bigint, embedding array<double>")
    got = neighbours.knn_graph(rows, 7, "id", metric="euclidean", method="approximate").collect()
    assert sorted((r["key"], r["neighbour"]) for r in got) == [(a, b) for a in range(4) for b in range(4) if a != b]
    one = neighbours.knn_graph(rows.where("id = 0"), 3, "id", method="approximate")
    assert one.count() == 0


def test_copies_are_neighbours_of_each_other(spark):
    rows = spark.createDataFrame([(i, [float(i // 10), 2.0]) for i in range(60)], "id bigint, embedding array<double>")
    exact, near = (sorted(map(tuple, neighbours.knn_graph(rows, 4, "id", metric="euclidean", method=m).collect()))
                   for m in ("exact", "approximate"))
    assert exact == near


def test_recall_is_counted_against_all_rows(spark):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(50)], "id bigint, embedding array<double>")
    exact = neighbours.knn_graph(rows, 2, "id", metric="euclidean")
    wrong = exact.where("key <> 20 or place = 1")
    counted = neighbours.neighbour_recall(wrong, rows, rows.where("id % 10 = 0"), 2, "id", metric="euclidean")
    assert sorted(map(tuple, counted.collect())) == [(0, 2, 2), (10, 2, 2), (20, 1, 1), (30, 2, 2), (40, 2, 2)]


def test_vectors_of_an_arrow_batch_become_a_matrix():
    rows = pa.array([[1.0, 2.0], [3.0, None], [5.0, 6.0]])
    np.testing.assert_array_equal(arrow_matrix(rows), [[1, 2], [3, np.nan], [5, 6]])
    np.testing.assert_array_equal(arrow_matrix(rows.slice(2)), [[5, 6]])
    assert arrow_matrix(pa.array([[], []], pa.list_(pa.float64()))).shape == (2, 0)
    for wrong in ([[1.0], None], [[1.0], [2.0, 3.0]]):
        with pytest.raises(ValueError):
            arrow_matrix(pa.array(wrong, pa.list_(pa.float64())))


def test_neighbourhoods_are_compared_in_arrow_batches(spark):
    _, points = clustered(spark, 100)
    graph = spark.createDataFrame([(0, 1, 0.5, True)], "id bigint, other bigint, distance double, fresh boolean")
    for found in (_met_neighbours(graph, points, 10, "euclidean"),
                  _orders(points, 100, points.select("id", "vector").limit(5).toPandas(), 10, "euclidean", 1, range(1), 32)):
        plan = found._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "MapInPandas" not in plan


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_vectors_in_single_precision_are_sent_as_such(spark, metric):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 6)).astype(np.float32)
    x[7], x[9] = 2 * x[8], 0.0  # a multiple, which is the same direction, and no direction
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id bigint, embedding array<float>")
    points, _ = neighbours.distinct_vectors(df, "id", "embedding", metric, short=True)
    for row in points.collect():
        assert (np.array(row["short"], dtype=np.float32).astype(float) / row["norm"] == np.array(row["vector"])).all()
    plan = _orders(points, 300, points.select("id", "vector").limit(5).toPandas(), 4, metric, 1, range(1), 32)
    sent = [line for line in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "salt#" in line and "xxhash64" in line]
    assert sent and all("short#" in line and "vector#" not in line for line in sent)
    long = df.withColumn("embedding", df["embedding"].cast("array<double>"))
    found, same = ({(r["key"], r["place"]): (r["neighbour"], r["distance"]) for r in
                    neighbours.knn_graph(d, 3, "id", metric=metric, method="approximate").collect()} for d in (df, long))
    assert found == same and len(found) == 900
