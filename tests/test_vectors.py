import numpy as np
import pytest
from pyspark.sql import functions as F

from lexistat.functions.ranks import hash_order, number_by_hash
from lexistat.functions.session import checkpoint_folder
from lexistat.operators import density, embed, neighbours, project, topicplots, topics

RNG = np.random.RandomState(7)


def frame(spark, points, ids=None):
    ids = range(len(points)) if ids is None else ids
    return spark.createDataFrame(
        [(int(i), [float(v) for v in p]) for i, p in zip(ids, points)], "id int, embedding array<double>")


def brute_knn(points, k):
    gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    return [sorted(range(len(points)), key=lambda j: (round(gap[i, j], 9), j))[:k] for i in range(len(points))], gap


@pytest.mark.parametrize("block", [4096, 7])
def test_neighbours_with_many_copies(spark, block):
    points = RNG.randn(60, 3)
    points[:20] = points[0]  # a third of all rows are copies
    points[40:44] = points[30]
    got = neighbours.knn_graph(frame(spark, points), 4, "id", metric="euclidean", block_rows=block).collect()
    expected, gap = brute_knn(points, 4)
    found = {}
    for r in sorted(got, key=lambda r: (r["key"], r["place"])):
        found.setdefault(r["key"], []).append(r["neighbour"])
        assert r["distance"] == pytest.approx(gap[r["key"], r["neighbour"]], abs=1e-6)
    assert [found[i] for i in range(60)] == expected


def test_fewer_rows_than_neighbours(spark):
    got = neighbours.knn_graph(frame(spark, np.eye(3)), 5, "id").groupBy("key").count().collect()
    assert [r["count"] for r in got] == [2, 2, 2]
    with pytest.raises(ValueError):
        neighbours.knn_graph(frame(spark, np.eye(3)), 5, "id", metric="hamming")


def test_projection_equals_singular_vectors(spark):
    points = RNG.randn(40, 6) * np.arange(1, 7) + 5
    rows = project.pca_project(frame(spark, points), 3).orderBy("id").collect()
    z = np.array([r["coords"] for r in rows])
    centred = points - points.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    signs = np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(1)])
    assert np.allclose(z, centred @ (vt[:3] * signs[:, None]).T, atol=1e-8)
    assert np.allclose(z.mean(0), 0, atol=1e-9)


def test_projection_rules(spark):
    df = frame(spark, RNG.randn(6, 4))
    with pytest.raises(ValueError):
        project.pca_project(df, 4)
    with pytest.raises(ValueError):
        project.pca_project(df, 2, "tsne")
    with pytest.warns(RuntimeWarning):
        project.pca_project(df, 2, "umap")
    assert project.pca_project(df.where("false"), 2).count() == 0
    with pytest.warns(RuntimeWarning, match="Too few"):
        assert project.resolve_reducer("umap", 3, 2)["method"] == "pca"
    with pytest.warns(RuntimeWarning):
        assert project.resolve_reducer("umap", 10, 2, 50)["n_neighbors"] == 9
    with pytest.raises(ValueError):
        project.cluster_reduce(df, "pca", 5)
    with pytest.raises(ValueError):
        project.cluster_reduce(df, "pca", 0)


def test_projection_options_follow_the_topic_fit():
    manual = {"n_components": 3}
    assert project.projection_from_topic_options(manual)["random_state"] == 1
    got = project.projection_from_topic_options(manual, True, {"cluster_reduce_method": "umap", "umap_n_neighbors": 7})
    assert (got["umap_n_neighbors"], got["random_state"], got["n_components"]) == (7, 42, 3)
    with pytest.raises(ValueError):
        project.projection_from_topic_options(manual, True)
    with pytest.raises(ValueError):
        project.projection_from_topic_options(manual, True, {"cluster_reduce_method": "tsne"})


def test_clusters_and_noise(spark):
    blobs = np.vstack([RNG.randn(40, 2) * 0.3 + c for c in ((0, 0), (8, 0), (0, 9))] + [RNG.uniform(-30, 30, (6, 2))])
    numbers = density.renumber_topics(density.density_cluster(frame(spark, blobs), "id", min_cluster_size=10))
    got = {r["key"]: r["topic_id"] for r in numbers.collect()}
    for start in (0, 40, 80):
        inside = {got[i] for i in range(start, start + 40)} - {-1}
        assert len(inside) == 1
    assert len({got[0], got[40], got[80]} - {-1}) == 3


def test_row_numbers_equal_one_window(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), hash_order(1, F.col("id")).alias("h"))
    got = number_by_hash(df, "h", ["id"], ["g"], "r")
    expected = df.selectExpr("id", "g", "h", "cast(row_number() over (partition by g order by h, id) as bigint) as r")
    assert got.exceptAll(expected).count() == 0 and got.count() == 500


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_folder(spark) == spark.sparkContext.getCheckpointDir()


def test_encoder_is_called_with_usable_texts_only(spark):
    df = spark.createDataFrame([("a", 1, "ab"), ("a", 2, "  "), ("b", 3, "abcd")], "source_column string, index int, text string")

    def encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    got = embed.embed_text(df, encoder, normalize=False).orderBy("index").collect()
    assert [r["embedding"] for r in got] == [[2.0, 1.0], [4.0, 1.0]]
    unit = embed.embed_text(df, encoder).collect()
    assert all(np.isclose(np.linalg.norm(r["embedding"]), 1) for r in unit)


def test_stored_embeddings_are_reused(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return frame(spark, np.eye(2))

    for _ in range(2):
        assert embed.stored_embeddings(spark, str(tmp_path), {"dim": 2}, build).count() == 2
    assert len(calls) == 1


DOCS = [
    (10, "text_a", "Therapy session focused on sleep and mood regulation.", 0),
    (11, "text_a", "Mood improved after several sessions and less anxiety.", 0),
    (12, "text_b", "Markets rallied after the earnings report.", 1),
    (13, "text_b", "This fragment does not belong to any clear topic.", -1),
    (14, "text_b", "Stock returns were volatile across the quarter.", 1),
]


def test_topic_tables(spark):
    docs = spark.createDataFrame(DOCS, "index int, source_column string, text string, topic_id int")
    best = spark.createDataFrame(
        [(0, 1, "therapy", .5), (0, 2, "mood", .3), (0, 3, "anxiety", .2), (1, 1, "market", .5)],
        "topic_id int, place int, term string, score double")
    labels = topics.topic_labels(docs, best)
    rows = {r["index"]: r for r in topics.topic_assignments(docs, labels).collect()}
    assert rows[10]["topic_label"] == "Topic 0: therapy, mood, anxiety"
    assert rows[13]["topic_label"] == "Outlier / noise" and rows[13]["is_outlier"]
    summary = {r["topic_id"]: r for r in topics.topic_summary(
        topics.topic_assignments(docs, labels), labels, topics.representative_docs(docs)).collect()}
    assert summary[-1]["count"] == 1 and sum(r["share"] for r in summary.values()) == pytest.approx(1)
    assert summary[0]["representative_docs"].count(" || ") == 1
    with pytest.raises(ValueError):
        topics.topic_summary(docs, labels, topics.representative_docs(docs))


def test_own_probability_falls_back_to_the_largest(spark):
    rows = spark.createDataFrame([(1, 0), (2, 9), (3, -1)], "key int, topic_id int")
    chances = spark.createDataFrame(
        [(1, 0, .8), (1, 1, .2), (2, 0, .1), (2, 1, .9), (3, 0, .6), (3, 1, .4)], "key int, topic_id int, p double")
    got = {r["key"]: r["topic_probability"] for r in topics.own_probability(rows, chances).collect()}
    assert got == {1: .8, 2: .9, 3: None}


def test_topic_choice_and_plot_rules(spark):
    sizes = spark.createDataFrame([(0, 12), (1, 9), (2, 4), (-1, 2)], "topic_id int, count int")
    assert [r["topic_id"] for r in topics.select_topics(sizes, top_n=2).orderBy("place").collect()] == [0, 1]
    for wrong in ({"topics": [1], "top_n": 1}, {"top_n": 0}, {"topics": []}):
        with pytest.raises(ValueError):
            topics.select_topics(sizes, **wrong)
    check = topicplots.validate_plot_request
    assert check("barchart", n_words=5) == {"n_words": 5}
    for kind, options in (("pie", {}), ("heatmap", {"n_words": 2}), ("documents", {}), ("barchart", {"n_words": 0}),
                          ("documents", {"docs": ["a"], "sample": 0.0}), ("hierarchy", {"orientation": "up"})):
        with pytest.raises(ValueError):
            check(kind, **options)
    with pytest.raises(ValueError):
        topics.TermOptions(ngram_range=(1,))


def test_topic_input_rules(spark):
    good = spark.createDataFrame([("a b", [1.0, 2.0])], "text string, embedding array<double>")
    assert topics.validate_topic_input(good) == 1
    for rows in ([("  ", [1.0])], [("a", [1.0]), ("b", [1.0, 2.0])], []):
        with pytest.raises(ValueError):
            topics.validate_topic_input(spark.createDataFrame(rows, "text string, embedding array<double>"))


def test_hierarchy_equals_wards_rule(spark):
    points = RNG.randn(6, 4)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    similar = unit @ unit.T
    table = spark.createDataFrame(
        [(i, j, float(similar[i, j])) for i in range(6) for j in range(6)], "topic_a int, topic_b int, similarity double")
    got = topicplots.hierarchy_data(table).orderBy("step").collect()
    d2 = {(i, j): max(1 - similar[i, j], 0) ** 2 for i in range(6) for j in range(6) if i != j}
    size = dict.fromkeys(range(6), 1)
    for row in got:
        i, j = min(((a, b) for a, b in d2 if a < b), key=lambda p: d2[p])
        best = d2[i, j]
        assert (row["topic_a"], row["topic_b"]) == (i, j) and row["distance"] == pytest.approx(best ** 0.5)
        for k in [k for k in size if k not in (i, j)]:
            joined = ((size[k] + size[i]) * d2[k, i] + (size[k] + size[j]) * d2[k, j] - size[k] * best) / (
                size[k] + size[i] + size[j])
            d2[k, i] = d2[i, k] = joined
        size[i] += size.pop(j)
        d2 = {p: v for p, v in d2.items() if j not in p}
    assert len(got) == 5
    clusters = topicplots.heatmap_clusters(topicplots.hierarchy_data(table), list(range(6)), 3)
    assert set(clusters.values()) == {0, 1, 2}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_intertopic_map_places(spark, n):
    shown = spark.createDataFrame([(i, 10 - i, i + 1) for i in range(n)], "topic_id int, count int, place int")
    centers = spark.createDataFrame([(i, [float(v) for v in np.eye(3)[i]]) for i in range(n)], "topic_id int, centroid array<double>")
    best = spark.createDataFrame([(0, 1, "a", 1.0)], "topic_id int, place int, term string, score double")
    rows = topicplots.intertopic_map_data(shown, centers, best).orderBy("topic_id").collect()
    if n == 1:
        assert (rows[0]["x"], rows[0]["y"], rows[0]["marker_size"]) == (0.0, 0.0, 36.0)
    elif n == 2:
        assert [r["x"] for r in rows] == [-1.0, 1.0] and [r["marker_size"] for r in rows] == [66.0, 30.0]
    else:
        assert abs(sum(r["x"] for r in rows)) < 1e-9


def test_small_topic_fit_runs_end_to_end(spark):
    vectors = [(1, 0, 0, 0), (.95, .05, 0, 0), (0, 1, 0, 0), (.05, .95, 0, 0), (0, 0, 1, 0), (0, 0, .95, .05)]
    df = spark.createDataFrame(
        [("t", i, f"text number {i}", [float(x) for x in v]) for i, v in enumerate(vectors)],
        "source_column string, index int, text string, embedding array<double>")
    fitted = topics.fit_topics(df, "pca", 2, min_cluster_size=2, min_samples=1)
    groups = {r["index"]: r["topic_id"] for r in fitted.collect()}
    assert len(groups) == 6 and groups[0] == groups[1] and groups[2] == groups[3] and groups[4] == groups[5]


def test_topics_are_joined_without_dealing_rows_by_topic(spark):
    docs = spark.createDataFrame(
        [("s", i, f"alpha{i % 3} beta word{i}", i % 3) for i in range(30)],
        "source_column string, index bigint, text string, topic_id int")
    scores = topics.ctfidf(topics.topic_terms_count(docs, topics.TermOptions(max_df=None, min_df=1)))
    labels = topics.topic_labels(docs, topics.top_terms(scores, 3))
    for made in (scores, topics.topic_assignments(docs, labels)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r["topic_id"], r["n"]) for r in topics.topic_assignments(docs, labels).groupBy("topic_label", "topic_id")
                  .agg(F.count(F.lit(1)).alias("n")).collect()) == [(0, 10), (1, 10), (2, 10)]
