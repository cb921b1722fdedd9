"""Inputs that the given tables do not hold: far points, doubled entries, zero vectors, topics apart."""

from __future__ import annotations

import numpy as np
import pytest
from lexistat.operators import density, embed, inference, neighbours, preprocess, topicplots, topics
from lexistat.operators.textstats import text_row_stats
from lexistat.sources import tables
from pyspark.sql import functions as F

VECTORS = "index bigint, source_column string, text string, topic_id int, embedding array<double>"


@pytest.mark.parametrize("far", [1e3, 1e6])
def test_a_far_point_leaves_the_clusters_alone(spark, far):
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(size=(60, 2)) * 0.3 + c for c in ((0, 0), (8, 0), (0, 9), (9, 9))] + [[[far, far]]])
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id bigint, embedding array<double>")
    found = {r["key"]: r["topic_id"] for r in density.renumber_topics(density.density_cluster(rows, "id")).collect()}
    assert found[240] == -1
    groups = [[found[i] for i in range(k, k + 60)] for k in range(0, 240, 60)]
    main = [max(set(g), key=g.count) for g in groups]
    assert sorted(main) == [0, 1, 2, 3]
    assert sum(x == -1 for g in groups for x in g) <= 24


def test_a_doubled_lexicon_entry_counts_once(spark):
    texts = spark.createDataFrame([("c", 0, "Run run fast")], "source_column string, index bigint, text string")
    lexicon = spark.createDataFrame(
        [("Run", "run", "VERB", False), ("run", "run", "NOUN", False), ("run", "run", "VERB", False), ("fast", "fast", "ADV", False)],
        "token string, lemma string, pos string, is_stop boolean")
    row = text_row_stats(texts, lexicon=lexicon).first()
    assert (row["word_count"], row["noun_count"], row["verb_count"], row["adverb_count"]) == (3, 2, 0, 1)


def test_zero_vectors_come_last(spark):
    rows = [(0, "c", "zero", 0, [0.0, 0.0]), (1, "c", "near", 0, [1.0, 0.0]), (2, "c", "off", 0, [0.0, 1.0])]
    docs = spark.createDataFrame(rows, VECTORS)
    centre = spark.createDataFrame([(0, [1.0, 0.1])], "topic_id int, centroid array<double>")
    assert topics.representative_docs(docs, centre).first()["representative_docs"] == "near || off || zero"


def test_topics_apart_have_similarity_zero(spark):
    weights = spark.createDataFrame(
        [(0, "a", 1.0), (0, "b", 1.0), (1, "b", 2.0), (2, "c", 1.0), (3, "d", 0.0)], "topic_id int, feature string, weight double")
    table = {(r[0], r[1]): r[2] for r in topicplots.heatmap_data(weights).collect()}
    assert len(table) == 16 and table[0, 2] == table[2, 0] == table[3, 3] == 0.0
    assert table[0, 1] == table[1, 0] == pytest.approx(0.5 ** 0.5)
    merges = topicplots.hierarchy_data(topicplots.heatmap_data(weights))
    assert merges.count() == 3
    some = spark.createDataFrame([(0,), (2,)], "topic_id int")
    assert topicplots.heatmap_data(weights, some).count() == 4
    with pytest.raises(ValueError, match="missing"):
        topicplots.hierarchy_data(topicplots.heatmap_data(weights).where("topic_a + topic_b <> 2"))


def test_one_class_in_training_has_no_f(spark):
    rows = [(f, p, c, float(f + c)) for f in (0, 1) for p in (0, 1) for c in (f, f)]
    long = spark.createDataFrame(rows, "fold int, pos int, y int, x double")
    assert {r["f"] for r in preprocess.f_class_scores(long, "y").collect()} == {None}


def test_vectors_are_stored_for_equal_texts_only(spark, tmp_path):
    calls = []

    def texts(word):
        return spark.createDataFrame([("c", 0, word), ("c", 1, "b")], "source_column string, index bigint, text string")

    def get(word):
        made = texts(word)

        def build():
            calls.append(word)
            return made.select("index", F.array(F.length("text").cast("double")).alias("embedding"))

        return sorted(r["embedding"] for r in embed.stored_embeddings(spark, str(tmp_path), {"dim": 1}, build, made).collect())

    assert get("a") == get("a") and get("long") == [[1.0], [4.0]] and calls == ["a", "long"]
    for mark in tmp_path.glob("*/_SUCCESS"):  # as after a write that broke off
        mark.rename(mark.with_name("_half"))
    get("a")
    assert calls == ["a", "long", "a"]


def test_harmonic_numbers(spark):
    rows = spark.createDataFrame([(1,), (1000,), (1001,), (50_000,)], "m bigint")
    found = [r[0] for r in rows.orderBy("m").select(inference._harmonic(F.col("m"))).collect()]
    assert found == pytest.approx([sum(1 / k for k in range(1, m + 1)) for m in (1, 1000, 1001, 50_000)], rel=1e-14)


def test_mixed_vectors_are_not_spread(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id bigint, v array<double>")
    with pytest.raises(ValueError):
        tables.embeddings_wide(rows, ["id"], "v")
    assert tables.embeddings_wide(rows.where("id = 2"), ["id"], "v").columns == ["id", "e1", "e2"]


def test_approximate_neighbours_find_nine_in_ten(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    pairs = [{(r["key"], r["neighbour"]) for r in neighbours.knn_graph(rows, 5, "vec_id", method=m).collect()}
             for m in ("exact", "approximate")]
    assert len(pairs[0] & pairs[1]) >= 0.9 * len(pairs[0])
    with pytest.raises(ValueError):
        neighbours.knn_graph(rows, 5, "vec_id", method="guess")
