"""Similarities of topics."""

import re

import numpy as np

from lexistat.operators.topicplots import heatmap_data

WEIGHTS = [(0, "a", 3.0), (0, "b", 4.0), (1, "a", 1.0), (1, "c", 2.0), (1, "c", 2.0), (2, "d", 0.0), (3, None, 5.0), (3, "b", 1.0)]


def weights(spark, rows=WEIGHTS):
    return spark.createDataFrame(rows, "topic_id int, feature string, weight double")


def test_weights_dealt_by_feature_are_not_dealt_again(spark):
    found = heatmap_data(weights(spark).repartition(4, "feature"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(feature#", plan)) == 1  # the given one
    assert not re.findall(r"Exchange hashpartitioning\(topic_id#\d+, \d+\)", plan)


def test_similarities_are_cosines_of_all_pairs(spark):
    norm = [5.0, 3.0, 0.0, np.sqrt(26.0)]
    got = {(r["topic_a"], r["topic_b"]): r["similarity"] for r in heatmap_data(weights(spark)).collect()}
    assert len(got) == 16 and heatmap_data(weights(spark)).count() == 16
    expected = {(0, 0): 1.0, (0, 1): 3.0 / 5 / norm[1], (0, 3): 4.0 / 5 / norm[3], (1, 1): (1 + 16) / norm[1] ** 2, (3, 3): 1 / 26}
    for a in range(4):
        for b in range(4):
            assert np.isclose(got[a, b], expected.get((min(a, b), max(a, b)), 0.0)), (a, b)
    shown = weights(spark).where("topic_id < 2").select("topic_id")
    assert sorted((r[0], r[1]) for r in heatmap_data(weights(spark), shown).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert heatmap_data(weights(spark, [])).count() == 0
