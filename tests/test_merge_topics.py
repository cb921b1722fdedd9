"""Topic columns on the rows of a projection."""

import pytest
from pyspark.sql import functions as F

from lexistat.operators import stack
from lexistat.plans.catalog import QUERIES

ROWS = [
    (1, "some words", "en", "src3"), (2, None, "en", "src19"), (3, "  ", "de", "src0"), (4, "more", None, "src3"),
    (5, "", None, None), (6, "words", "fr", "src7"),
]


def test_every_document_gets_its_topic(spark, tmp_path):
    rows = [(i, text, lang, source, len(text or "")) for i, text, lang, source in ROWS]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        str(tmp_path / "documents.parquet"))
    found = {r["index"]: tuple(r) for r in QUERIES["merge_topic_assignments"](spark, str(tmp_path)).collect()}
    assert found == {
        1: ("en", 1, 10.0, 3, "Topic 3", False), 2: ("en", 2, None, -1, "Topic -1", True),
        3: ("de", 3, 2.0, 0, "Topic 0", False), 4: (None, 4, 4.0, 3, "Topic 3", False),
        5: (None, 5, 0.0, None, None, None), 6: ("fr", 6, 5.0, 7, "Topic 7", False),
    }


def test_rows_without_a_key_meet_each_other(spark):
    plot = spark.createDataFrame([("a", 1, "x", 0.5), (None, 2, "y", 1.5), ("b", None, None, 2.5)],
                                 "source_column string, index bigint, text string, dim_1 double")
    topics = plot.selectExpr("source_column", "index", "text", "3 AS topic_id", "'T' AS topic_label",
                             "1.0 AS topic_probability", "false AS is_outlier")
    assert stack.alignment_errors(plot, topics).count() == 0
    merged = stack.merge_topic_assignments(plot, topics)
    assert merged.columns == [*plot.columns, *stack.TOPIC_COLUMNS]
    assert sorted(r["dim_1"] for r in merged.collect()) == [0.5, 1.5, 2.5]
    wrong = stack.alignment_errors(plot, topics.where("index = 1")).collect()
    assert sorted(str(r["index"]) + r["problem"] for r in wrong) == ["2missing in assignments", "Nonemissing in assignments"]


def test_repeated_keys_meet_by_their_texts(spark):
    plot = spark.createDataFrame([("a", 1, "x", 0.5), ("a", 1, "y", 1.5), (None, None, "z", 2.5), (None, None, None, 3.5)],
                                 "source_column string, index bigint, text string, dim_1 double")
    topics = plot.selectExpr("source_column", "index", "text", "cast(dim_1 AS int) AS topic_id", "'T' AS topic_label",
                             "1.0 AS topic_probability", "false AS is_outlier")
    merged = stack.merge_topic_assignments(plot, topics)
    assert sorted((r["dim_1"], r["topic_id"]) for r in merged.collect()) == [(0.5, 0), (1.5, 1), (2.5, 2), (3.5, 3)]
    with pytest.raises(ValueError):
        stack.merge_topic_assignments(plot, topics.withColumn("text", F.lit("x")))
