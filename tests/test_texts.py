import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexistat.functions.text import wrap_hover_text
from lexistat.operators import corpus, stack, summary, textstats
from lexistat.operators.report import config_table, embed_config_table
from lexistat.sources import tables
from lexistat.streaming import rowstats

GOLDEN = [
    ("note", 0, "Hello world. Hello again!"), ("note", 1, "Calm minds focus."),
    ("essay", 5, "Markets move quickly."),
]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(GOLDEN, "source_column string, index bigint, text string")


def test_row_statistics(golden):
    rows = {(r["source_column"], r["index"]): r for r in textstats.text_row_stats(golden).collect()}
    first = rows["note", 0]
    assert (first["word_count"], first["sentence_count"], first["unique_words"]) == (4, 2, 3)
    assert first["lexical_diversity"] == 0.75 and first["noun_count"] == 0
    assert first["pos_full"] == {"": 4}
    assert rows["essay", 5]["word_count"] == 3


def test_corpus_statistics(golden):
    options = textstats.StatsOptions(split_overall="both")
    rows = {r["corpus"]: r for r in corpus.descriptive_stats(golden, options)[1].collect()}
    assert (rows["Combined"]["total_words"], rows["Combined"]["total_sentences"]) == (10, 4)
    assert rows["Combined"]["total_unique_words"] == 9 and rows["Combined"]["nouns"] == 0
    assert (rows["note"]["total_words"], rows["essay"]["total_words"]) == (7, 3)


def test_unknown_split_means_combined(golden):
    options = textstats.StatsOptions(split_overall="whatever")
    assert [r["corpus"] for r in corpus.descriptive_stats(golden, options)[1].collect()] == ["Combined"]


def test_lexicon_gives_tags_lemmas_and_stop_words(spark, golden):
    words = spark.createDataFrame(
        [("hello", "hello", "INTJ", True), ("world", "world", "NOUN", False), ("minds", "mind", "NOUN", False),
         ("focus", "focus", "VERB", False), ("calm", "calm", "ADJ", False), ("quickly", "quickly", "ADV", False)],
        "token string, lemma string, pos string, is_stop boolean")
    rows = {(r["source_column"], r["index"]): r for r in textstats.text_row_stats(golden, lexicon=words).collect()}
    note = rows["note", 1]
    assert (note["noun_count"], note["verb_count"], note["adjective_count"], note["adverb_count"]) == (1, 1, 1, 0)
    assert note["pos_full"] == {"ADJ": 1, "NOUN": 1, "VERB": 1}
    kept = textstats.text_row_stats(golden, textstats.StatsOptions(drop_stopwords=True), words)
    assert {r["index"]: r["word_count"] for r in kept.collect()} == {0: 2, 1: 3, 5: 3}


def test_stacking_drops_null_and_blank_cells(spark):
    df = spark.createDataFrame(
        [(10, "Alpha text", None), (11, "   ", None), (12, None, None), (13, " \n", None),
         (14, "Beta text", None), (20, None, "Gamma text")], "id int, note string, essay string")
    rows = stack.stack_text(df, "id", ["note", "essay"]).orderBy("index").collect()
    assert [(r["index"], r["source_column"]) for r in rows] == [(10, "note"), (14, "note"), (20, "essay")]
    with pytest.raises(ValueError):
        stack.stack_text(df, "id", ["id"])


def test_no_usable_text_gives_empty_results(spark):
    blank = spark.createDataFrame([("a", 1, "  ")], "source_column string, index int, text string")
    texts = blank.where("false")
    stats, overall = corpus.descriptive_stats(texts)
    assert stats.count() == 0 and overall.count() == 0
    assert "word_count" in stats.columns
    assert summary.descriptive_summary_table(stats, overall).count() == 0


ROWS = [
    ("note", 0, 50, 10, 2, 4.0, 5.0, 5, 0.5, 3, 2, 1, 0),
    ("note", 1, 70, 14, 4, 5.0, 3.5, 6, 6 / 14, 4, 3, 1, 1),
]
SCHEMA = ("source_column string, index bigint, char_count bigint, word_count bigint, sentence_count bigint, "
          "avg_word_length double, avg_sentence_length double, unique_words bigint, lexical_diversity double, "
          "noun_count bigint, verb_count bigint, adjective_count bigint, adverb_count bigint")


def test_summary_of_one_source_has_one_row_with_deviations(spark):
    stats = spark.createDataFrame(ROWS, SCHEMA)
    overall = spark.createDataFrame(
        [("Combined", 120, 24, 6, 4.5, 4.0, 9, 0.375), ("note", 120, 24, 6, 4.5, 4.0, 9, 0.375)],
        "corpus string, total_chars bigint, total_words bigint, total_sentences bigint, avg_word_length double, "
        "avg_sentence_length double, total_unique_words bigint, lexical_diversity double")
    table = summary.descriptive_summary_table(stats, overall)
    rows = table.collect()
    assert len(rows) == 1 and rows[0]["N Texts"] == 2
    expected = {"Mean Characters / Text": 60, "SD Characters / Text": 14.142, "SD Words / Text": 2.828,
                "SD Sentences / Text": 1.414, "SD Unique Words / Text": 0.707, "Lexical Diversity (TTR)": 0.375,
                "Mean Lexical Diversity (TTR) / Text": 0.464, "SD Lexical Diversity (TTR) / Text": 0.051}
    for name, value in expected.items():
        assert rows[0][name] == pytest.approx(value, abs=1e-3), name
    groups = [r["metric_group"] for r in summary.summary_vertical(table).orderBy("metric_rank").collect()]
    assert list(dict.fromkeys(groups)) == ["Corpus Size", "Per-Text Counts", "Lexical Richness", "Length Metrics"]


def test_latex_of_two_sources(spark):
    two = spark.createDataFrame([("essay_1", 2, 24), ("note", 1, 11)], "Corpus string, `N Texts` bigint, `Total Words` bigint")
    lines = [r["line"] for r in summary.summary_latex_lines(two).orderBy("ord").collect()]
    assert r"essay\_1 & Total Words & 24 \\" in lines
    assert lines[0] == r"\begin{tabular}{lll}" and lines[-1] == r"\end{tabular}"
    assert lines.count(r"\hline") == 4
    text = spark.range(1).select(summary.escape_latex(F.lit("\\{a}^~#")).alias("x")).first()["x"]
    assert text == r"\textbackslash{}\{a\}\textasciicircum{}\textasciitilde{}\#"


def test_hover_text_wraps_and_keeps_every_word(spark):
    text = "word " * 40 + "x" * 150
    out = spark.createDataFrame([(text,)], "t string").select(wrap_hover_text(F.col("t"))).first()[0]
    assert all(len(line) <= 70 for line in out.split("<br>"))
    assert out.replace("<br>", "").replace(" ", "") == text.replace(" ", "")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab .!?'\n9é", max_size=40), min_size=1, max_size=12))
def test_row_statistics_stay_in_bounds(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    stacked = stack.stack_text(df, "id", ["text"])
    rows = textstats.text_row_stats(stacked).collect()
    assert len(rows) == sum(1 for t in texts if t.strip())
    for r in rows:
        assert 0 <= r["lexical_diversity"] <= 1 and r["unique_words"] <= r["word_count"]
        assert r["sentence_count"] >= 1


def test_tables_round_trip(spark, golden, tmp_path):
    stats = textstats.text_row_stats(golden)
    tables.write_table(stats, str(tmp_path / "stats.csv"), "csv")
    back = tables.load_table(spark, str(tmp_path / "stats.csv"))
    assert back.count() == 3 and '{"":4}' in [r["pos_full"] for r in back.collect()]
    tables.write_table(golden, str(tmp_path / "texts.tsv"), "tsv")
    assert tables.load_table(spark, str(tmp_path / "texts.tsv")).columns == ["source_column", "index", "text"]
    tables.write_table(stats, str(tmp_path / "stats.parquet"))
    assert tables.load_table(spark, str(tmp_path / "stats.parquet")).count() == 3
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "ord int, line string")
    tables.write_text_lines(lines, str(tmp_path / "lines"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        tables.write_table(stats, str(tmp_path / "x"), "xlsx")


def test_target_and_color_choices(spark, golden):
    df = spark.createDataFrame([("t", 1, 2.0, "x")], "text string, Target_a int, score double, lang string")
    assert tables.target_columns(df, ["text"]) == (["Target_a", "score", "lang"], ["Target_a"])
    options = stack.color_options(df, ["text"], textstats.text_row_stats(golden), True)
    assert ("source_column", "categorical") in options and ("topic_id", "continuous") in options
    assert ("Stats: word_count", "continuous") in options and ("lang", "categorical") in options


def test_display_leaves_out_empty_columns(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "a int, p_fdr double, p_value double")
    assert stack.drop_all_null_columns(df, ["p_fdr", "p_value"]).columns == ["a", "p_value"]


def test_merging_topics_needs_equal_rows(spark, golden):
    topics = golden.selectExpr("*", "0 as topic_id", "'T' as topic_label", "1.0 as topic_probability", "false as is_outlier")
    assert stack.merge_topic_assignments(golden, topics).count() == 3
    with pytest.raises(ValueError):
        stack.merge_topic_assignments(golden, topics.where("index <> 1"))
    with pytest.raises(ValueError):
        stack.merge_topic_assignments(golden, topics.drop("is_outlier"))


def test_repeated_keys_are_refused(spark, golden):
    stack.require_unique(golden, ["source_column", "index"])
    with pytest.raises(ValueError):
        stack.require_unique(golden.union(golden), ["source_column", "index"])


def test_settings_tables(spark):
    config = {"reduce_method": "pca", "umap_metric": "cosine", "tsne_metric": "cosine", "n": 2, "empty": [], "off": None}
    assert [(r[0], r[1]) for r in config_table(spark, config, ["n"]).collect()] == [
        ("reduce_method", "pca"), ("tsne_metric", "cosine"), ("umap_metric", "cosine")]
    assert [r[0] for r in embed_config_table(spark, config).collect()] == ["n", "reduce_method"]


def test_row_statistics_on_a_stream(spark, golden, tmp_path):
    golden.write.parquet(str(tmp_path / "in"))
    texts = rowstats.read_texts(spark, str(tmp_path / "in"), golden.schema, "index", "text", "source_column")
    query = rowstats.write_row_stats(texts, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    batch = textstats.text_row_stats(golden)
    assert spark.read.parquet(str(tmp_path / "out")).drop("pos_full").exceptAll(batch.drop("pos_full")).count() == 0


def test_plain_row_statistics_do_not_shuffle(golden):
    plan = textstats.text_row_stats(golden)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
