"""The registered queries: one per operator, each over its whole input tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexistat.functions.session import checkpoint_folder
from lexistat.functions.text import (
    keep_words,
    ratio_or_zero,
    split_sentences,
    tokenize,
    total_length,
    wrap_hover_text,
)
from lexistat.operators import (
    corpus,
    density,
    embed,
    folds,
    inference,
    metrics,
    modeling,
    neighbours,
    preprocess,
    project,
    report,
    stack,
    summary,
    textstats,
    topicplots,
    topics,
)
from lexistat.plans.inputs import (
    STOP_OPTIONS,
    STOP_WORDS,
    conversation_columns,
    conversation_texts,
    document_texts,
    embedded_texts,
    event_tests,
    folded_features,
    labelled_documents,
    lexicon,
    r6,
    rounded_doubles,
    table,
    topic_texts,
    vector_features,
)
from lexistat.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# ---- tables ----------------------------------------------------------------------------------


@query
def preview(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return tables.preview(docs, ["doc_id"], 5)


@query
def dataset_overview(spark, sf):
    return tables.dataset_overview(conversation_columns(spark, sf), ["user", "assistant", "system"])


@query
def candidate_text_columns(spark, sf):
    return tables.candidate_text_columns(table(spark, sf, "documents"))


@query
def embeddings_wide(spark, sf):
    wide = tables.embeddings_wide(table(spark, sf, "embeddings"), ["vec_id", "label"], "embedding")
    return rounded_doubles(wide)


@query
def table_round_trip(spark, sf):
    """All turns written as comma-separated text, with quotes and line ends inside, and loaded again."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/turns-{uuid.uuid4().hex}.csv"
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    tables.write_table(turns, path, "csv")
    return tables.load_table(spark, path, turns.schema)


@query
def shown_columns(spark, sf):
    """Adjusted p-values are left out of the display where no test has one."""
    tests = event_tests(spark, sf).withColumn("p_fdr", F.lit(None).cast("double"))
    return rounded_doubles(stack.drop_all_null_columns(tests, ["p_fdr", "p_value"]))


# ---- stacking and joining --------------------------------------------------------------------


@query
def stack_text(spark, sf):
    return conversation_texts(spark, sf)


@query
def align_features_targets(spark, sf):
    y = labelled_documents(spark, sf)
    aligned = stack.align_features_targets(
        vector_features(spark, sf), y, "doc_id", "quality", y.where("source <> 'src3'"), "source"
    )
    return aligned.select("doc_id", "quality", "source", r6(F.col("embedding")[0]).alias("first"))


def _events_as_stats(spark, sf):
    """A statistics table in which keys repeat: one row per event, keyed by type and user."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("source_column"), F.col("user_id").alias("index"), "value", "event_id"
    )


@query
def attach_stat(spark, sf):
    stats = _events_as_stats(spark, sf)
    plot = stats.where("value IS NOT NULL").select("source_column", "index").distinct()
    return rounded_doubles(stack.attach_stat(plot, stats, "value", "mean_value"))


@query
def attach_column(spark, sf):
    events = table(spark, sf, "events")
    plot = events.select(F.col("user_id").alias("index")).distinct()
    return stack.attach_column(plot, events, "user_id", "event_type", "event_id")


@query
def resolve_color_mode(spark, sf):
    """Numbers inside text are read where they parse; a column without any stays categorical."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(
            F.substring("source", 4, 8)).alias("mixed"),
    )
    mixed = stack.resolve_color_mode(docs, "mixed", "Continuous").withColumn("asked", F.lit("mixed"))
    lang = stack.resolve_color_mode(docs, "lang", "Continuous").withColumn("asked", F.lit("lang"))
    both = mixed.unionByName(lang)
    return both.select("doc_id", "asked", "color_number", "color_label", "color_mode")


def _assignments(spark, sf):
    texts = topic_texts(spark, sf)
    labels = texts.select("topic_id").distinct().withColumn(
        "topic_label", F.concat(F.lit("Topic "), F.col("topic_id").cast("string")))
    return topics.topic_assignments(texts, labels)


@query
def merge_topic_assignments(spark, sf):
    # Every document has an assignment, also one without a usable text or a language.
    plot = topic_texts(spark, sf).select("source_column", "index", "text").withColumn("dim_1", F.length("text").cast("double"))
    merged = stack.merge_topic_assignments(plot, _assignments(spark, sf))
    return merged.select("source_column", "index", "dim_1", "topic_id", "topic_label", "is_outlier")


@query
def alignment_errors(spark, sf):
    plot = document_texts(spark, sf).where("index % 7 <> 0")
    changed = _assignments(spark, sf).where("index % 5 <> 0").withColumn(
        "text", F.when(F.col("index") % 11 == 0, F.upper("text")).otherwise(F.col("text")))
    return stack.alignment_errors(plot, changed)


@query
def hover_text(spark, sf):
    return document_texts(spark, sf).select("index", wrap_hover_text(F.col("text")).alias("hover"))


@query
def union_results(spark, sf):
    stats = textstats.text_row_stats(document_texts(spark, sf))
    return stack.union_results([
        stats.select("index", "word_count", F.lit("documents").alias("part")),
        table(spark, sf, "labels").select(F.col("doc_id").alias("index"), "quality", F.lit("labels").alias("part")),
    ])


# ---- words and sentences ---------------------------------------------------------------------


@query
def token_lists(spark, sf):
    tokens = tokenize(F.col("text"))
    return document_texts(spark, sf).select(
        "source_column", "index", F.size(tokens).cast("bigint").alias("tokens"),
        F.array_join(tokens, " ").alias("line"))


@query
def kept_words(spark, sf):
    tokens = tokenize(F.col("text"))
    counts = {
        "all_tokens": tokens,
        "alpha": keep_words(tokens),
        "alpha_no_stop": keep_words(tokens, True, STOP_WORDS),
        "no_stop": keep_words(tokens, False, STOP_WORDS),
    }
    return document_texts(spark, sf).select(
        "source_column", "index", *[F.size(v).cast("bigint").alias(k) for k, v in counts.items()])


@query
def sentence_lists(spark, sf):
    sentences = split_sentences(F.col("text"))
    return document_texts(spark, sf).select(
        "source_column", "index", F.size(sentences).cast("bigint").alias("sentences"),
        F.length(F.element_at(sentences, 1)).cast("bigint").alias("first_length"),
        F.length(F.element_at(sentences, -1)).cast("bigint").alias("last_length"))


@query
def word_lengths(spark, sf):
    words = textstats.text_words(document_texts(spark, sf))
    chars = total_length(F.col("words"))
    return words.select("source_column", "index", chars.alias("word_chars"),
                        r6(ratio_or_zero(chars, F.size("words"))).alias("avg_word_length"))


@query
def text_row_stats(spark, sf):
    return rounded_doubles(textstats.text_row_stats(document_texts(spark, sf)).drop("pos_full"))


@query
def text_row_stats_without_stop_words(spark, sf):
    return rounded_doubles(textstats.text_row_stats(document_texts(spark, sf), STOP_OPTIONS).drop("pos_full"))


@query
def annotated_tokens(spark, sf):
    tokens = textstats.token_rows(conversation_texts(spark, sf))
    marked = textstats.annotate_tokens(tokens, lexicon(spark, sf))
    return marked.select("source_column", "index", "pos", "token", "lemma", "tag", "is_stop")


@query
def tag_counts(spark, sf):
    stats = textstats.text_row_stats(conversation_texts(spark, sf), lexicon=lexicon(spark, sf))
    return rounded_doubles(stats.drop("pos_full"))


@query
def tag_maps(spark, sf):
    stats = textstats.text_row_stats(conversation_texts(spark, sf), lexicon=lexicon(spark, sf))
    return stats.select("source_column", "index", F.explode("pos_full").alias("tag", "n"))


# ---- corpora ---------------------------------------------------------------------------------


@query
def corpus_totals(spark, sf):
    return corpus.corpus_totals(textstats.text_row_stats(document_texts(spark, sf)))


@query
def vocabulary_size(spark, sf):
    return corpus.vocab_size(corpus.vocabulary_rows(document_texts(spark, sf)))


@query
def corpus_averages(spark, sf):
    stats = textstats.text_row_stats(document_texts(spark, sf))
    parts = [corpus.corpus_averages(stats, "both", m).withColumn("mode", F.lit(m)) for m in ("unweighted", "ratio")]
    return rounded_doubles(stack.union_results(parts))


@query
def tag_distribution(spark, sf):
    stats = textstats.text_row_stats(conversation_texts(spark, sf), lexicon=lexicon(spark, sf))
    return corpus.pos_distribution(stats)


def _document_overall(spark, sf, split="both", mode="unweighted"):
    options = textstats.StatsOptions(split_overall=split, avg_sentence_mode=mode)
    return corpus.descriptive_stats(document_texts(spark, sf), options)


@query
def corpus_overall(spark, sf):
    return rounded_doubles(_document_overall(spark, sf)[1].drop("pos_full"))


@query
def corpus_overall_combined(spark, sf):
    return rounded_doubles(_document_overall(spark, sf, "combined", "ratio")[1].drop("pos_full"))


@query
def corpus_overall_per_column(spark, sf):
    return rounded_doubles(_document_overall(spark, sf, "per_column")[1].drop("pos_full"))


@query
def descriptive_summary(spark, sf):
    return summary.descriptive_summary_table(*_document_overall(spark, sf))


@query
def summary_from_rows_only(spark, sf):
    """Without corpus statistics, totals and means are those of the rows."""
    stats = textstats.text_row_stats(document_texts(spark, sf))
    return summary.descriptive_summary_table(stats)


@query
def summary_vertical(spark, sf):
    return summary.summary_vertical(summary.descriptive_summary_table(*_document_overall(spark, sf)))


@query
def summary_markdown(spark, sf):
    return summary.summary_markdown_lines(summary.descriptive_summary_table(*_document_overall(spark, sf)))


@query
def summary_latex(spark, sf):
    return summary.summary_latex_lines(summary.descriptive_summary_table(*_document_overall(spark, sf)))


# ---- vectors ---------------------------------------------------------------------------------


@query
def hashing_embedding(spark, sf):
    return embed.hashing_embedding(document_texts(spark, sf), 64, 42)


@query
def embedded_documents(spark, sf):
    """Hashed vectors of unit length, summed up per document."""
    vectors = embed.embed_text(document_texts(spark, sf), dim=64)
    return vectors.select("source_column", "index", F.posexplode_outer("embedding").alias("bucket", "value")).where(
        "value <> 0").select("source_column", "index", "bucket", r6("value").alias("value"))


@query
def join_embeddings(spark, sf):
    joined = embed.join_embeddings(document_texts(spark, sf), table(spark, sf, "embeddings"), "vec_id", "embedding")
    return joined.select("source_column", "index", F.size("embedding").cast("bigint").alias("dim"),
                         r6(F.element_at("embedding", 64)).alias("last"))


@query
def l2_normalize(spark, sf):
    """Vectors of lengths 1 to 5, brought back to unit length."""
    stretch = (F.col("vec_id") % 5 + 1).cast("double")
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * stretch).alias("v"))
    unit = rows.select("vec_id", F.posexplode(embed.l2_normalize(F.col("v"))).alias("pos", "value"))
    return unit.select("vec_id", "pos", r6("value").alias("value"))


def _conversation_vectors(spark, sf):
    return embed.embed_text(conversation_texts(spark, sf), dim=32, normalize=False)


@query
def mean_pool_by_row(spark, sf):
    pooled = embed.mean_pool_by_row(_conversation_vectors(spark, sf))
    return pooled.select("index", F.posexplode_outer("embedding").alias("bucket", "value")).where(
        "abs(value) > 1e-9").select("index", "bucket", r6("value").alias("value"))


@query
def select_feature_set(spark, sf):
    chosen = embed.select_feature_set(_conversation_vectors(spark, sf), "assistant")
    return chosen.select("index", F.posexplode_outer("embedding").alias("bucket", "value")).where("value <> 0")


@query
def projection_2d(spark, sf):
    projected = project.pca_project(embedded_texts(spark, sf), 2, "umap")
    return rounded_doubles(project.projection_table(projected, 2))


@query
def projection_3d(spark, sf):
    projected = project.pca_project(embedded_texts(spark, sf), 3)
    return rounded_doubles(project.projection_table(projected, 3))


def _knn(metric):
    def build(spark, sf):
        vectors = table(spark, sf, "embeddings")
        return rounded_doubles(neighbours.knn_graph(vectors, 5, "vec_id", "embedding", metric))

    build.__name__ = f"knn_{metric}"
    return build


for _metric in neighbours.METRICS:
    query(_knn(_metric))


@query
def knn_cosine_approximate(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return rounded_doubles(neighbours.knn_graph(vectors, 5, "vec_id", "embedding", "cosine", method="approximate"))


@query
def knn_measured_recall(spark, sf):
    """Per vector whose id is divisible by 100: its neighbours, and whether nine in ten are right over all of them."""
    vectors = table(spark, sf, "embeddings")
    found = neighbours.knn_graph(vectors, 5, "vec_id", "embedding", "cosine", method="approximate")
    asked = vectors.where(F.pmod("vec_id", F.lit(100)) == 0)
    hits = neighbours.neighbour_recall(found, vectors, asked, 5, "vec_id")
    share = hits.agg((F.sum("hits") / F.sum("found") >= 0.9).alias("enough"))
    return hits.select("key", "found").join(F.broadcast(share))



# ---- topics ----------------------------------------------------------------------------------

TERMS = topics.TermOptions(stop_words=STOP_WORDS)
RELABEL = topics.TermOptions(ngram_range=(1, 1), min_df=1, max_df=None, reduce_frequent_words=False, top_n_words=5)


def _scores(spark, sf, options=TERMS):
    counts = topics.topic_terms_count(topic_texts(spark, sf), options)
    return topics.ctfidf(counts, options.reduce_frequent_words)


@query
def topic_terms_count(spark, sf):
    return topics.topic_terms_count(topic_texts(spark, sf), TERMS)


@query
def ctfidf(spark, sf):
    return rounded_doubles(_scores(spark, sf))


@query
def top_terms(spark, sf):
    return rounded_doubles(topics.top_terms(_scores(spark, sf), 10))


@query
def topic_labels(spark, sf):
    return topics.topic_labels(topic_texts(spark, sf), topics.top_terms(_scores(spark, sf), 10))


@query
def update_topic_representation(spark, sf):
    """New terms and labels for the same topic ids."""
    best = topics.top_terms(_scores(spark, sf, RELABEL), RELABEL.top_n_words)
    return topics.topic_labels(topic_texts(spark, sf), best)


@query
def min_df_rule(spark, sf):
    sizes = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"))
    return sizes.withColumn("min_df", topics.min_df_rule(F.col("docs")).cast("int"))


@query
def renumber_topics(spark, sf):
    vectors = table(spark, sf, "embeddings")
    first = vectors.groupBy("label").agg(F.min("vec_id").alias("root"))
    named = vectors.join(first, "label").select(
        F.col("vec_id").alias("key"), F.when(F.col("label") != 9, F.col("root")).alias("root"))
    return density.renumber_topics(named)


@query
def topic_probability(spark, sf):
    docs = embedded_texts(spark, sf)
    scored = topics.topic_probability(docs, topics.topic_centroids(docs))
    return scored.select("source_column", "index", "topic_id", r6("topic_probability").alias("topic_probability"))


@query
def own_probability(spark, sf):
    """Memberships from event shares: the users are rows and the event types are topics."""
    number = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(
        F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    counts = table(spark, sf, "events").groupBy(F.col("user_id").alias("key"), number.alias("topic_id")).agg(
        F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("key").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "key").select("key", "topic_id", (F.col("n") / F.col("total")).alias("p"))
    rows = totals.select("key", (F.col("key") % 7 - 1).cast("int").alias("topic_id"))
    return rounded_doubles(topics.own_probability(rows, shares))


@query
def topic_assignments(spark, sf):
    docs = embedded_texts(spark, sf)
    scored = topics.topic_probability(docs, topics.topic_centroids(docs))
    labels = topics.topic_labels(topic_texts(spark, sf), topics.top_terms(_scores(spark, sf), 10))
    return rounded_doubles(topics.topic_assignments(scored, labels).drop("embedding"))


@query
def topic_summary(spark, sf):
    texts = topic_texts(spark, sf)
    labels = topics.topic_labels(texts, topics.top_terms(_scores(spark, sf), 10))
    reps = topics.representative_docs(texts, None, 3)
    return rounded_doubles(topics.topic_summary(topics.topic_assignments(texts, labels), labels, reps))


@query
def representative_docs(spark, sf):
    docs = embedded_texts(spark, sf)
    return topics.representative_docs(docs, topics.topic_centroids(docs), 3)


@query
def topic_run_metrics(spark, sf):
    return rounded_doubles(topics.topic_run_metrics(topic_texts(spark, sf)))


@query
def density_clusters(spark, sf):
    """Cluster number, rows and share of every density cluster of the stored vectors."""
    vectors = table(spark, sf, "embeddings")
    reduced = project.cluster_reduce(vectors, "pca", 2).select("vec_id", "coords")
    numbers = density.renumber_topics(density.density_cluster(reduced, "vec_id", "coords", 10, 5))
    return numbers.groupBy("topic_id").agg(F.count(F.lit(1)).alias("count"), F.min("key").alias("first_key"))


def _sizes(spark, sf):
    return topic_texts(spark, sf).groupBy("topic_id").agg(F.count(F.lit(1)).alias("count"))


@query
def select_topics(spark, sf):
    return topics.select_topics(_sizes(spark, sf), top_n=8)


@query
def barchart_data(spark, sf):
    return rounded_doubles(topicplots.barchart_data(topics.top_terms(_scores(spark, sf), 10), 5))


@query
def term_rank_data(spark, sf):
    return rounded_doubles(topicplots.term_rank_data(topics.top_terms(_scores(spark, sf), 10), True))


@query
def heatmap_terms(spark, sf):
    return rounded_doubles(topicplots.heatmap_data(topicplots.term_weights(_scores(spark, sf))))


@query
def heatmap_centroids(spark, sf):
    centroids = topics.topic_centroids(embedded_texts(spark, sf))
    return rounded_doubles(topicplots.heatmap_data(topicplots.centroid_weights(centroids)))


@query
def topic_hierarchy(spark, sf):
    centroids = topics.topic_centroids(embedded_texts(spark, sf))
    return rounded_doubles(topicplots.hierarchy_data(topicplots.heatmap_data(topicplots.centroid_weights(centroids))))


@query
def intertopic_map(spark, sf):
    docs = embedded_texts(spark, sf)
    shown = topics.select_topics(docs.groupBy("topic_id").agg(F.count(F.lit(1)).alias("count")))
    best = topics.top_terms(topics.ctfidf(topics.topic_terms_count(docs, TERMS)), 10)
    return rounded_doubles(topicplots.intertopic_map_data(shown, topics.topic_centroids(docs), best))


@query
def documents_plot(spark, sf):
    picked = topicplots.documents_plot_data(topic_texts(spark, sf), 0.35)
    return picked.select("source_column", "index", "topic_id", "place")


# ---- tasks and folds -------------------------------------------------------------------------


@query
def detect_task(spark, sf):
    rows = labelled_documents(spark, sf).withColumn("loud", F.col("toxic") == 1)
    return folds.detect_task(rows, ["quality", "toxic", "n_chars", "source", "lang", "loud"])


@query
def encode_label(spark, sf):
    return folds.encode_label(table(spark, sf, "documents").select("doc_id", "source"), "source")


@query
def fold_count(spark, sf):
    rows = labelled_documents(spark, sf)
    cases = [
        ("quality", "classification", "quality", None), ("toxic by source", "classification", "toxic", "source"),
        ("n_chars", "regression", "n_chars", None), ("n_chars by lang", "regression", "n_chars", "lang"),
    ]
    return stack.union_results([
        folds.fold_count(rows, task, y, 10, g).withColumn("test", F.lit(name)) for name, task, y, g in cases])


@query
def kfold(spark, sf):
    return folds.kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)


@query
def stratified_kfold(spark, sf):
    return folds.stratified_kfold(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", 5)


@query
def group_kfold(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id")
    return folds.group_kfold(rows, "user_id", 5).select("event_id", "user_id", "fold")


@query
def stratified_group_kfold(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label").join(
        table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id")
    return folds.stratified_group_kfold(rows, "source", "label", 4).select("vec_id", "source", "label", "fold")


@query
def inner_folds(spark, sf):
    outer = folds.stratified_kfold(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 4)
    nested = folds.inner_folds(outer, "doc_id", "classification", "toxic", 4, 3)
    return nested.select("doc_id", "fold", F.posexplode("inner").alias("outer", "inner"))


@query
def permuted_labels(spark, sf):
    return folds.permute_labels(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", 20)


# ---- features per fold -----------------------------------------------------------------------


def _long(spark, sf):
    return preprocess.long_features(folded_features(spark, sf), ["doc_id", "fold", "label"], "embedding")


@query
def scaler_statistics(spark, sf):
    return rounded_doubles(preprocess.scaler_statistics(_long(spark, sf)))


@query
def standardized_features(spark, sf):
    return preprocess.standardize(_long(spark, sf)).select("doc_id", "fold", "pos", r6("z").alias("z"))


@query
def select_kbest_class(spark, sf):
    chosen = preprocess.select_kbest(preprocess.f_class_scores(_long(spark, sf), "label"), 12)
    return rounded_doubles(chosen)


@query
def select_kbest_regression(spark, sf):
    chosen = preprocess.select_kbest(preprocess.f_regression_scores(_long(spark, sf), "label"), 12)
    return rounded_doubles(chosen)


@query
def select_percentile(spark, sf):
    return rounded_doubles(preprocess.select_percentile(preprocess.f_class_scores(_long(spark, sf), "label"), 20))


@query
def variance_threshold(spark, sf):
    return rounded_doubles(preprocess.variance_threshold(_long(spark, sf), 0.0155))


# ---- scores ----------------------------------------------------------------------------------


def _class_predictions(spark, sf):
    """Quality as truth, toxic as guess, by language and fold."""
    rows = labelled_documents(spark, sf)
    return folds.kfold(rows, "doc_id", 5).select(
        F.lit("quality").alias("target"), "lang", "fold", F.col("quality").alias("y"), F.col("toxic").alias("p"))


def _price_predictions(spark, sf):
    """Price against a guess from the quantity, in whole units so that sums are exact."""
    fold = F.col("l_orderkey") % 5
    return table(spark, sf, "lineitem").select(
        F.lit("price").alias("target"), "l_returnflag", fold.cast("int").alias("fold"),
        F.round("l_extendedprice").alias("y"), F.round(F.col("l_quantity") * 1500).alias("p"))


@query
def classification_metrics(spark, sf):
    return rounded_doubles(metrics.classification_metrics(_class_predictions(spark, sf), ["lang"]))


@query
def regression_metrics(spark, sf):
    return rounded_doubles(metrics.regression_metrics(_price_predictions(spark, sf), ["l_returnflag"]))


@query
def cv_scores(spark, sf):
    scores = metrics.cv_score(_price_predictions(spark, sf), "regression")
    return scores.select("target", r6("observed").alias("observed"), "cv_folds_used",
                         F.posexplode("cv_scores").alias("fold", "score")).withColumn("score", r6("score"))


@query
def pooled_metrics(spark, sf):
    names = ["accuracy", "f1", "recall", "r2"]
    return rounded_doubles(metrics.extra_metrics(_class_predictions(spark, sf), "classification", names))


def _event_scores(spark, sf):
    scores = table(spark, sf, "events").select(F.col("event_type").alias("target"), F.col("value").alias("score"))
    observed = scores.groupBy("target").agg(F.round(F.avg("score"), 2).alias("observed"))
    return scores, observed


@query
def permutation_pvalues(spark, sf):
    scores, observed = _event_scores(spark, sf)
    parts = [
        inference.permutation_pvalue(scores, observed, ["target"], larger).withColumn("larger_is_better", F.lit(larger))
        for larger in (True, False)
    ]
    return rounded_doubles(stack.union_results(parts))


@query
def permutation_histogram(spark, sf):
    return rounded_doubles(inference.permutation_histogram(*_event_scores(spark, sf), 30))


def _adjusted(method):
    def build(spark, sf):
        tests = event_tests(spark, sf).select("target", "target_name", "feature_set", "p_value")
        done = inference.adjust_pvalues(tests, method, ["feature_set"], "within_feature_set")
        return done.select("target", r6("p_value").alias("p_value"), r6("p_adjusted").alias("p_adjusted"),
                           "p_adjust_method", r6("p_fdr").alias("p_fdr"), "p_adjust_scope")

    build.__name__ = "adjust_" + method.replace("-", "_")
    return build


for _method in inference.METHODS:
    query(_adjusted(_method))


@query
def correction_scopes(spark, sf):
    tests = event_tests(spark, sf).select("target", "target_name", "feature_set", "p_value")
    parts = [
        inference.adjust_pvalues(tests, "holm", columns, scope)
        for scope, columns in inference.SCOPE_COLUMNS.items()
    ]
    return stack.union_results(parts).select("target", "p_adjust_scope", r6("p_adjusted").alias("p_adjusted"))


# ---- models ----------------------------------------------------------------------------------


def _results(found):
    results, _, _ = found
    shown = [c for c in results.columns if c not in ("cv_scores", "perm_scores")]
    return rounded_doubles(results.select(*shown))


def _modelled(options, target="labels"):
    def run(spark, sf):
        if target == "n_chars":
            y = table(spark, sf, "documents").select("doc_id", "n_chars")
            return modeling.cross_validate(vector_features(spark, sf), y, "doc_id", ["n_chars"], options)
        y = table(spark, sf, "labels")
        return modeling.cross_validate(vector_features(spark, sf), y, "doc_id", ["quality", "toxic"], options)

    return run


RIDGE = modeling.ModelOptions(n_permutations=200, report_metrics=("mae", "rmse"))
LASSO_TUNED = modeling.ModelOptions(
    regressor="lasso", n_permutations=200, tune=True, regressor_grid={"alpha": [0.1, 1.0, 10.0]},
    reduce_method="pca", reduce_n_components=20, reduce_components_grid=(5, 10, 20))
LOGISTIC = modeling.ModelOptions(n_permutations=20, report_metrics=("balanced_accuracy", "f1"))
SVM = modeling.ModelOptions(classifier="linear_svm", n_permutations=5, feature_selection="kbest", k_best=16)
FOREST = modeling.ModelOptions(
    classifier="random_forest", run_permutation=False, cv=2, classifier_params={"n_estimators": 10, "max_depth": 4})


@query
def ridge_permutation_test(spark, sf):
    return _results(_modelled(RIDGE, "n_chars")(spark, sf))


@query
def ridge_predictions(spark, sf):
    options = modeling.ModelOptions(run_permutation=False)
    return rounded_doubles(_modelled(options, "n_chars")(spark, sf)[1])


@query
def lasso_grid_search(spark, sf):
    return _results(_modelled(LASSO_TUNED, "n_chars")(spark, sf))


@query
def logistic_permutation_test(spark, sf):
    return _results(_modelled(LOGISTIC)(spark, sf))


@query
def linear_svm_kbest(spark, sf):
    return _results(_modelled(SVM)(spark, sf))


@query
def random_forest_cv(spark, sf):
    return _results(_modelled(FOREST)(spark, sf))


def _role_vectors(spark, sf):
    vectors = embed.embed_text(conversation_texts(spark, sf), dim=16)
    y = conversation_columns(spark, sf).select(
        "conv_id", F.length(F.coalesce("user", F.lit(""))).alias("user_length"))
    return vectors, y


@query
def separate_feature_sets(spark, sf):
    vectors, y = _role_vectors(spark, sf)
    options = modeling.ModelOptions(n_permutations=200, correction_method="holm")
    found = modeling.run_feature_sets(
        vectors, y, "conv_id", ["user_length"], "separate", options, "within_target", ["user", "assistant", "system"])
    return _results(found)


@query
def averaged_feature_set(spark, sf):
    vectors, y = _role_vectors(spark, sf)
    options = modeling.ModelOptions(n_permutations=200)
    return _results(modeling.run_feature_sets(vectors, y, "conv_id", ["user_length"], "average", options))


@query
def skipped_targets(spark, sf):
    """A target with one class only is reported, not modelled."""
    y = table(spark, sf, "labels").select("doc_id", F.lit("same").alias("constant"))
    options = modeling.ModelOptions(n_permutations=5)
    return modeling.cross_validate(vector_features(spark, sf), y, "doc_id", ["constant"], options)[2]


# ---- reports ---------------------------------------------------------------------------------


def _reported(spark, sf):
    return inference.adjust_pvalues(event_tests(spark, sf), "fdr_bh", [], "all_tests")


CONFIG = {"feature_selection": "kbest", "k_best": 12, "n_perm": 250, "task_mode": "regression"}


@query
def interpret_stats(spark, sf):
    overall = corpus.descriptive_stats(
        conversation_texts(spark, sf), textstats.StatsOptions(split_overall="both"), lexicon(spark, sf))[1]
    return report.interpret_stats(overall)


@query
def pick_overall(spark, sf):
    return rounded_doubles(report.pick_overall(_document_overall(spark, sf)[1]).drop("pos_full"))


@query
def interpret_model_rows(spark, sf):
    return report.interpret_model_rows(_reported(spark, sf))


@query
def interpret_model_rows_with_settings(spark, sf):
    return report.interpret_model_rows(_reported(spark, sf), CONFIG)


@query
def summarize_model_rows(spark, sf):
    return report.summarize_model_rows(_reported(spark, sf), True)


@query
def summarize_model_rows_unadjusted(spark, sf):
    return report.summarize_model_rows(_reported(spark, sf), False)


@query
def settings_of_results(spark, sf):
    return report.settings_of(_reported(spark, sf), ["task", "metric_name", "p_adjust_method", "p_adjust_scope"])


@query
def key_totals(spark, sf):
    return report.key_totals(_document_overall(spark, sf)[1])


@query
def model_report_table(spark, sf):
    return report.model_report_table(_reported(spark, sf))


@query
def fold_reduction_report(spark, sf):
    return folds.fold_reduction_report(_reported(spark, sf), 4)


@query
def report_lines(spark, sf):
    stats, overall = _document_overall(spark, sf)
    results = modeling.cross_validate(
        vector_features(spark, sf), table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id",
        ["n_chars"], modeling.ModelOptions(n_permutations=200))[0]
    projected = project.projection_table(project.pca_project(embedded_texts(spark, sf), 2), 2)
    return report.report_lines(
        spark, ["text"], "2024-01-01 00:00", summary.descriptive_summary_table(stats, overall), overall,
        projected, results, {"split_overall": "both"}, {"reduce_method": "pca", "umap_metric": "cosine"}, CONFIG)
