"""Topic terms, labels, memberships, assignments and summaries, given a topic id per text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexistat.functions.session import cut_lineage
from lexistat.functions.sums import matrix
from lexistat.functions.text import VISIBLE_PATTERN, one_line, shorten, strip_accents
from lexistat.functions.vectors import dot, l2_norm
from lexistat.operators.density import density_cluster, renumber_topics
from lexistat.operators.embed import require_dimension
from lexistat.operators.grams import batch_gram_counts
from lexistat.operators.project import cluster_reduce
from lexistat.operators.stack import first_rows_of

NOISE = -1
NOISE_LABEL = "Outlier / noise"
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
KEYS = ["source_column", "index"]
CENTROID_BLOCK = 20_000
TASK_CHARS = 8_000_000
SENT_TOPICS = 100_000  # topics up to which a number of each is sent to all tasks


@dataclass(frozen=True)
class TermOptions:
    ngram_range: tuple[int, int] = (1, 2)
    stop_words: tuple[str, ...] = ()
    min_df: int | float | None = None
    max_df: int | float | None = 0.9
    strip_accents: bool = True
    reduce_frequent_words: bool = True
    top_n_words: int = 10

    def __post_init__(self) -> None:
        if len(self.ngram_range) != 2 or not 1 <= self.ngram_range[0] <= self.ngram_range[1]:
            raise ValueError("ngram_range must contain exactly two rising positive integers")


def validate_topic_input(texts: DataFrame, vector: str = "embedding") -> int:
    """Number of rows; raises on no rows, blank texts or vectors of unequal length."""
    n, _ = require_dimension(texts, vector)
    if n == 0:
        raise ValueError("texts must contain at least one non-empty document")
    blank = texts.where(F.col("text").isNull() | ~F.col("text").rlike(VISIBLE_PATTERN))
    if not blank.isEmpty():
        raise ValueError("texts must not contain empty documents")
    return n


def min_df_rule(n_docs: Column, min_df: int | float | None = None) -> Column:
    """The given value, else 2 from 20 documents on and 1 below."""
    if min_df is not None:
        return F.lit(min_df)
    return F.when(n_docs >= 20, 2).otherwise(1)


def document_words(text: Column, options: TermOptions) -> Column:
    plain = F.lower(text)
    plain = strip_accents(plain) if options.strip_accents else plain
    words = F.regexp_extract_all(plain, F.lit(TERM_PATTERN), F.lit(0))
    if options.stop_words:
        words = F.filter(words, lambda w: ~w.isin(*options.stop_words))
    return words


def topic_terms_count(docs: DataFrame, options: TermOptions = TermOptions()) -> DataFrame:
    """(topic_id, term, n, topics): how often each topic uses a term; n-grams do not cross from one text into the next.

    The document thresholds count topics, because all texts of a topic together are one document.
    """
    size = docs.agg(
        F.count(F.lit(1)).alias("docs"), F.count_distinct("topic_id").alias("topics"), F.sum(F.length("text")).alias("chars")
    ).first()
    low = options.min_df if options.min_df is not None else (2 if size["docs"] >= 20 else 1)
    low = low * size["topics"] if isinstance(low, float) else low
    high = size["topics"] if options.max_df is None else options.max_df
    high = high * size["topics"] if isinstance(high, float) else high
    words = docs.select("topic_id", document_words(F.col("text"), options).alias("words"))
    found = batch_gram_counts(words.where("words is not null"), "topic_id", *options.ngram_range)
    # One shuffle, by term, serves both the sums and the windows; a task gets the terms of a bounded number of characters.
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-(size["chars"] or 0) // TASK_CHARS))
    counts = found.repartition(parts, "term").groupBy("topic_id", "term").agg(F.sum("n").alias("n"))
    # At most one row per topic and term is in each of these windows.
    used = counts.withColumn("topics", F.count(F.lit(1)).over(Window.partitionBy("term")))
    return used.where((F.col("topics") >= F.lit(low)) & (F.col("topics") <= F.lit(high)))


def ctfidf(counts: DataFrame, reduce_frequent_words: bool = True) -> DataFrame:
    """(topic_id, term, n, score): class-based tf-idf.

    The counts are read three times, so they are kept; they are far smaller than the texts.
    """
    counts = counts.persist()
    totals = counts.groupBy("topic_id").agg(F.sum("n").alias("terms"))
    whole = totals.agg(F.sum("terms").alias("s"), F.count(F.lit(1)).alias("k")).first()
    mean_terms = float(int((whole["s"] or 0) / (whole["k"] or 1)))
    # Merged by topic, one task would sort all terms of a large topic.
    totals = F.broadcast(totals) if whole["k"] <= SENT_TOPICS else totals
    share = F.col("n") / F.col("terms")
    tf = F.sqrt(share) if reduce_frequent_words else share
    corpus = F.sum("n").over(Window.partitionBy("term"))
    return (
        counts.withColumn("corpus_n", corpus).join(totals, "topic_id")
        .select("topic_id", "term", "n",
                (tf * F.log(F.lit(1.0) + F.lit(mean_terms) / F.col("corpus_n"))).alias("score"))
    )


def top_terms(scores: DataFrame, n: int = 10) -> DataFrame:
    """(topic_id, place, term, score): the best terms of each topic; none for noise."""
    usable = scores.where((F.col("topic_id") != NOISE) & F.col("term").rlike(VISIBLE_PATTERN))
    best = first_rows_of(usable, ["topic_id"], [F.desc("score"), F.col("term")], n)
    return best.select("topic_id", "place", "term", "score")


def topic_labels(topic_ids: DataFrame, best: DataFrame, max_terms: int = 3) -> DataFrame:
    """(topic_id, topic_label, top_terms) for every topic id.

    Written and read again, so that the planner knows how small they are: texts are not dealt by topic to be labelled.
    """
    listed = best.groupBy("topic_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda t: t["term"])
        .alias("terms")
    )
    number = F.concat(F.lit("Topic "), F.col("topic_id").cast("string"))
    few = F.array_join(F.slice("terms", 1, max_terms), ", ")
    label = (
        F.when(F.col("topic_id") == NOISE, NOISE_LABEL)
        .when(F.size("terms") > 0, F.concat(number, F.lit(": "), few))
        .otherwise(number)
    )
    return cut_lineage(topic_ids.select("topic_id").distinct().join(listed, "topic_id", "left").select(
        "topic_id", label.alias("topic_label"),
        F.coalesce(F.array_join("terms", ", "), F.lit("")).alias("top_terms"),
    ))


def topic_centroids(docs: DataFrame, vector: str = "embedding") -> DataFrame:
    """(topic_id, centroid) of the topics that are not noise."""
    vectors = docs.where(F.col("topic_id") != NOISE).select(
        "topic_id", array_to_vector(F.col(vector).cast("array<double>")).alias("v")
    )
    means = vectors.groupBy("topic_id").agg(Summarizer.mean(F.col("v")).alias("v"))
    return means.select("topic_id", vector_to_array("v").alias("centroid"))


def topic_probability(docs: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add topic_probability: the softmin of the distance to the own centroid; null for noise.

    All centroids take part in the sum. They are sent to the tasks in blocks of fixed size.
    """
    rows = centroids.orderBy("topic_id").toLocalIterator()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.withColumns({"_total": F.lit(0.0), "_own": F.lit(None).cast("double")})

    def block_step(ids: np.ndarray, centers: np.ndarray):
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                x = matrix(batch[vector])
                squared = (x * x).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2.0 * x @ centers.T
                weight = np.exp(-np.sqrt(np.maximum(squared, 0.0)))
                topic = batch["topic_id"].to_numpy()
                at = np.searchsorted(ids, topic)
                at = np.where(at < len(ids), at, 0)
                inside = ids[at] == topic
                own = np.where(inside, weight[np.arange(len(x)), at], batch["_own"].to_numpy(dtype=float))
                yield batch.assign(_total=batch["_total"] + weight.sum(1), _own=own)

        return step

    block: list = []

    def flush(df: DataFrame) -> DataFrame:
        ids = np.array([r["topic_id"] for r in block])
        centers = np.array([r["centroid"] for r in block])
        return df.mapInPandas(block_step(ids, centers), f"{schema}, _total double, _own double")

    for row in rows:
        block.append(row)
        if len(block) == CENTROID_BLOCK:
            out = flush(out)
            block = []
    if block:
        out = flush(out)
    own = F.when((F.col("topic_id") != NOISE) & ~F.isnan("_own"), F.col("_own") / F.col("_total"))
    return out.withColumn("topic_probability", own).drop("_total", "_own")


def own_probability(topics: DataFrame, memberships: DataFrame) -> DataFrame:
    """Add topic_probability from long memberships (key, topic_id, p).

    The entry of the own topic counts, else the largest entry of the row; null for noise.
    """
    mine = memberships.join(topics.select("key", F.col("topic_id").alias("own")), "key")
    picked = mine.groupBy("key").agg(
        F.max(F.when(F.col("topic_id") == F.col("own"), F.col("p"))).alias("hit"),
        F.max(F.when(~F.isnan("p"), F.col("p"))).alias("most"),
    )
    value = F.when(F.col("topic_id") != NOISE, F.coalesce("hit", "most"))
    return topics.join(picked, "key", "left").withColumn("topic_probability", value).drop("hit", "most")


def topic_assignments(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The seven assignment columns in order, then the others."""
    ordered = ["index", "source_column", "text", "topic_id", "topic_label", "topic_probability", "is_outlier"]
    known = docs if "topic_probability" in docs.columns else docs.withColumn(
        "topic_probability", F.lit(None).cast("double")
    )
    joined = known.join(labels.select("topic_id", "topic_label"), "topic_id", "left").withColumn(
        "is_outlier", F.col("topic_id") == NOISE
    )
    extras = [c for c in docs.columns if c not in ordered]
    return joined.select(*ordered, *extras)


def representative_docs(
    docs: DataFrame, centroids: DataFrame | None = None, n: int = 3, vector: str = "embedding"
) -> DataFrame:
    """(topic_id, representative_docs): the texts nearest to the centroid, else the first ones."""
    if centroids is None:
        ranked = first_rows_of(docs, ["topic_id"], [F.col("index"), F.col("source_column")], n)
    else:
        near = docs.join(centroids, "topic_id", "left")
        # A zero vector has no direction: its closeness is null and comes last.
        cosine = F.try_divide(
            dot(F.col(vector), F.col("centroid")), l2_norm(F.col(vector)) * l2_norm(F.col("centroid"))
        )
        ranked = first_rows_of(
            near.select("topic_id", "index", "source_column", "text", cosine.alias("closeness")),
            ["topic_id"], [F.desc_nulls_last("closeness"), F.col("index"), F.col("source_column")], n,
        )
    cleaned = ranked.select("topic_id", "place", F.trim(one_line(F.col("text"))).alias("t")).where("t <> ''")
    return cleaned.groupBy("topic_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("place", shorten(F.col("t")).alias("t")))),
                lambda x: x["t"],
            ),
            " || ",
        ).alias("representative_docs")
    )


def topic_summary(assignments: DataFrame, labels: DataFrame, representatives: DataFrame) -> DataFrame:
    """(topic_id, topic_label, count, share, top_terms, representative_docs)."""
    missing = {"topic_id", "topic_label", "text"}.difference(assignments.columns)
    if missing:
        raise ValueError("assignments are missing required columns: " + ", ".join(sorted(missing)))
    counts = assignments.groupBy("topic_id").agg(F.count(F.lit(1)).alias("count"))
    # One row per topic.
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return (
        counts.withColumn("share", F.col("count") / total)
        .join(labels, "topic_id", "left").join(representatives, "topic_id", "left")
        .select("topic_id", "topic_label", "count", "share", "top_terms",
                F.coalesce("representative_docs", F.lit("")).alias("representative_docs"))
    )


def topic_run_metrics(assignments: DataFrame) -> DataFrame:
    noise = F.col("topic_id") == NOISE
    return assignments.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_distinct(F.when(~noise, F.col("topic_id"))).alias("topics"),
        F.count_if(noise).alias("noise_documents"),
        F.coalesce(F.avg(noise.cast("double")), F.lit(0.0)).alias("noise_share"),
    )


def topic_representation(
    docs: DataFrame, options: TermOptions = TermOptions(), vector: str | None = "embedding", n_docs: int = 3
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(best terms, assignments, summary) for given topic ids.

    Run it again on stored topic ids with other options to relabel without clustering again.
    """
    counts = topic_terms_count(docs, options)
    best = top_terms(ctfidf(counts, options.reduce_frequent_words), options.top_n_words)
    labels = topic_labels(docs, best)
    centroids = topic_centroids(docs, vector) if vector else None
    scored = topic_probability(docs, centroids, vector) if vector else docs
    assignments = topic_assignments(scored, labels)
    reps = representative_docs(docs, centroids, n_docs, vector or "embedding")
    return best, assignments, topic_summary(assignments, labels, reps)


def fit_topics(
    texts: DataFrame, reduce_method: str = "umap", n_components: int | None = None,
    min_cluster_size: int = 10, min_samples: int | None = None, n_neighbors: int = 15,
) -> DataFrame:
    """Add topic_id to embedded texts: reduce, cluster by density, number by size."""
    validate_topic_input(texts)
    keyed = texts.withColumn("_key", F.concat_ws("\u0001", "source_column", F.col("index").cast("string")))
    reduced = cluster_reduce(keyed, reduce_method, n_components, n_neighbors=n_neighbors)
    chosen = density_cluster(reduced.select("_key", "coords"), "_key", "coords", min_cluster_size, min_samples)
    numbers = renumber_topics(chosen)
    return keyed.join(numbers, keyed["_key"] == numbers["key"]).drop("_key", "key")


def select_topics(
    topic_sizes: DataFrame, topics: Sequence[int] | None = None, top_n: int | None = None
) -> DataFrame:
    """Topic ids to show with their place: the given ones, or the largest without noise."""
    if topics is not None and top_n is not None:
        raise ValueError("Provide either topics or top_n_topics, not both")
    if topics is not None:
        if not topics:
            raise ValueError("topics must contain at least one topic id when provided")
        wanted = topic_sizes.sparkSession.createDataFrame(
            [(int(t), i) for i, t in enumerate(topics, start=1)], "topic_id int, place int"
        )
        return topic_sizes.join(F.broadcast(wanted), "topic_id")
    if top_n is not None and top_n < 1:
        raise ValueError("top_n_topics must be at least 1")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), "topic_id")
    placed = topic_sizes.where(F.col("topic_id") != NOISE).withColumn("place", F.row_number().over(order))
    return placed if top_n is None else placed.where(F.col("place") <= top_n)
