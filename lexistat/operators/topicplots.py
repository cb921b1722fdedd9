"""The data behind every topic figure."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexistat.functions.ranks import hash_order, number_by_hash
from lexistat.functions.session import cut_lineage
from lexistat.operators.project import pca_coordinates

COMMON = {"title", "width", "height"}
# The options each figure accepts.
PLOT_OPTIONS: Mapping[str, set[str]] = {
    "intertopic_map": {"topics", "top_n_topics", "use_ctfidf"} | COMMON,
    "barchart": {"topics", "top_n_topics", "n_words", "autoscale"} | COMMON,
    "heatmap": {"topics", "top_n_topics", "n_clusters", "use_ctfidf"} | COMMON,
    "hierarchy": {"topics", "top_n_topics", "orientation", "use_ctfidf"} | COMMON,
    "term_rank": {"topics", "log_scale"} | COMMON,
    "documents": {"docs", "topics", "embeddings", "reduced_embeddings", "sample", "hide_annotations",
                  "hide_document_hover"} | COMMON,
}


def validate_plot_request(plot_type: str, **options: Any) -> dict[str, Any]:
    """The options that are set, or an error that names the wrong one."""
    kind = str(plot_type).lower()
    if kind not in PLOT_OPTIONS:
        raise ValueError("plot_type must be one of: " + ", ".join(PLOT_OPTIONS))
    given = {k: v for k, v in options.items() if v is not None}
    if "topics" in given and not list(given["topics"]):
        raise ValueError("topics must contain at least one topic id when provided")
    if "topics" in given and "top_n_topics" in given:
        raise ValueError("Provide either topics or top_n_topics, not both")
    for name in given:
        derived = name == "top_n_topics" and "topics" in PLOT_OPTIONS[kind]
        if name not in PLOT_OPTIONS[kind] and not derived:
            raise ValueError(f"{name} is not supported for plot_type='{kind}'")
    for name in ("top_n_topics", "n_words", "n_clusters", "width", "height"):
        if name in given and int(given[name]) < 1:
            raise ValueError(f"{name} must be at least 1")
    if kind == "documents" and "docs" not in given:
        raise ValueError("docs are required for plot_type='documents'")
    if "sample" in given and not 0.0 < float(given["sample"]) <= 1.0:
        raise ValueError("sample must be between 0 and 1")
    if given.get("orientation", "left") not in ("left", "bottom"):
        raise ValueError("orientation must be either 'left' or 'bottom'")
    return given


def barchart_data(best: DataFrame, n_words: int = 5) -> DataFrame:
    return best.where(F.col("place") <= n_words)


def term_rank_data(best: DataFrame, log_scale: bool = False) -> DataFrame:
    """(topic_id, rank, term, score), with the score as its decimal logarithm on request."""
    score = F.log10("score") if log_scale else F.col("score")
    return best.select("topic_id", F.col("place").alias("rank"), "term", score.alias("score"))


def term_weights(scores: DataFrame) -> DataFrame:
    """Topic vectors in term space as (topic_id, feature, weight)."""
    return scores.where("topic_id <> -1").select("topic_id", F.col("term").alias("feature"),
                                                  F.col("score").alias("weight"))


def centroid_weights(centroids: DataFrame) -> DataFrame:
    """Topic vectors in embedding space in the same long form; d rows per topic."""
    return centroids.select("topic_id", F.posexplode("centroid").alias("feature", "weight"))


def heatmap_data(weights: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """(topic_a, topic_b, similarity): cosine of every pair of the topics to show (topic_id), or of all.

    A figure has one cell for each pair, so the result has one row for each; a pair without a common feature,
    or with a topic whose vector is zero, has similarity 0. Sums are taken for one order of a pair.

    Norms are written and read again, so that the planner knows how small they are: weights are not dealt by topic.
    The topics of a feature are listed beside each of them, without a shuffle where weights are dealt by feature already.
    """
    norms = cut_lineage(
        weights.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    )
    unit = weights.where("feature IS NOT NULL").join(norms, "topic_id").select(
        "topic_id", "feature", F.coalesce(F.try_divide("weight", "norm"), F.lit(0.0)).alias("w")
    )
    held = F.collect_list(F.struct("topic_id", "w")).over(Window.partitionBy("feature"))  # at most one for each topic
    met = unit.withColumn("held", held).select("topic_id", "w", F.explode("held").alias("other"))
    met = met.where(F.col("topic_id") <= F.col("other.topic_id"))
    shared = met.groupBy(F.col("topic_id").alias("topic_a"), F.col("other.topic_id").alias("topic_b")).agg(
        F.sum(F.col("w") * F.col("other.w")).alias("similarity")
    )
    shown = (norms if topics is None else topics).agg(F.sort_array(F.collect_set("topic_id")).alias("ids"))
    cells = shown.select(F.explode("ids").alias("topic_a"), "ids").select(
        "topic_a", F.explode("ids").alias("topic_b")
    ).where("topic_a <= topic_b")
    half = cells.join(shared, ["topic_a", "topic_b"], "left").select(
        "topic_a", "topic_b", F.coalesce("similarity", F.lit(0.0)).alias("similarity")
    )
    there = F.struct("topic_a", "topic_b", "similarity")
    back = F.struct(F.col("topic_b").alias("topic_a"), F.col("topic_a").alias("topic_b"), "similarity")
    return half.select(F.inline(F.when(F.col("topic_a") < F.col("topic_b"), F.array(there, back)).otherwise(F.array(there))))


def hierarchy_data(similarities: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(step, topic_a, topic_b, distance, members): topics merged from the closest pair up.

    Ward's rule on cosine distances. The table holds the pairs of the topics to show; every round merges all
    mutually nearest pairs, so rounds grow with the logarithm of the topics, and steps are numbered by distance.
    """
    spark = similarities.sparkSession
    squared = F.greatest(F.lit(1.0) - F.col("similarity"), F.lit(0.0))
    pairs = cut_lineage(
        similarities.where("topic_a <> topic_b").select(
            F.col("topic_a").alias("a"), F.col("topic_b").alias("b"), (squared * squared).alias("d2"),
            F.lit(1).cast("bigint").alias("na"), F.lit(1).cast("bigint").alias("nb"),
        )
    )
    topics, given = similarities.select("topic_a").union(similarities.select("topic_b")).distinct().count(), pairs.count()
    if given < topics * (topics - 1):
        raise ValueError(f"similarities are missing: {given} pairs for {topics} topics")

    def both_ways(half: DataFrame) -> DataFrame:
        """Each pair from both sides with one distance, however it was rounded."""
        there = F.struct("a", "b", "d2", "na", "nb")
        back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "d2", F.col("nb").alias("na"), F.col("na").alias("nb"))
        return cut_lineage(half.where("a < b").select(F.inline(F.array(there, back))).coalesce(4))

    pairs, done = both_ways(pairs), None
    while not pairs.isEmpty():
        # Ward's distances are reducible: all mutually nearest pairs can merge at once and give the same tree.
        nearest = pairs.groupBy("a").agg(
            F.min(F.struct("d2", F.least("a", "b").alias("kept"), F.greatest("a", "b").alias("gone"))).alias("x"),
            F.first("na").alias("na"),
        )
        mutual = cut_lineage(nearest.groupBy("x").agg(
            F.count(F.lit(1)).alias("both"), F.sum("na").alias("members")
        ).where("both = 2").select("x.*", "members"))
        done = mutual if done is None else done.unionByName(mutual)
        home = mutual.select(
            F.explode(F.array("kept", "gone")).alias("topic"), F.col("kept").alias("to"), F.col("d2").alias("inner"), "members"
        )
        placed = pairs
        for end, n in (("a", "na"), ("b", "nb")):
            placed = placed.join(home.select(*[F.col(c).alias(f"{c}_{end}") for c in home.columns]),
                                 F.col(end) == F.col(f"topic_{end}"), "left").select(
                *placed.columns, F.coalesce(f"to_{end}", end).alias(f"new_{end}"),
                F.coalesce(f"inner_{end}", F.lit(0.0)).alias(f"inner_{end}"),
                F.coalesce(f"members_{end}", n).alias(f"n_{end}"),
            )
        # One side of every pair grows first, then the other.
        one = placed.where("new_a <> new_b").groupBy("new_a", "b", "nb", "new_b", "inner_a", "n_a", "inner_b", "n_b").agg(
            F.sum((F.col("na") + F.col("nb")) * F.col("d2")).alias("s")
        ).withColumn("d2", (F.col("s") - F.col("nb") * F.col("inner_a")) / (F.col("n_a") + F.col("nb")))
        two = one.groupBy("new_a", "new_b", "n_a", "n_b", "inner_b").agg(
            F.sum((F.col("nb") + F.col("n_a")) * F.col("d2")).alias("s"))
        pairs = both_ways(two.select(
            F.col("new_a").alias("a"), F.col("new_b").alias("b"),
            ((F.col("s") - F.col("n_a") * F.col("inner_b")) / (F.col("n_a") + F.col("n_b"))).alias("d2"),
            F.col("n_a").alias("na"), F.col("n_b").alias("nb"),
        ))
    if done is None:
        return spark.createDataFrame([], "step int, topic_a int, topic_b int, distance double, members bigint")
    order = Window.partitionBy(F.lit(0)).orderBy("d2", "kept", "gone")  # one row per shown topic
    return done.select(
        F.row_number().over(order).alias("step"), F.col("kept").cast("int").alias("topic_a"),
        F.col("gone").cast("int").alias("topic_b"), F.sqrt("d2").alias("distance"), "members",
    )


def heatmap_clusters(merges: DataFrame, topics: list[int], n_clusters: int) -> dict[int, int]:
    """The cluster of each shown topic when the merge list is cut at n_clusters."""
    if n_clusters < 1:
        raise ValueError("n_clusters must be at least 1")
    group = {t: t for t in topics}
    for row in merges.orderBy("step").limit(max(0, len(topics) - n_clusters)).collect():
        group = {t: row["topic_a"] if g == row["topic_b"] else g for t, g in group.items()}
    number = {g: i for i, g in enumerate(sorted(set(group.values())))}
    return {t: number[g] for t, g in group.items()}


def intertopic_map_data(shown: DataFrame, centroids: DataFrame, best: DataFrame) -> DataFrame:
    """(topic_id, x, y, count, marker_size, words) of the shown topics (topic_id, count, place)."""
    placed = shown.join(centroids, "topic_id")
    n = placed.count()
    if n == 0:
        raise ValueError("No non-noise topics are available to visualize")
    if n >= 3:
        dim = placed.select(F.max(F.size("centroid"))).first()[0]
        coords = pca_coordinates(placed, min(2, dim), "centroid")
        y: Column = F.col("coords")[1] if dim > 1 else F.lit(0.0)
        flat = coords.withColumns({"x": F.col("coords")[0], "y": y})
    else:
        side = F.when(F.col("place") == placed.agg(F.min("place")).first()[0], -1.0).otherwise(1.0)
        flat = placed.withColumns({"x": side if n == 2 else F.lit(0.0), "y": F.lit(0.0)})
    whole = Window.partitionBy(F.lit(0))
    low, high = F.min("count").over(whole), F.max("count").over(whole)
    size = F.when(high == low, 36.0).otherwise(30.0 + 36.0 * (F.col("count") - low) / (high - low))
    words = best.where("place <= 5").groupBy("topic_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))),
                                 lambda t: t["term"]), " | ").alias("words")
    )
    return flat.withColumn("marker_size", size).join(words, "topic_id", "left").select(
        "topic_id", "x", "y", "count", "marker_size", F.coalesce("words", F.lit("")).alias("words")
    )


def documents_plot_data(
    assignments: DataFrame, share: float = 1.0, seed: int = 42, key: str = "index"
) -> DataFrame:
    """A share of the rows of every topic, rounded up, in hash order."""
    if not 0.0 < share <= 1.0:
        raise ValueError("sample must be between 0 and 1")
    hashed = assignments.withColumn("_hash", hash_order(seed, F.col(key)))
    ranked = number_by_hash(hashed, "_hash", [key], ["topic_id"], "place")
    sizes = assignments.groupBy("topic_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        ranked.join(sizes, "topic_id").where(F.col("place") <= F.ceil(F.lit(share) * F.col("_n")))
        .drop("_hash", "_n")
    )
