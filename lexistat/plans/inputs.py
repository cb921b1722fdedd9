"""Input tables of the registered queries: whole tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexistat.functions.session import spread
from lexistat.functions.text import tokenize
from lexistat.operators.stack import long_text, stack_text
from lexistat.operators.textstats import StatsOptions

# Words left out where a query shows stop words.
STOP_WORDS = ("the", "and", "of", "to", "in", "that", "de", "la", "les", "der", "die", "und", "el", "los")
STOP_OPTIONS = StatsOptions(drop_stopwords=True, stop_words=STOP_WORDS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as (source_column, index, text), with the language as source."""
    rows = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return long_text(spread(rows, "doc_id"), F.col("doc_id"), "text", "lang")


def conversation_columns(spark: SparkSession, folder: str) -> DataFrame:
    """One row per conversation with the text of each role in a column of its own."""
    turns = table(spark, folder, "conversations")
    joined = turns.groupBy("conv_id", "role").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), " "
        ).alias("said")
    )
    return joined.groupBy("conv_id").pivot("role", ["user", "assistant", "system"]).agg(F.first("said"))


def conversation_texts(spark: SparkSession, folder: str) -> DataFrame:
    return stack_text(conversation_columns(spark, folder), "conv_id", ["user", "assistant", "system"])


def lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """(token, lemma, pos, is_stop) over the words of the benchmark table, tagged by their endings."""
    words = table(spark, folder, "benchmark").select(F.explode(tokenize(F.lower("text"))).alias("token")).distinct()
    return words.select(
        "token",
        F.regexp_replace("token", "(s|en|ing)$", "").alias("lemma"),
        F.when(F.col("token").rlike("(th|er)$"), "NOUN").when(F.col("token").rlike("(sh|ed)$"), "VERB")
        .when(F.col("token").rlike("(en|ble)$"), "ADJ").when(F.col("token").rlike("ly$"), "ADV")
        .when(F.col("token").rlike("s$"), "PROPN").when(F.length("token") <= 3, "AUX")
        .otherwise("X").alias("pos"),
        (F.length("token") <= 2).alias("is_stop"),
    ).where(F.col("lemma") != "")


def topic_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the number of their source as topic; the last source plays the noise."""
    rows = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    number = F.substring("source", 4, 8).cast("int")
    topics = F.when(number == 19, -1).otherwise(number)
    return spread(rows, "doc_id").select(
        F.col("lang").alias("source_column"), F.col("doc_id").alias("index"), "text", topics.alias("topic_id")
    )


def embedded_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have a stored vector; the label of the vector is the topic, 9 is noise."""
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("index"), "embedding",
        F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("topic_id"),
    )
    return document_texts(spark, folder).join(vectors, "index").select(
        "source_column", "index", "text", "topic_id", "embedding"
    )


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, quality, toxic, n_chars, source, lang) of the labelled documents."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, folder, "labels").join(docs, "doc_id")


def vector_features(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def folded_features(spark: SparkSession, folder: str, folds: int = 5) -> DataFrame:
    """(doc_id, fold, embedding, label) with folds from the hash of the key."""
    fold = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 6), 16, 10).cast("bigint") % folds
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), fold.cast("int").alias("fold"), "embedding", "label"
    )


def event_tests(spark: SparkSession, folder: str) -> DataFrame:
    """A result table with one test per event type and user, computed from the events."""
    grouped = table(spark, folder, "events").groupBy("event_type", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 40).alias("high"),
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"),
    )
    classes = F.col("user_id") % 2 == 0
    mean = F.col("cents") / F.lit(100.0) / F.col("n")
    chance = (F.col("high") + 1) / (F.col("n") + 1)
    return grouped.select(
        F.concat_ws(" :: ", "event_type", F.col("user_id").cast("string")).alias("target"),
        F.col("user_id").cast("string").alias("target_name"), F.col("event_type").alias("feature_set"),
        F.when(classes, "classification").otherwise("regression").alias("task"),
        F.when(classes, "accuracy").otherwise("r2").alias("metric_name"),
        (F.log(mean + 1.0) / F.when(classes, 5.5).otherwise(8.0) - F.when(classes, 0.0).otherwise(0.45)).alias("observed"),
        F.when(F.col("user_id") % 11 != 0, F.pow(chance, F.lit(3.3))).alias("p_value"),
        (F.col("n") % 4 + 2).cast("int").alias("cv_folds_used"),
    )


def r6(value: Column | str) -> Column:
    """Rounded to six decimals, as the checks compare them; a negative zero becomes zero."""
    x = F.col(value) if isinstance(value, str) else value
    return F.round(x.cast("double"), 6) + F.lit(0.0)


def rounded_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[
        r6(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
