"""Per-text statistics: one row per text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexistat.functions.text import (
    keep_words,
    ratio_or_zero,
    split_sentences,
    tokenize,
    total_length,
)

KEYS = ["source_column", "index"]
NOUN_TAGS = ("NOUN", "PROPN")
VERB_TAGS = ("VERB", "AUX")


@dataclass(frozen=True)
class StatsOptions:
    use_lemmas_for_uniques: bool = True
    words_must_be_alpha: bool = True
    drop_stopwords: bool = False
    stop_words: tuple[str, ...] = ()
    avg_sentence_mode: str = "unweighted"
    split_overall: str = "combined"


def text_words(df: DataFrame, options: StatsOptions = StatsOptions()) -> DataFrame:
    """Add the kept words of each text as an array."""
    stop: Sequence[str] | None = options.stop_words if options.drop_stopwords else None
    words = keep_words(tokenize(F.col("text")), options.words_must_be_alpha, stop)
    return df.withColumn("words", words)


def token_rows(df: DataFrame) -> DataFrame:
    """(source_column, index, pos, token, is_alpha): one row per token."""
    return df.select(*KEYS, F.posexplode(tokenize(F.col("text"))).alias("pos", "token")).withColumn(
        "is_alpha", F.col("token").rlike(r"^\p{L}+$")
    )


def annotate_tokens(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Left join of token rows with a lexicon (token, lemma, pos, is_stop), by lower-cased token.

    Tokens outside the lexicon keep their own lower-cased form as lemma and an empty tag. Of several entries
    for one lower-cased token the first counts, by lemma, then tag, then stop mark.
    """
    entries = lexicon.groupBy(F.lower("token").alias("_entry")).agg(
        F.min(F.struct("lemma", "pos", "is_stop")).alias("_first")
    ).select(
        "_entry", F.col("_first.lemma").alias("_lemma"), F.col("_first.pos").alias("_tag"),
        F.col("_first.is_stop").alias("_stop"),
    )
    joined = tokens.join(entries, F.lower(F.col("token")) == F.col("_entry"), "left")
    return joined.select(
        *[tokens[c] for c in tokens.columns],
        F.lower(F.coalesce("_lemma", "token")).alias("lemma"),
        F.coalesce("_tag", F.lit("")).alias("tag"),
        F.coalesce("_stop", F.lit(False)).alias("is_stop"),
    )


def text_row_stats(
    df: DataFrame, options: StatsOptions = StatsOptions(), lexicon: DataFrame | None = None
) -> DataFrame:
    """Counts, lengths, vocabulary and tag counts of each text.

    Without a lexicon this is a narrow projection: no shuffle, and it also runs on a stream. With a
    lexicon, the words are exploded, counted per text before any shuffle, and joined back.
    """
    texts = text_words(df, options)
    counted = _with_counts(texts)
    if lexicon is None:
        uniques = F.size(F.array_distinct(F.transform("words", lambda w: F.lower(w))))
        tagged = counted.withColumns(
            {
                "unique_words": uniques.cast("bigint"),
                **{n: F.lit(0).cast("bigint") for n in TAG_COUNTS},
                "pos_full": F.when(
                    F.col("word_count") > 0, F.create_map(F.lit(""), F.col("word_count"))
                ).otherwise(F.expr("cast(map() as map<string,bigint>)")),
            }
        )
    else:
        tagged = _lexicon_stats(texts, options, lexicon)
    return _final_columns(tagged)


TAG_COUNTS = ("noun_count", "verb_count", "adjective_count", "adverb_count")


def _with_counts(texts: DataFrame) -> DataFrame:
    return texts.withColumns(
        {
            "char_count": F.length("text").cast("bigint"),
            "word_count": F.size("words").cast("bigint"),
            "word_chars": total_length(F.col("words")),
            "sentence_count": F.size(split_sentences(F.col("text"))).cast("bigint"),
        }
    )


def _tag_count(tags: Sequence[str]) -> Column:
    return F.coalesce(F.sum(F.when(F.col("tag").isin(*tags), F.col("n"))), F.lit(0)).cast("bigint")


def _lexicon_stats(texts: DataFrame, options: StatsOptions, lexicon: DataFrame) -> DataFrame:
    forms = (
        texts.select(*KEYS, F.explode_outer("words").alias("token"))  # outer: see hashing_embedding
        .where("token IS NOT NULL").groupBy(*KEYS, "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    annotated = annotate_tokens(forms, lexicon)
    if options.drop_stopwords:
        annotated = annotated.where(~F.col("is_stop"))
    form = F.col("lemma") if options.use_lemmas_for_uniques else F.lower("token")
    by_tag = annotated.withColumn("form", form)
    per_text = by_tag.groupBy(*KEYS).agg(
        F.sum("n").alias("word_count"),
        F.sum(F.col("n") * F.length("token")).alias("word_chars"),
        F.count_distinct("form").alias("unique_words"),
        _tag_count(NOUN_TAGS).alias("noun_count"),
        _tag_count(VERB_TAGS).alias("verb_count"),
        _tag_count(("ADJ",)).alias("adjective_count"),
        _tag_count(("ADV",)).alias("adverb_count"),
    )
    maps = (
        by_tag.groupBy(*KEYS, "tag").agg(F.sum("n").alias("n")).groupBy(*KEYS)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("pos_full"))
    )
    base = texts.select(
        *KEYS, F.length("text").cast("bigint").alias("char_count"),
        F.size(split_sentences(F.col("text"))).cast("bigint").alias("sentence_count"),
    )
    joined = base.join(per_text, KEYS, "left").join(maps, KEYS, "left")
    numbers = ["word_count", "word_chars", "unique_words", *TAG_COUNTS]
    return joined.withColumns(
        {
            **{n: F.coalesce(n, F.lit(0)).cast("bigint") for n in numbers},
            "pos_full": F.coalesce("pos_full", F.expr("cast(map() as map<string,bigint>)")),
        }
    )


def _final_columns(df: DataFrame) -> DataFrame:
    return df.select(
        *KEYS, "char_count", "word_count", "sentence_count",
        ratio_or_zero(F.col("word_chars"), F.col("word_count")).alias("avg_word_length"),
        ratio_or_zero(F.col("word_count"), F.col("sentence_count")).alias("avg_sentence_length"),
        "unique_words",
        ratio_or_zero(F.col("unique_words"), F.col("word_count")).alias("lexical_diversity"),
        *TAG_COUNTS, "pos_full",
    )
