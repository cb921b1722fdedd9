"""Corpus totals: one row per source column and one for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexistat.functions.text import ratio_or_zero
from lexistat.operators.textstats import StatsOptions, annotate_tokens, text_row_stats, text_words

COMBINED = "Combined"
SUM_COLUMNS = (
    ("total_chars", "char_count"),
    ("total_words", "word_count"),
    ("total_sentences", "sentence_count"),
    ("nouns", "noun_count"),
    ("verbs", "verb_count"),
    ("adjectives", "adjective_count"),
    ("adverbs", "adverb_count"),
)


def _sets(split: str) -> list[list[str]]:
    """The grouping sets of each result shape; an unknown name means one combined row."""
    return {"per_column": [["source_column"]], "both": [["source_column"], []]}.get(split, [[]])


def by_corpus(df: DataFrame, split: str, *aggregates: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Aggregate once for all requested corpora (grouping sets), with a corpus label."""
    sets = [[F.col(c) for c in (*s, *extra)] for s in _sets(split)]
    columns = [F.col(c) for c in ("source_column", *extra)]
    if _sets(split) == [[]]:
        return df.groupBy(F.lit(COMBINED).alias("corpus"), *extra).agg(*aggregates)
    label = F.when(F.grouping("source_column") == 1, COMBINED).otherwise(F.col("source_column"))
    grouped = df.groupingSets(sets, *columns).agg(label.alias("corpus"), *aggregates)
    return grouped.drop("source_column")


def corpus_totals(stats: DataFrame, split: str = "both") -> DataFrame:
    return by_corpus(
        stats, split, F.count(F.lit(1)).alias("n_texts"),
        *[F.sum(c).alias(n) for n, c in SUM_COLUMNS],
    )


def vocabulary_rows(
    texts: DataFrame, options: StatsOptions = StatsOptions(), lexicon: DataFrame | None = None
) -> DataFrame:
    """(source_column, form): the distinct forms of each source, found before they are shuffled."""
    words = text_words(texts, options)
    forms = words.select(
        "source_column", F.explode(F.array_distinct("words")).alias("token")
    ).distinct()
    if lexicon is None:
        return forms.select("source_column", F.lower("token").alias("form")).distinct()
    known = annotate_tokens(forms, lexicon)
    if options.drop_stopwords:
        known = known.where(~F.col("is_stop"))
    form = F.col("lemma") if options.use_lemmas_for_uniques else F.lower("token")
    return known.select("source_column", form.alias("form")).distinct()


def vocab_size(vocabulary: DataFrame, split: str = "both", approximate: bool = False) -> DataFrame:
    """Size of the union of the row vocabularies."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return by_corpus(vocabulary, split, count("form").alias("total_unique_words"))


def corpus_averages(stats: DataFrame, split: str = "both", mode: str = "unweighted") -> DataFrame:
    """Mean of the row means; in ratio mode the sentence length is all words by all sentences."""
    sentence = (
        F.avg("avg_sentence_length")
        if mode == "unweighted"
        else ratio_or_zero(F.sum("word_count"), F.sum("sentence_count"))
    )
    return by_corpus(
        stats, split, F.avg("avg_word_length").alias("avg_word_length"),
        sentence.alias("avg_sentence_length"),
    )


def pos_distribution(stats: DataFrame, split: str = "both") -> DataFrame:
    """(corpus, pos, n) over all rows."""
    tags = stats.select("source_column", F.explode_outer("pos_full").alias("pos", "n")).where("pos IS NOT NULL")
    return by_corpus(tags, split, F.sum("n").alias("n"), extra=("pos",))


def corpus_overall(
    stats: DataFrame, vocabulary: DataFrame, options: StatsOptions = StatsOptions()
) -> DataFrame:
    """One row per corpus with totals, means, vocabulary, lexical diversity and the tag map."""
    split = options.split_overall
    sentence = (
        F.avg("avg_sentence_length")
        if options.avg_sentence_mode == "unweighted"
        else ratio_or_zero(F.sum("word_count"), F.sum("sentence_count"))
    )
    totals = by_corpus(
        stats, split, F.count(F.lit(1)).alias("n_texts"),
        *[F.sum(c).alias(n) for n, c in SUM_COLUMNS],
        F.avg("avg_word_length").alias("avg_word_length"), sentence.alias("avg_sentence_length"),
    )
    sizes = vocab_size(vocabulary, split)
    tags = (
        pos_distribution(stats, split).groupBy("corpus")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pos", "n")))).alias("pos_full"))
    )
    size = F.coalesce("total_unique_words", F.lit(0)).cast("bigint")
    return (
        totals.where("n_texts > 0").join(sizes, "corpus", "left").join(tags, "corpus", "left")
        .withColumn("total_unique_words", size)
        .withColumn("lexical_diversity", ratio_or_zero(F.col("total_unique_words"), F.col("total_words")))
    )


def descriptive_stats(
    texts: DataFrame, options: StatsOptions = StatsOptions(), lexicon: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(row statistics, corpus statistics) of stacked texts.

    The row statistics are a few numbers per text and are read several times, so they are kept.
    """
    stats = text_row_stats(texts, options, lexicon).persist()
    return stats, corpus_overall(stats, vocabulary_rows(texts, options, lexicon), options)
