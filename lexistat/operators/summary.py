"""The summary table of a corpus, and its long, Markdown and LaTeX forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexistat.operators.corpus import COMBINED, by_corpus

# Display names of the summary metrics in their groups, in export order.
METRIC_GROUPS = (
    ("Corpus Size", ("N Texts", "Total Characters", "Total Words", "Total Sentences",
                     "Total Unique Words")),
    ("Per-Text Counts", ("Mean Characters / Text", "SD Characters / Text", "Mean Words / Text",
                         "SD Words / Text", "Mean Sentences / Text", "SD Sentences / Text",
                         "Mean Unique Words / Text", "SD Unique Words / Text")),
    ("Lexical Richness", ("Lexical Diversity (TTR)", "Mean Lexical Diversity (TTR) / Text",
                          "SD Lexical Diversity (TTR) / Text")),
    ("Length Metrics", ("Mean Sentence Length", "SD Sentence Length", "Mean Word Length",
                        "SD Word Length")),
)
# Characters that LaTeX needs escaped.
LATEX_ESCAPES = (
    ("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"),
    ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"),
)
ROW_STATS = (
    ("Characters / Text", "char_count"), ("Words / Text", "word_count"),
    ("Sentences / Text", "sentence_count"), ("Unique Words / Text", "unique_words"),
    ("Lexical Diversity (TTR) / Text", "lexical_diversity"),
    ("Sentence Length", "avg_sentence_length"), ("Word Length", "avg_word_length"),
)


def rounded(x: Column, decimals: int) -> Column:
    """Half to even, by scaling: what a float column's round gives."""
    scale = F.lit(float(10**decimals))
    return F.rint(x * scale) / scale


def descriptive_summary_table(
    stats: DataFrame,
    overall: DataFrame | None = None,
    decimals: int = 3,
    include_combined: bool = True,
    include_per_column: bool = True,
) -> DataFrame:
    """One row per corpus. Totals, mean lengths and diversity come from `overall` where it has them."""
    if not include_combined and not include_per_column:
        split, keep = "both", F.lit(False)
    else:
        split = "both" if include_per_column else "combined"
        keep = F.lit(True) if include_combined else F.col("corpus") != COMBINED
    rows = by_corpus(
        stats, split, F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"sum_{c}") for c in ("char_count", "word_count", "sentence_count")],
        *[F.avg(c).alias(f"mean_{c}") for _, c in ROW_STATS],
        *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"sd_{c}") for _, c in ROW_STATS],
    ).where("n > 0")
    taken = ("total_chars", "total_words", "total_sentences", "total_unique_words",
             "avg_word_length", "avg_sentence_length", "lexical_diversity")
    if overall is None:
        known = rows.withColumns({c: F.lit(None).cast("double") for c in taken})
    else:
        present = [c for c in taken if c in overall.columns]
        known = rows.join(overall.select("corpus", *present), "corpus", "left").withColumns(
            {c: F.lit(None).cast("double") for c in taken if c not in present}
        )
    if include_combined and include_per_column:
        sources = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) - 1
        known = known.withColumn("_sources", sources).where(
            (F.col("corpus") != COMBINED) | (F.col("_sources") > 1)
        )
    words = F.coalesce("total_words", "sum_word_count")
    diversity = F.coalesce(
        "lexical_diversity",
        F.when(words > 0, F.col("total_unique_words") / words),
        "mean_lexical_diversity",
    )
    values: dict[str, Column] = {
        "N Texts": F.col("n"),
        "Total Characters": F.coalesce("total_chars", "sum_char_count"),
        "Total Words": words,
        "Total Sentences": F.coalesce("total_sentences", "sum_sentence_count"),
        "Total Unique Words": F.col("total_unique_words"),
    }
    for title, c in ROW_STATS:
        values[f"Mean {title}"] = F.col(f"mean_{c}")
        values[f"SD {title}"] = F.col(f"sd_{c}")
    values["Lexical Diversity (TTR)"] = diversity
    values["Mean Sentence Length"] = F.coalesce("avg_sentence_length", "mean_avg_sentence_length")
    values["Mean Word Length"] = F.coalesce("avg_word_length", "mean_avg_word_length")
    ints = set(METRIC_GROUPS[0][1])
    ordered = [m for _, metrics in METRIC_GROUPS for m in metrics]
    return (
        known.where(keep)
        .select(
            F.col("corpus").alias("Corpus"),
            *[
                values[m].cast("bigint").alias(m) if m in ints
                else rounded(values[m].cast("double"), decimals).alias(m)
                for m in ordered
            ],
        )
        .orderBy(F.col("Corpus") != COMBINED, "Corpus")
    )


def _groups(columns: Sequence[str]) -> list[tuple[int, str, str]]:
    """(group number, group, metric) of the columns that are there; unknown ones come last."""
    have = [c for c in columns if c != "Corpus"]
    listed = [
        (g, name, m) for g, (name, metrics) in enumerate(METRIC_GROUPS) for m in metrics if m in have
    ]
    known = {m for _, _, m in listed}
    return listed + [(len(METRIC_GROUPS), "Other", m) for m in have if m not in known]


def summary_vertical(summary: DataFrame, decimals: int = 3) -> DataFrame:
    """(corpus, corpus_rank, metric_rank, metric_group, metric, value): numbers become text."""
    has_corpus = "Corpus" in summary.columns
    base = summary if has_corpus else summary.withColumn("Corpus", F.lit(""))
    entries = []
    for rank, (_, group, metric) in enumerate(_groups(summary.columns), start=1):
        value = F.col(f"`{metric}`")
        if isinstance(summary.schema[metric].dataType, (T.LongType, T.IntegerType)):
            text = F.format_number(value, 0)
        elif isinstance(summary.schema[metric].dataType, T.StringType):
            text = value
        else:
            text = F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", value))
        entries.append(
            F.struct(
                F.lit(rank).alias("metric_rank"), F.lit(group).alias("metric_group"),
                F.lit(metric).alias("metric"), F.coalesce(text, F.lit("")).alias("value"),
            )
        )
    # One row per source column: a table of this size is ordered in one task.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("corpus") != COMBINED, "corpus")
    return (
        base.select(F.col("Corpus").alias("corpus"), F.explode(F.array(*entries)).alias("e"))
        .select("corpus", F.dense_rank().over(order).alias("corpus_rank"), "e.*")
    )


def _numbered(lines: DataFrame) -> DataFrame:
    order = Window.partitionBy(F.lit(0)).orderBy("section", "corpus_rank", "metric_rank", "part")
    return lines.select((F.row_number().over(order) - 1).cast("bigint").alias("ord"), "line")


def _fixed_lines(df: DataFrame, section: int, lines: Sequence[str]) -> DataFrame:
    rows = [(section, 0, 0, i, line) for i, line in enumerate(lines)]
    return df.sparkSession.createDataFrame(
        rows, "section int, corpus_rank int, metric_rank int, part int, line string"
    )


def summary_markdown_lines(summary: DataFrame, decimals: int = 3) -> DataFrame:
    """(ord, line): the long table as Markdown."""
    has_corpus = "Corpus" in summary.columns
    long = summary_vertical(summary, decimals)
    cells = ["corpus", "metric", "value"] if has_corpus else ["metric", "value"]
    body = long.select(
        F.lit(1).alias("section"), "corpus_rank", "metric_rank", F.lit(0).alias("part"),
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"),
    )
    titles = ["Corpus", "Metric", "Value"] if has_corpus else ["Metric", "Value"]
    rule = "|" + "|".join(":---" for _ in titles[:-1]) + "|---:|"
    return _numbered(body.unionByName(_fixed_lines(summary, 0, [f"| {' | '.join(titles)} |", rule])))


def escape_latex(text: Column) -> Column:
    def escaped(char: Column) -> Column:
        verdict = None
        for plain, code in LATEX_ESCAPES:
            verdict = F.when(char == plain, code) if verdict is None else verdict.when(char == plain, code)
        return verdict.otherwise(char)

    return F.array_join(F.transform(F.split(text, ""), escaped), "")


def summary_latex_lines(summary: DataFrame, decimals: int = 3) -> DataFrame:
    """(ord, line): a tabular with rules between metric groups and between corpora."""
    has_corpus = "Corpus" in summary.columns
    long = summary_vertical(summary, decimals)
    starts = {}
    for rank, (g, _, _) in enumerate(_groups(summary.columns), start=1):
        starts.setdefault(g, rank)
    first_of_group = F.col("metric_rank").isin(*starts.values())
    opening = (F.col("corpus_rank") == 1) & (F.col("metric_rank") == 1)
    cells = ["corpus", "metric", "value"] if has_corpus else ["metric", "value"]
    row = F.concat(
        F.concat_ws(" & ", *[escape_latex(F.col(c)) for c in cells]), F.lit(r" \\")
    )
    rows = F.when(first_of_group & ~opening, F.array(F.lit(r"\hline"), row)).otherwise(F.array(row))
    body = long.select(
        F.lit(1).alias("section"), "corpus_rank", "metric_rank", F.posexplode(rows).alias("part", "line")
    )
    titles = ["Corpus", "Metric", "Value"] if has_corpus else ["Metric", "Value"]
    head = [
        rf"\begin{{tabular}}{{{'l' * len(titles)}}}", r"\hline", " & ".join(titles) + r" \\", r"\hline",
    ]
    lines = body.unionByName(_fixed_lines(summary, 0, head)).unionByName(
        _fixed_lines(summary, 2, [r"\hline", r"\end{tabular}"])
    )
    return _numbered(lines)
