"""Column expressions for words, sentences and text cleaning. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word: letters, marks and digits, with inner apostrophes.
WORD_PATTERN = r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}]+)*"
ALPHA_PATTERN = r"^\p{L}+$"
# Any character that is neither white space nor a separator (a no-break space is a separator).
VISIBLE_PATTERN = r"[^\s\p{Z}]"
SENTENCE_END_PATTERN = r"([.!?]+[\"')\]]*)(\s+|$)"
SENTENCE_MARK = "\u0001"


def is_usable(text: Column) -> Column:
    """True when a text is present and holds at least one visible character."""
    return text.isNotNull() & text.rlike(VISIBLE_PATTERN)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def keep_words(
    tokens: Column,
    words_must_be_alpha: bool = True,
    stop_words: Sequence[str] | None = None,
) -> Column:
    """Tokens that count as words; stop words are compared in lower case."""
    tests = []
    if words_must_be_alpha:
        tests.append(lambda t: t.rlike(ALPHA_PATTERN))
    if stop_words:
        tests.append(lambda t: ~F.lower(t).isin(*[w.lower() for w in stop_words]))
    if not tests:
        return tokens

    def passes(token: Column) -> Column:
        verdict = tests[0](token)
        for test in tests[1:]:
            verdict = verdict & test(token)
        return verdict

    return F.filter(tokens, passes)


def split_sentences(text: Column) -> Column:
    marked = F.regexp_replace(text, SENTENCE_END_PATTERN, "$1" + SENTENCE_MARK)
    return F.filter(F.split(marked, SENTENCE_MARK), lambda s: s.rlike(VISIBLE_PATTERN))


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom.cast("double"))


def total_length(words: Column) -> Column:
    """Characters over all words, as a long: exact, so means agree whatever the order of the sum."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, w: acc + F.length(w))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, "[\r\n]", " ")


def shorten(text: Column, width: int = 160) -> Column:
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))
    ).otherwise(text)


def wrap_hover_text(text: Column, width: int = 70) -> Column:
    """Break a text into lines of at most `width` characters joined by <br>; null becomes empty.

    A word longer than a line is cut at the line width.
    """
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", " ")
    broken = F.regexp_replace(flat, "(.{1,%d})( +|$)|(.{%d})" % (width, width), "$1$3<br>")
    return F.regexp_replace(broken, "(<br>)+$", "")


def strip_accents(text: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(F.regexp_replace(text, r"\p{M}", ""), ACCENTED, PLAIN)


# Accented Latin letters and the plain letter each one stands for, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīńňōőřśşšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeginnoorssstuuuzzz"
