"""Quality rules from the lines that documents of one host share (DataFrame functions only).

Lines are normalised (lower case, runs of white space as one space, trimmed) and hashed. For each host and
line, the distinct documents that hold it are counted; documents with the same normalised lines in the same
order are copies and count once. Lines above the limit are removed, and a document that has lost most of its
words by that is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexistat.llm.frames import SPACES, col, free_name, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_HOLDERS = 20
MAX_SHARE_PERCENT = 2
MAX_LOST_PERCENT = 70
WINDOW = 5


def line_words(line: Column) -> Column:
    return F.size(words_of(line)).cast("bigint")


def repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add the number of words inside 5-word windows that occur twice or more in the same text.

    Window hashes are compared as an array without repeats first, so only texts with a repeat are sorted.
    """
    h, w, s, p = (free_name(df, x) for x in ("_word_hashes", "_windows", "_sorted", "_places"))
    n = F.size(col(words))
    last = F.size(col(w)) - 1
    hashed = df.withColumn(h, F.transform(col(words), lambda x: F.xxhash64(x)))
    windows = hashed.withColumn(w, F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(col(h), i + k) for k in range(WINDOW)])
    ))).drop(h)
    ordered = windows.withColumn(s, F.when(
        F.size(F.array_distinct(col(w))) < F.size(col(w)),
        F.sort_array(F.transform(col(w), lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
    ))
    twice = ordered.withColumn(p, F.sort_array(F.transform(F.filter(
        col(s), lambda e, i: ((i > 0) & (F.get(col(s), i - 1)["x"] == e["x"]))
        | ((i < last) & (F.get(col(s), i + 1)["x"] == e["x"])),
    ), lambda e: e["i"])))
    covered = F.aggregate(
        col(p), F.struct(F.lit(-WINDOW).alias("end"), F.lit(0).cast("bigint").alias("sum")),
        lambda a, i: F.struct(
            (i + WINDOW).alias("end"),
            (a["sum"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"]).cast("bigint")).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return twice.withColumn(out, F.coalesce(covered, F.lit(0).cast("bigint"))).drop(w, s, p)


def base_counts(df: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    """Add the counts of each text: words, their code points, symbols, repeated lines, repeated words."""
    t = F.coalesce(col(text), F.lit(""))
    words, lines = free_name(df, "_words"), free_name(df, "_lines")
    made = df.withColumn(words, words_of(col(text))).withColumn(
        lines, F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD_IN))
    )
    made = repeated_words(made, words, names["n_repeat_words"])
    long = "bigint"
    made = made.withColumns({
        names["n_words"]: F.size(col(words)).cast(long),
        names["word_chars"]: F.length(F.translate(t, SPACES, "")).cast(long),
        names["n_symbols"]: (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast(long),
        names["n_dup_lines"]: (F.size(col(lines)) - F.size(F.array_distinct(col(lines)))).cast(long),
    })
    return made.drop(words, lines)


WORD_IN = r"[^\x20\x09-\x0D]"


def shared_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    min_holders: int = MIN_HOLDERS, max_share_percent: int = MAX_SHARE_PERCENT,
) -> tuple[DataFrame, DataFrame]:
    """(lines, frequent): every line of every document, and the lines above the limit of their host.

    lines: doc, mark (md5 of the text), host, place, line (md5), words. frequent: host, line, holders, where
    holders > min_holders and 100 * holders > max_share_percent * documents of the host. Both count documents
    without copies: those with the same lines in the same order are one. A null host is a host of its own; a
    null text has no lines.
    """
    t = F.coalesce(col(text), F.lit(""))
    rows = docs.select(
        col(doc_id).alias("doc"), F.md5(t.cast("binary")).alias("mark"), col(host).alias("host"),
        F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.trim(F.regexp_replace(
            F.lower(x), r"[\x20\x09-\x0D]+", " "))), lambda x: x != "").alias("texts"),
    ).withColumn("hashes", F.transform("texts", lambda x: F.md5(x.cast("binary"))))
    rows = rows.withColumn("copy", F.md5(F.array_join("hashes", "").cast("binary")))
    lines = rows.select(
        "doc", "mark", "host", "copy",
        F.posexplode(F.arrays_zip(F.col("hashes").alias("line"), F.col("texts").alias("text"))).alias("place", "at"),
    ).select(
        "doc", "mark", "host", "place", F.col("at.line").alias("line"), line_words(F.col("at.text")).alias("words"), "copy",
    )
    holders = lines.select("host", "line", "copy").distinct().groupBy("host", "line").agg(
        F.count(F.lit(1)).alias("holders")
    ).where(F.col("holders") > min_holders)
    sizes = rows.select(F.col("host").alias("its_host"), "copy").distinct().groupBy("its_host").agg(
        F.count(F.lit(1)).alias("documents"))
    frequent = holders.join(sizes, F.col("host").eqNullSafe(F.col("its_host"))).where(
        F.col("holders") * 100 > F.col("documents") * max_share_percent
    ).select("host", "line", "holders")
    return lines, frequent


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", out: str = "quality",
    min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, min_holders: int = MIN_HOLDERS,
    max_share_percent: int = MAX_SHARE_PERCENT, max_lost_percent: int = MAX_LOST_PERCENT,
) -> tuple[DataFrame, str]:
    """The rows of `docs` with one more column, a struct of counts and the verdict; and that column's name.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_shared_words (words in removed
    lines), base_failed (fewer than min_words words, or over max_repeat_percent of them in repeated windows),
    depleted (over max_lost_percent of the words removed), kept. A null or empty text has no words and fails.
    Repeated rows each keep their row and get the same verdict. An empty table gives an empty table. The name
    of the new column gets underscores until it is free, so columns of the input never clash.
    """
    lines, frequent = shared_lines(docs, doc_id, text, host, min_holders, max_share_percent)
    hit = lines.alias("l").join(
        frequent.alias("f"),
        F.col("l.host").eqNullSafe(F.col("f.host")) & (F.col("l.line") == F.col("f.line")), "left_semi",
    )
    lost = hit.dropDuplicates(["doc", "mark", "host", "place"]).groupBy("doc", "mark", "host").agg(
        F.sum("words").alias("lost")
    )
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    names = {f: free_name(docs, f"_{f}") for f in fields}
    mark, out = free_name(docs, "_mark"), free_name(docs, out)
    counted = base_counts(docs, text, names).withColumn(mark, F.md5(F.coalesce(col(text), F.lit("")).cast("binary")))
    gone = lost.select(*[F.col(c).alias(f"_lost_{c}") for c in ("doc", "mark", "host", "lost")])
    gone_names = {c: free_name(docs, f"_lost_{c}") for c in ("doc", "mark", "host", "lost")}
    gone = gone.toDF(*gone_names.values())
    joined = counted.join(
        gone.hint("merge"),  # grows with the documents
        col(doc_id).eqNullSafe(col(gone_names["doc"])) & (col(mark) == col(gone_names["mark"]))
        & col(host).eqNullSafe(col(gone_names["host"])), "left",
    )
    n, repeats = col(names["n_words"]), col(names["n_repeat_words"])
    shared = F.coalesce(col(gone_names["lost"]), F.lit(0).cast("bigint"))
    failed = (n < min_words) | (repeats * 100 > n * max_repeat_percent)
    depleted = shared * 100 > n * max_lost_percent
    verdict = F.struct(
        *[col(names[f]).alias(f) for f in fields], shared.alias("n_shared_words"), failed.alias("base_failed"),
        depleted.alias("depleted"), (~failed & ~depleted).alias("kept"),
    )
    return joined.select(*[col(c) for c in docs.columns], verdict.alias(out)), out
