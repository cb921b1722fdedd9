"""From raw documents to packed sequences: the stages of a training-data pipeline, each on all its predecessor kept.

Every stage but the last returns the columns of its input. Rows are never sampled or capped. Nulls, empty texts,
repeated rows and extra columns follow the rules of the operator that a stage calls; rows without a doc_id are
never taken for duplicates, and an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexistat.llm import decontaminate, jaccard, packing, quality, substrings
from lexistat.llm.frames import col, free_name, settle
from lexistat.llm.tokens import vocabulary_path
from lexistat.plans.inputs import table

# Edit distances, minimum-bin-slack plans and tokenizers have no SQL form; tests/llm/test_pipeline.py holds the rows
# of every stage against plain Python instead.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    judged, verdict = quality.quality_rules(docs)
    # Written first: a filter on the verdict would otherwise be pushed below the counts and repeat them.
    judged = settle(judged)
    return judged.where(col(verdict)["kept"]).select(*[col(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets, the one with the smallest doc_id.

    Rows with that doc_id and different texts all stay. Of rows with equal doc_id and text, the first by their other
    columns stays, so a task that runs twice keeps the same rows.
    """
    groups = jaccard.similar_groups(docs)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    # The ids kept grow with the documents: they are merged, never broadcast.
    known = docs.where("doc_id is not null").join(first.hint("merge"), "doc_id", "left_semi")
    others = [
        F.to_json(F.struct(col(f.name))) if any(x in f.dataType.simpleString() for x in ("map<", "variant")) else col(f.name)
        for f in docs.schema.fields if f.name not in ("doc_id", "text")
    ]
    number = free_name(docs, "_number")
    same = Window.partitionBy("doc_id", "text").orderBy(*others or [F.lit(0)])
    known = known.withColumn(number, F.row_number().over(same)).where(col(number) == 1)
    columns = [col(c) for c in docs.columns]
    return known.select(*columns).union(docs.where("doc_id is null").select(*columns))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds; n_chars follows the text."""
    made = substrings.strip_repeats(docs)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.remove_leaking(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_jaccard", keep_one_of_each_group),
    ("substring_dedup", remove_repeats),
    ("decontamination", remove_leaks),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
