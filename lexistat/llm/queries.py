"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexistat.llm import chat, decontaminate, extraction, jaccard, lmscore, packing, quality, search, secrets, sharding, substrings, tokenfiles, trie
from lexistat.llm.frames import shared_path
from lexistat.llm.tokens import vocabulary_path
from lexistat.plans.inputs import table

SHARDS = 8


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeat_digests(table(spark, folder, "documents").select("doc_id", "text"))


def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema)
    return chat.conversation_digests(rows.unionByName(added))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"))


def op4_token_output(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents").select("doc_id", "text"), shared_path(spark, "tokens")
    tokenfiles.write_tokens(docs, vocabulary_path("byte_bpe_50k.json"), path)
    read = tokenfiles.checksum(tokenfiles.read_tokens(spark, path))
    return tokenfiles.token_index(read, tokenfiles.read_layout(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    placed = sharding.shard_layout(docs, SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leak_rows(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    scored = lmscore.score_documents(table(spark, folder, "documents"))
    return scored.withColumn("log_score", F.round("log_score", 4))


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract_pages(table(spark, folder, "pages"))


def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, folder, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    judged, verdict = quality.quality_rules(docs)
    return judged.select("doc_id", f"{verdict}.*")


def op11_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_digests(table(spark, folder, "documents").select("doc_id", "text", "source"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuild(trie.conversation_records(table(spark, folder, "conversations"))))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return search.ranked_search(docs, table(spark, folder, "benchmark").select("item_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_substring_dedup, op2_chat_formatting, op3_best_fit_packing, op4_token_output, op5_sharding,
        op6_decontamination, op7_lm_scoring, op8_html_extraction, op9_ngram_jaccard, op10_quality_rules,
        op11_secret_scans, op12_prefix_trie, op13_ranked_search,
    )
}
