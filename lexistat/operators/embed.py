"""From texts to vectors, and the tables around them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexistat.functions.text import is_usable
from lexistat.functions.vectors import l2_normalize
from lexistat.operators.textstats import StatsOptions, text_words

Encoder = Callable[[list[str]], np.ndarray]


def embed_text(
    texts: DataFrame,
    encoder: Callable[[], Encoder] | None = None,
    normalize: bool = True,
    dim: int = 256,
    seed: int = 42,
) -> DataFrame:
    """Add one vector per usable text.

    `encoder` is called once per task and returns a function from texts to a matrix, so a model is
    loaded on the workers and not sent to them. Without one, words are hashed (see below).
    """
    usable = texts.where(is_usable(F.col("text")))
    if encoder is None:
        embedded = hashed_text(usable, dim, seed)
    else:

        @F.pandas_udf("array<double>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = encoder()
            for batch in batches:
                yield pd.Series(list(np.asarray(run(batch.tolist()), dtype=np.float64)), index=batch.index)

        embedded = usable.withColumn("embedding", encode("text"))
    if normalize:
        embedded = embedded.withColumn("embedding", l2_normalize(F.col("embedding")))
    return embedded


def word_hash(word: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.lower(word)))


def hash_place(digest: Column, dim: int) -> tuple[Column, Column]:
    """(bucket, sign) of a word from its hash."""
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim
    return bucket, F.when(F.substring(digest, 9, 1) < "8", F.lit(1)).otherwise(F.lit(-1)).cast("bigint")


def hashing_embedding(texts: DataFrame, dim: int = 256, seed: int = 42) -> DataFrame:
    """(source_column, index, bucket, value): signed word counts per bucket, zeros left out."""
    # The outer form keeps the planner from testing every word list below the scan, which would
    # split each text once more.
    hashes = text_words(texts, StatsOptions()).select(
        "source_column", "index", F.explode_outer("words").alias("word")
    ).where("word IS NOT NULL").withColumn("hash", word_hash(F.col("word"), seed))
    bucket, sign = hash_place(F.col("hash"), dim)
    summed = hashes.select("source_column", "index", bucket.alias("bucket"), sign.alias("value"))
    return (
        summed.groupBy("source_column", "index", "bucket").agg(F.sum("value").alias("value"))
        .where("value <> 0")
    )


def hashed_text(texts: DataFrame, dim: int = 256, seed: int = 42) -> DataFrame:
    """The same vector as a dense column, computed inside the row: no shuffle."""
    hashes = F.transform("words", lambda w: word_hash(w, seed))

    @F.pandas_udf("array<double>")
    def dense(column: pd.Series) -> pd.Series:
        def layout(digests: np.ndarray) -> np.ndarray:
            buckets = np.array([int(h[:8], 16) % dim for h in digests], dtype=int)
            signs = np.array([1.0 if h[8] < "8" else -1.0 for h in digests])
            return np.bincount(buckets, weights=signs, minlength=dim)

        return column.map(layout)

    return text_words(texts, StatsOptions()).withColumn("embedding", dense(hashes)).drop("words")


def join_embeddings(texts: DataFrame, embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """Stored vectors on the texts they belong to."""
    stored = embeddings.select(F.col(key).alias("index"), F.col(vector).alias("embedding"))
    return texts.join(stored, "index")


def text_fingerprint(texts: DataFrame) -> list[str]:
    """Rows, and two sums of row hashes, of (source_column, index, text): equal for equal texts in any order."""
    row = F.xxhash64("source_column", "index", "text")
    sums = [F.sum(F.pmod(h, F.lit(2 ** 31 - 1)).cast("decimal(38,0)")) for h in (row, F.xxhash64(row, F.lit(1)))]
    return [str(v) for v in texts.agg(F.count(F.lit(1)), *sums).first()]


def stored_embeddings(
    spark: SparkSession, folder: str, options: Mapping[str, object], build: Callable[[], DataFrame],
    texts: DataFrame | None = None,
) -> DataFrame:
    """Read vectors made with equal options from equal texts, or build and store them first.

    A folder without the mark of a finished write is written anew.
    """
    named = {"options": dict(options), "texts": None if texts is None else text_fingerprint(texts)}
    name = hashlib.md5(json.dumps(named, sort_keys=True, default=str).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/embeddings-{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def mean_pool_by_row(embedded: DataFrame) -> DataFrame:
    """The mean vector over the text columns of each row."""
    vectors = embedded.select("index", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    pooled = vectors.groupBy("index").agg(Summarizer.mean(F.col("v")).alias("v"))
    return pooled.select("index", vector_to_array("v").alias("embedding"))


def select_feature_set(embedded: DataFrame, source: str) -> DataFrame:
    return embedded.where(F.col("source_column") == source).select("index", "embedding")


def require_dimension(df: DataFrame, vector: str = "embedding") -> tuple[int, int]:
    """(rows, dimension); raises unless all vectors have one length."""
    seen = df.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size(vector)).alias("low"),
        F.max(F.size(vector)).alias("high"), F.count(vector).alias("present"),
    ).first()
    if seen["n"] and (seen["present"] < seen["n"] or seen["low"] != seen["high"]):
        raise ValueError("embeddings must be vectors of one length")
    return int(seen["n"]), int(seen["high"] or 0)


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)
