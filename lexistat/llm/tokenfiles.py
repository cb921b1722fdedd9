"""Token ids in Parquet files: one list column, dictionary encoded, in ascending order of the document id.

Row groups and pages have set sizes and the files carry page indexes, so a reader of some documents fetches the
pages that hold them, and a reader of the layout (ids and lengths) never touches the tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexistat.llm.frames import col
from lexistat.llm.tokens import worker_encoder
from lexistat.llm.words import batches

END_ID = 0
ROW_GROUP_BYTES = 16 * 1024 * 1024
PAGE_BYTES = 64 * 1024
FIELDS = "doc_id bigint, part int, place bigint, n_tokens bigint, tokens array<int>"


def write_tokens(
    docs: DataFrame, vocabulary: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
    partitions: int | None = None,
) -> None:
    """Encode every text (null: empty), append the end id, and write the files in ascending order of doc_id.

    Each partition holds a range of ids. Rows with equal ids lie side by side, ordered by their text; rows
    without an id come first. An empty table writes files without rows.
    """
    slim = docs.select(col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    count = partitions or max(slim.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, place = worker_encoder(vocabulary), TaskContext.get().partitionId(), 0
        for part in batches(parts, "text"):
            ids, first = encoder.encode(part.column("text"))
            n = part.num_rows
            full = np.insert(ids.astype(np.int32), first[1:], end_id)
            ends = first + np.arange(n + 1)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(np.full(n, number, np.int32)), pa.array(np.arange(place, place + n)),
                pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(full)),
            ], ["doc_id", "part", "place", "n_tokens", "tokens"])
            place += n

    rows = slim.repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, FIELDS)
    (
        rows.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES).option("parquet.enable.dictionary", "true").parquet(path)
    )


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, place, n_tokens; the token column is not read."""
    return spark.read.schema(FIELDS).parquet(path).select("doc_id", "part", "place", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id and tokens of the documents from id `first` to id `last`; the filter reaches row groups and pages."""
    rows = spark.read.schema(FIELDS).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select("doc_id", "part", "place", "tokens")


def checksum(rows: DataFrame) -> DataFrame:
    """Replace the token column by its length and the crc32 of its ids as little-endian unsigned 32-bit numbers."""

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column("tokens")
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<i4"), lists.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([
                *(part.column(c) for c in ("doc_id", "part", "place")), pc.list_value_length(lists).cast(pa.int64()),
                pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends, ends[1:])], pa.int64()),
            ], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(digest, "doc_id bigint, part int, place bigint, n_tokens bigint, ids_crc32 bigint")


def token_index(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """Add `start`, the number of ids before each document: running sums inside a part, and the sums of the parts
    before from the layout, which is read without the tokens."""
    parts = layout.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    before = parts.select(
        F.col("part").alias("_part"),  # one row for each file
        F.coalesce(F.sum("_all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return summed.join(before, F.col("part") == F.col("_part")).withColumn(
        "start", F.col("start") + F.col("_before")
    ).drop("_part", "_before")
