"""The per-text statistics on a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexistat.operators.stack import long_text
from lexistat.operators.textstats import StatsOptions, text_row_stats


def read_texts(spark: SparkSession, folder: str, schema: StructType, key: str, text: str, source: str) -> DataFrame:
    """Stacked texts from parquet files as they arrive."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return long_text(rows, F.col(key), text, source)


def write_row_stats(
    texts: DataFrame, path: str, checkpoint: str, options: StatsOptions = StatsOptions()
) -> StreamingQuery:
    """Append the statistics of new texts; no state is kept, because each row stands for itself."""
    return (
        text_row_stats(texts, options).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
