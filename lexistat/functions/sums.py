"""Sums of dense arrays over a whole table: numpy inside the tasks, merged by Spark in two levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark import TaskContext
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Accumulate = Callable[[pd.DataFrame], np.ndarray]
MERGE_SALTS = 32


def table_sums(df: DataFrame, accumulate: Accumulate) -> np.ndarray:
    """Sum of `accumulate(batch)` over all batches; every batch gives an array of one fixed shape.

    Each task sends its own sum once, row by row; Spark adds the rows, first inside salted groups,
    so no task receives the sums of all others. The result has the size of one such array.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            part = np.asarray(accumulate(batch), dtype=np.float64)
            total = part if total is None else total + part
        if total is not None:
            rows = total.reshape(total.shape[0], -1)
            salt = TaskContext.get().partitionId() % MERGE_SALTS
            yield pd.DataFrame(
                {"slot": np.arange(len(rows)), "salt": salt, "part": list(rows),
                 "shape": [list(total.shape)] * len(rows)}
            )

    parts = df.mapInPandas(partial, "slot int, salt int, part array<double>, shape array<int>")
    vectors = parts.select("slot", "salt", "shape", array_to_vector("part").alias("part"))
    if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) > MERGE_SALTS:
        vectors = vectors.groupBy("slot", "salt", "shape").agg(Summarizer.sum(F.col("part")).alias("part"))
    merged = vectors.groupBy("slot", "shape").agg(
        vector_to_array(Summarizer.sum(F.col("part"))).alias("part")
    ).toArrow()
    if not merged.num_rows:
        raise ValueError("no rows to add up")
    merged = merged.sort_by("slot").combine_chunks()
    shape = merged["shape"][0].as_py()
    return merged["part"].combine_chunks().flatten().to_numpy().reshape(shape)


def matrix(column: pd.Series) -> np.ndarray:
    """A batch of ARRAY cells as one float64 matrix."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in column.to_numpy()])


def arrow_matrix(column: pa.Array) -> np.ndarray:
    """An Arrow batch of ARRAY cells as one float64 matrix, without an object for each row."""
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if not sizes:
        return np.zeros((0, 0))
    if len(sizes) > 1 or sizes[0] is None:
        raise ValueError("vectors must have one length and must not be null")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), sizes[0])
