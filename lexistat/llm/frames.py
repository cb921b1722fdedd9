"""Small helpers for frames: free column names, row identity, tables written between steps."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexistat.functions.session import checkpoint_folder

SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have yet (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def col(name: str) -> Column:
    """A column whose name may hold dots or other signs."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    """The words of a text, unchanged: runs without space, tab, line feed, vertical tab, form feed, return."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def settle(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet to the shared checkpoint folder and read it back: a lineage cut that any
    executor can read again. The files go when the driver ends."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs inside sends at most `most` rows to a Python worker at once; the session's own number comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), most) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder of the cluster; what is written there goes when the driver ends."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a settled table by Hadoop's file system, wherever it lies."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be closed already; the folder then stays for its owner to clear
        return
