"""Reading, inspecting and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexistat.functions.text import is_usable

TARGET_PREFIX = "target"


def load_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """Parquet by suffix, tab-separated for .tsv, otherwise comma-separated with a header.

    Pass a schema for large text files: inferring one reads the whole file an extra time. A file whose quoted
    fields may hold line ends is read by one task; set multi_line to False to split files that have none.
    """
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".parquet"):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    reader = reader.option("sep", "\t" if lowered.endswith(".tsv") else ",")
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def candidate_text_columns(df: DataFrame) -> DataFrame:
    """(column, is_default, usable_rows): every string column; the first one is the default."""
    names = text_columns(df)
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column string, is_default boolean, usable_rows bigint"
        )
    counted = df.agg(*[F.count_if(is_usable(F.col(c))).alias(c) for c in names])
    return counted.unpivot([], names, "column", "usable_rows").select(
        "column", (F.col("column") == names[0]).alias("is_default"), "usable_rows"
    )


def target_columns(df: DataFrame, text_cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns that may be targets, and the default: the first whose name starts with "target"."""
    names = [c for c in df.columns if c not in set(text_cols)]
    default = [c for c in names if c.lower().startswith(TARGET_PREFIX)][:1]
    return names, default


def dataset_overview(df: DataFrame, text_cols: Sequence[str]) -> DataFrame:
    """One row per chosen text column: rows of the table and usable rows of the column."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(is_usable(F.col(c))).alias(c) for c in text_cols],
    )
    return counted.unpivot(["total_rows"], list(text_cols), "text_column", "usable_rows")


def embeddings_wide(df: DataFrame, meta: Sequence[str], vector: str, dim: int | None = None) -> DataFrame:
    """One column for each number of a vector; the dimension is read from the data if it isn't given."""
    if dim is None:
        low, high = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
        if low != high:
            raise ValueError(f"vectors have {low} to {high} numbers")
        dim = high or 0
    return df.select(*meta, *[F.col(vector)[i].alias(f"e{i + 1}") for i in range(dim)])


def flatten_nested(df: DataFrame) -> DataFrame:
    """Maps, arrays and structs as JSON text, so that a CSV file can hold them."""

    def flat(field: T.StructField) -> Column:
        nested = isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType))
        value = F.col(f"`{field.name}`")
        return F.to_json(value).alias(field.name) if nested else value

    return df.select(*[flat(f) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt in ("csv", "tsv"):
        writer = flatten_nested(df).write.mode(mode).option("header", True).option("escape", '"')
        writer.option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    else:
        raise ValueError("fmt must be one of: parquet, csv, tsv")


def write_text_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write (ord, line) rows as text in the order of `ord`; a report, so one file is enough."""
    df.orderBy("ord").select("line").coalesce(1).write.mode(mode).text(path)
