"""The core relation (source_column, index, text), joins on its key, and display helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexistat.functions.ranks import quoted
from lexistat.functions.text import is_usable

UNNAMED = "<unnamed>"
KEYS = ("source_column", "index")
TOPIC_COLUMNS = ("topic_id", "topic_label", "topic_probability", "is_outlier")


def stack_text(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Text columns below each other in one scan; null and blank cells are dropped."""
    for c in cols:
        if not isinstance(df.schema[c].dataType, T.StringType):
            raise ValueError(f"column {c!r} must hold text")
    long = df.select(F.col(key).alias("index"), *cols).unpivot(
        ["index"], list(cols), "source_column", "text"
    )
    return long.where(is_usable(F.col("text"))).select("source_column", "index", "text")


def long_text(
    df: DataFrame, key: Column, text: str, source: str | Column | None = None
) -> DataFrame:
    """The core relation from a table that already holds one text per row."""
    named = F.lit(UNNAMED) if source is None else source if isinstance(source, Column) else F.col(source)
    return df.select(
        F.coalesce(named, F.lit(UNNAMED)).alias("source_column"), key.alias("index"),
        F.col(text).alias("text"),
    ).where(is_usable(F.col("text")))


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, or an error while running when a key repeats."""
    repeated = df.groupBy(*keys).count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError(f"rows must be unique by {', '.join(keys)}")
    return df


def align_features_targets(
    features: DataFrame, targets: DataFrame, key: str, target: str,
    groups: DataFrame | None = None, group: str | None = None,
) -> DataFrame:
    """Rows with features, a target and (when groups are given) a group."""
    missing = F.col(target).isNull()
    if isinstance(targets.schema[target].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(target)
    aligned = features.join(targets.select(key, target).where(~missing), key)
    if groups is None:
        return aligned
    return aligned.join(groups.select(key, group).where(F.col(group).isNotNull()), key)


def attach_stat(plot: DataFrame, stats: DataFrame, metric: str, name: str | None = None) -> DataFrame:
    """Left join of one statistic by (source_column, index); repeated keys are averaged first."""
    keys = ["source_column", "index"]
    one = stats.groupBy(*keys).agg(F.avg(metric).alias(name or f"Stats: {metric}"))
    return plot.join(one, keys, "left")


def attach_column(plot: DataFrame, df: DataFrame, key: str, column: str, order_by: str) -> DataFrame:
    """Left join of one column by index; of repeated keys the first non-null value counts."""
    first = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(key).alias("index"))
        .agg(F.min_by(column, order_by).alias(column))
    )
    return plot.join(first, "index", "left")


def resolve_color_mode(df: DataFrame, column: str, mode: str = "Auto") -> DataFrame:
    """Add color_number, color_label and color_mode (categorical or continuous)."""
    value = F.col(column)
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    number = value.cast("double") if numeric else F.expr(f"try_cast(`{column}` AS DOUBLE)")
    if mode == "Categorical" or (mode == "Auto" and not numeric):
        return _colored(df, F.lit(None).cast("double"), value.cast("string"), "categorical")
    if mode not in ("Auto", "Continuous"):
        raise ValueError("mode must be one of: Auto, Categorical, Continuous")
    if numeric or not df.select(number.alias("x")).where("x IS NOT NULL").isEmpty():
        return _colored(df, number, F.lit(None).cast("string"), "continuous")
    return _colored(df, F.lit(None).cast("double"), value.cast("string"), "categorical")


def _colored(df: DataFrame, number: Column, label: Column, mode: str) -> DataFrame:
    return df.withColumns(
        {"color_number": number, "color_label": label, "color_mode": F.lit(mode)}
    )


def _join_partners(plot: DataFrame, assignments: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys, a missing one being equal to a missing one; those of `assignments` get a leading underscore."""
    partners = assignments.withColumnsRenamed({c: f"_{c}" for c in keys})
    return plot.join(partners, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]), how)


def alignment_errors(plot: DataFrame, assignments: DataFrame) -> DataFrame:
    """Rows of either table without an equal (source_column, index, text) in the other; null equals null."""
    left = plot.select("source_column", "index", F.col("text").alias("plot_text"), F.lit(1).alias("in_plot"))
    right = assignments.select(
        "source_column", "index", F.col("text").alias("assigned_text"), F.lit(1).alias("in_assigned")
    )
    both = _join_partners(left, right, KEYS, "full_outer")
    return both.where(
        "in_plot IS NULL OR in_assigned IS NULL OR NOT (plot_text <=> assigned_text)"
    ).select(
        *[F.coalesce(c, f"_{c}").alias(c) for c in KEYS],
        F.when(F.col("in_plot").isNull(), "missing in plot")
        .when(F.col("in_assigned").isNull(), "missing in assignments")
        .otherwise("text differs").alias("problem"),
    )


def merge_topic_assignments(plot: DataFrame, assignments: DataFrame, check: bool = True) -> DataFrame:
    """Topic columns on the projection rows; every row must have its partner, of rows with one key the one with its text."""
    for c in TOPIC_COLUMNS:
        if c not in assignments.columns:
            raise ValueError(f"assignments are missing required column '{c}'")
    keys = KEYS
    if check:
        wrong = alignment_errors(plot, assignments).limit(1).collect()
        if wrong:
            keys = (*KEYS, "text")
            one, two = plot.select(*keys, F.lit(1).alias("in_plot")), assignments.select(*keys, F.lit(1).alias("in_assigned"))
            alone = _join_partners(one, two, keys, "full_outer").where("in_plot IS NULL OR in_assigned IS NULL")
            if not alone.isEmpty():
                raise ValueError(f"plot and assignments must align: {wrong[0]['problem']}")
    topics = assignments.select(*keys, *TOPIC_COLUMNS)
    rest = plot.drop(*KEYS).columns
    ordered = plot.select(*KEYS, *[F.col(quoted(c)) for c in rest])
    return _join_partners(ordered, topics, keys, "inner").drop(*[f"_{c}" for c in keys])


def union_results(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def drop_all_null_columns(df: DataFrame, optional: Sequence[str]) -> DataFrame:
    """For display: leave out optional columns that hold nothing."""
    present = [c for c in optional if c in df.columns]
    if not present:
        return df
    counts = df.agg(*[F.count(c).alias(c) for c in present]).first()
    return df.drop(*[c for c in present if counts[c] == 0])


def color_options(
    df: DataFrame, text_cols: Sequence[str], stats: DataFrame | None = None, has_topics: bool = False
) -> list[tuple[str, str]]:
    """(option, kind) pairs, from the schemas only."""
    options = [("source_column", "categorical")]
    if has_topics:
        options += [("topic_label", "categorical"), ("topic_id", "continuous"), ("is_outlier", "categorical")]
    for field in df.schema.fields:
        if field.name not in text_cols:
            number = isinstance(field.dataType, T.NumericType)
            options.append((field.name, "continuous" if number else "categorical"))
    for field in stats.schema.fields if stats is not None else []:
        if isinstance(field.dataType, T.NumericType) and field.name not in ("index",):
            options.append((f"Stats: {field.name}", "continuous"))
    return options + [("None", "none")]


def first_rows_of(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits each task's rows before the shuffle."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n)
