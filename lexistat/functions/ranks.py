"""Exact row numbers without moving a whole group into one task.

`row_number() over (partition by group order by hash)` sends every row of a group to one task. The
functions here split each group by the leading hash digits first: rows are numbered inside
(group, slice), and the rows in the slices before are added from a table of slice counts. The result
is the same number, but no task holds more than one slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_DIGITS = 3  # 16 ** 3 = 4,096 slices of each group


def hash_order(seed: object, *keys: Column) -> Column:
    """The md5 text of seed:key:...; its order is the only source of randomness in the library."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def quoted(name: str) -> str:
    """A column name that may hold dots."""
    return "`" + name.replace("`", "``") + "`"


def number_by_hash(
    df: DataFrame,
    order_hash: str,
    tie_break: Sequence[str],
    groups: Sequence[str] = (),
    name: str = "rank",
    slice_digits: int = SLICE_DIGITS,
) -> DataFrame:
    """Add a 1-based row number per group in the order of a hash column, then of `tie_break`."""
    sliced = df.withColumn("_slice", F.substring(F.col(order_hash), 1, slice_digits))
    counts = sliced.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn(
        "_before",
        F.coalesce(
            F.sum("_n").over(
                Window.partitionBy(*groups)
                .orderBy("_slice")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).drop("_n")
    inside = Window.partitionBy(*groups, "_slice").orderBy(order_hash, *tie_break)
    numbered = sliced.withColumn("_inside", F.row_number().over(inside))
    if not groups and slice_digits <= SLICE_DIGITS:
        before = F.broadcast(before)  # one row per slice: at most 16 ** slice_digits
    nullable = {f.name for f in df.schema.fields if f.nullable}
    on = [
        numbered[quoted(g)].eqNullSafe(before[quoted(g)]) if g in nullable
        else numbered[quoted(g)] == before[quoted(g)]
        for g in (*groups, "_slice")
    ]
    joined = numbered.join(before, reduce(lambda a, b: a & b, on), "inner")
    kept = [numbered[quoted(c)] for c in df.columns]
    return joined.select(*kept, (F.col("_inside") + F.col("_before")).cast("bigint").alias(name))
