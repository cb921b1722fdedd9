"""Column expressions on ARRAY<FLOAT|DOUBLE> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero. The norm is found once per vector, not per element."""
    values = as_double(v)
    return F.aggregate(
        values, F.lit(0.0), lambda acc, x: acc + x * x,
        lambda acc: F.when(acc > 0, F.transform(values, lambda x: x / F.sqrt(acc))).otherwise(values),
    )
