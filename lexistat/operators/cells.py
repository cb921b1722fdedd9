"""Cells around pivot vectors: the partitioning for exact neighbour and radius searches.

Every vector belongs to the cell of its nearest pivot. A search of one cell needs only the vectors
that the triangle inequality cannot rule out, so a vector is sent to few cells. Large cells are cut
into blocks of bounded size on both sides, and a task sees one block of each side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistat.functions.ranks import hash_order
from lexistat.functions.sums import matrix

MAX_PIVOTS = 1024
BLOCK_ROWS = 4096
TILE_ROWS, TILE_COLUMNS = 32, 1024
WHOLE_ROWS, WHOLE_COLUMNS = 64, 2048  # a tile of 16-bit numbers
LEAST_STEPS = 64  # steps over the widest dimension below which whole numbers settle too little
SLACK = 1e-9  # keeps pairs at the bound when a distance is rounded


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Pairwise distances of two blocks; cosine inputs are unit vectors, so euclidean orders them."""
    if metric == "manhattan":
        out, across = np.zeros((len(a), len(b)), a.dtype), np.ascontiguousarray(b.T)
        for top in range(0, len(a), TILE_ROWS):
            rows = a[top:top + TILE_ROWS]
            for left in range(0, len(b), TILE_COLUMNS):  # a tile of the result stays in the cache for all dimensions
                part = out[top:top + TILE_ROWS, left:left + TILE_COLUMNS]
                total, step = np.zeros(part.shape, a.dtype), np.empty(part.shape, a.dtype)
                for d in range(a.shape[1]):
                    np.subtract(rows[:, d, None], across[d, left:left + TILE_COLUMNS], out=step)
                    np.abs(step, out=step)
                    total += step
                part[:] = total
        return out
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def whole_numbers(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Both blocks in equal steps from 0, so few that a sum over all dimensions has 16 bits; None if steps are too coarse.

    A difference of two numbers is off by at most one step, so manhattan distances are by at most one for each dimension.
    """
    most = 65_535 // max(1, a.shape[1])
    if not LEAST_STEPS <= most < 65_535:
        return None
    low = np.minimum(a.min(0), b.min(0))
    step = (np.maximum(a.max(0), b.max(0)) - low).max() / most
    if not 1e-300 < step < np.inf:
        return None
    return np.rint((a - low) / step).astype(np.uint16), np.rint((b - low) / step).astype(np.uint16)


def whole_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distances of whole numbers, less a number for each row: |x - y| is x + y less twice the smaller one."""
    out, across = np.empty((len(a), len(b)), np.int32), np.ascontiguousarray(b.T)
    sums = b.sum(1, dtype=np.int32)
    for top in range(0, len(a), WHOLE_ROWS):
        rows = a[top:top + WHOLE_ROWS]
        for left in range(0, len(b), WHOLE_COLUMNS):
            part = out[top:top + WHOLE_ROWS, left:left + WHOLE_COLUMNS]
            total, step = np.zeros(part.shape, np.uint16), np.empty(part.shape, np.uint16)
            for d in range(a.shape[1]):
                np.minimum(rows[:, d, None], across[d, left:left + WHOLE_COLUMNS], out=step)
                total += step
            np.subtract(sums[left:left + WHOLE_COLUMNS], np.multiply(total, 2, dtype=np.int32), out=part)
    return out


def pick_pivots(points: DataFrame, n: int, seed: int = 42, most: int = MAX_PIVOTS) -> np.ndarray:
    """About the square root of n vectors, at most `most`, in hash order of their ids."""
    m = max(1, min(most, math.isqrt(n)))
    rows = points.orderBy(hash_order(seed, F.col("id"))).limit(m).select("vector").collect()
    return np.array([r["vector"] for r in rows], dtype=np.float64)


def assign_cells(points: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """Add the nearest pivot and the distance to it."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                gap = distances(matrix(batch["vector"]), pivots, metric)
                cell = gap.argmin(axis=1)
                yield batch.assign(cell=cell, gap=gap[np.arange(len(batch)), cell])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(assign, f"{schema}, cell int, gap double")


def cell_groups(pivots: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """The group of each cell: cells that lie together, up to about `most` rows; a larger cell is a group of its own."""
    group, number, open_ = np.zeros(len(pivots), dtype=np.int64), 0, [np.arange(len(pivots))]
    while open_:
        at = open_.pop()
        if len(at) == 1 or rows[at].sum() <= most:
            group[at] = number
            number += 1
            continue
        axis = int(np.ptp(pivots[at], axis=0).argmax())
        at = at[np.argsort(pivots[at, axis], kind="stable")]
        ends = np.cumsum(rows[at])
        cut = min(max(1, int(np.searchsorted(ends, ends[-1] / 2, "right"))), len(at) - 1)
        open_ += [at[cut:], at[:cut]]
    return group


def reachable_groups(points: DataFrame, pivots: np.ndarray, reach: np.ndarray, metric: str, group: np.ndarray) -> DataFrame:
    """Add `cells`: the groups with a cell i where distance(vector, pivot i) <= reach[i]. A vector stays one row."""
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = distances(matrix(batch["vector"]), pivots, metric) <= reach[None, :] + SLACK
                held = np.logical_or.reduceat(near[:, order], starts, axis=1)
                yield batch.assign(cells=[np.flatnonzero(row).astype(np.int32) for row in held])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(emit, f"{schema}, cells array<int>")


def block_pairs(
    left: DataFrame, right: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run `work` on every pair of blocks of each cell; both sides have `id` and `cell`."""
    spark = left.sparkSession
    left_n = dict(left.groupBy("cell").count().collect())
    right_n = dict(right.groupBy("cell").count().collect())
    cells = sorted(set(left_n) & set(right_n))
    if not cells:
        return spark.createDataFrame([], schema)
    plan = F.broadcast(spark.createDataFrame(
        [(c, -(-left_n[c] // block_rows), -(-right_n[c] // block_rows)) for c in cells],
        "cell int, left_blocks bigint, right_blocks bigint",
    ))  # at most MAX_PIVOTS rows

    def cut(df: DataFrame, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        return (
            df.join(plan, "cell")
            .withColumn(own_name, F.pmod(F.xxhash64("id"), F.col(own)))
            .withColumn(other_name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
            .drop("left_blocks", "right_blocks")
        )

    rows = cut(left, "left_blocks", "right_blocks", "a", "b").groupBy("cell", "a", "b")
    partners = cut(right, "right_blocks", "left_blocks", "b", "a").groupBy("cell", "a", "b")

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame()
        return work(one, two)

    return rows.cogroup(partners).applyInPandas(run, schema)
