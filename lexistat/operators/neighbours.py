"""Nearest neighbours of every vector, exact or with a measured recall."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexistat.functions.sums import matrix
from lexistat.functions.vectors import as_double, l2_norm, l2_normalize
from lexistat.operators.cells import (
    SLACK,
    assign_cells,
    block_pairs,
    cell_groups,
    distances,
    pick_pivots,
    reachable_groups,
    whole_numbers,
    whole_order,
)
from lexistat.operators.descent import approximate_neighbours
from lexistat.operators.stack import first_rows_of

METRICS = ("cosine", "euclidean", "manhattan")
METHODS = ("exact", "approximate")
GROUPS = 32  # groups of cells that a vector is sent to before groups grow with the rows
LARGEST = 8  # blocks of rows in a group that has grown
PIECE = 2_000_000  # distances that a task holds at once


def distinct_vectors(
    df: DataFrame, key: str, vector: str, metric: str, short: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(points, members): each different vector once, under the smallest key of its copies.

    Copies are found by grouping, so a vector that a third of all rows share costs one row. If `short` is asked for, vectors in
    single precision also stay as they are, with the number that divides them (`norm`).
    """
    value = l2_normalize(F.col(vector)) if metric == "cosine" else as_double(F.col(vector))
    rows = df.select(F.col(key).alias("member"), value.alias("vector"), F.col(vector).alias("short"))
    if not short or df.schema[vector].dataType.elementType != T.FloatType():
        points = rows.groupBy("vector").agg(F.min("member").alias("id")).select("id", "vector").persist()
    else:
        size = l2_norm(F.col("short")) if metric == "cosine" else F.lit(1.0)
        points = rows.groupBy("vector").agg(F.min("member").alias("id"), F.first("short").alias("short")).select(
            "id", "vector", "short", F.when(size > 0, size).otherwise(1.0).alias("norm")
        ).persist()
    return points, rows.select("member", "vector").join(points.select("id", "vector"), "vector").select("id", "member")


def knn_graph(
    df: DataFrame, k: int, key: str, vector: str = "embedding", metric: str = "cosine",
    seed: int = 42, block_rows: int = 4096, method: str = "exact", recall: float = 0.95,
) -> DataFrame:
    """(key, neighbour, place, distance): the k nearest other rows, ties by key.

    The exact search compares a vector with all that the triangle inequality does not rule out, which in many
    dimensions is nearly all: it is meant for small tables. The approximate one refines lists of neighbours until the
    share `recall` of the exact ones of a sample is found; its work grows in proportion to the rows, and every vector
    still gets k neighbours where the table has them.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of: {', '.join(METHODS)}")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of: {', '.join(METRICS)}")
    if k < 1:
        raise ValueError("k must be at least 1")
    points, members = distinct_vectors(df, key, vector, metric, short=method == "approximate")
    n = points.count()
    if n == 0:
        return df.sparkSession.createDataFrame(
            [], f"key {df.schema[key].dataType.simpleString()}, "
            f"neighbour {df.schema[key].dataType.simpleString()}, place int, distance double"
        )
    if method == "approximate":
        near, _ = approximate_neighbours(points, n, k, metric, seed, recall)
    else:
        near = _exact_neighbours(points, n, k, metric, seed, block_rows)
    # Candidates of a point: its own first copies, and the first copies of its neighbours.
    firsts = first_rows_of(members, ["id"], [F.col("member")], k + 1).select(
        F.col("id").alias("other"), F.col("member").alias("neighbour")
    )
    own = points.select("id", F.col("id").alias("other"), F.lit(0.0).alias("distance"))
    candidates = near.unionByName(own).join(firsts, "other")
    best = first_rows_of(
        candidates, ["id"], [F.col("distance"), F.col("neighbour")], k + 1
    ).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("best")
    )
    others = F.slice(F.filter("best", lambda c: c["neighbour"] != F.col("member")), 1, k)
    listed = members.join(best, "id").select(
        F.col("member").alias("key"), F.posexplode(others).alias("at", "c")
    )
    gap = F.col("c.distance")
    return listed.select(
        "key", F.col("c.neighbour").alias("neighbour"), (F.col("at") + 1).alias("place"),
        (gap * gap / 2 if metric == "cosine" else gap).alias("distance"),
    )


def _exact_neighbours(points: DataFrame, n: int, k: int, metric: str, seed: int, block_rows: int) -> DataFrame:
    """(id, other, distance): at least the k nearest other points of each point.

    Cells that lie together form groups, and a vector goes once to each group it can reach. Where it can reach most
    of them, as in many dimensions, groups grow with the rows, so that a vector is sent to a bounded number.
    """
    pivots = pick_pivots(points, n, seed)
    placed = assign_cells(points, pivots, metric).persist()
    reach, rows = _reach(placed, pivots, k, metric)
    group = cell_groups(pivots, rows, block_rows)
    partners = reachable_groups(points, pivots, reach, metric, group)
    largest = min(n // GROUPS, LARGEST * block_rows)
    if largest > block_rows and partners.agg(F.avg(F.size("cells"))).first()[0] > GROUPS:
        block_rows = largest
        group = cell_groups(pivots, rows, block_rows)
        partners = reachable_groups(points, pivots, reach, metric, group)
    homes = placed.sparkSession.createDataFrame(list(enumerate(group.tolist())), "cell int, home int")
    owners = placed.join(F.broadcast(homes), "cell").select("id", "vector", F.col("home").alias("cell"))  # a row per pivot
    return _nearest_in_cells(
        owners, partners.select("id", "vector", F.explode("cells").alias("cell")), k, metric, block_rows
    )


def _reach(placed: DataFrame, pivots: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """How far from each pivot the k nearest points of the points of its cell can lie, and the rows of each cell."""
    radius, rows = np.zeros(len(pivots)), np.zeros(len(pivots), dtype=np.int64)
    for row in placed.groupBy("cell").agg(F.max("gap").alias("far"), F.count(F.lit(1)).alias("rows")).collect():
        radius[row["cell"]], rows[row["cell"]] = row["far"], row["rows"]
    closest = first_rows_of(
        placed.select("cell", "gap"), ["cell"], [F.col("gap")], k + 1
    ).collect()  # at most (k + 1) numbers per pivot
    cell = np.array([r["cell"] for r in closest])
    gap = np.array([r["gap"] for r in closest])
    between = distances(pivots, pivots, metric)
    # No point of cell i is farther than this from its (k + 1)-th nearest point, itself included.
    bound = np.empty(len(pivots))
    for i in range(len(pivots)):
        upper = np.sort(radius[i] + between[i, cell] + gap)
        bound[i] = upper[k] if len(upper) > k else np.inf
    return radius + bound, rows


def _nearest_in_cells(
    owners: DataFrame, partners: DataFrame, k: int, metric: str, block_rows: int
) -> DataFrame:
    def nearest(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        asked, held = matrix(one["vector"]), matrix(two["vector"])
        left, right = one["id"].to_numpy(), two["id"].to_numpy()
        # An id may stand for several vectors: as many places more.
        keep = min(k * int(np.unique(right, return_counts=True)[1].max()), len(right))
        step, parts = max(1, PIECE // len(right)), []
        # Sums of absolute differences are taken in fewer digits first; whatever rounding leaves open is summed anew.
        size = max(np.abs(asked).sum(1).max(), np.abs(held).sum(1).max())
        ways: list[tuple[Callable[[slice], np.ndarray], float]] = [(lambda rows: distances(asked[rows], held, metric), 0.0)]
        if metric == "manhattan" and size < 1e30:
            brief = held.astype(np.float32)
            ways.append((lambda rows: distances(asked[rows].astype(np.float32), brief, metric),
                         2 * size * (asked.shape[1] + 4) * 2.0**-23))
            if (whole := whole_numbers(asked, held)) is not None:
                ways.append((lambda rows: whole_order(whole[0][rows], whole[1]), 2 * asked.shape[1] + 1))

        def closest(rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """All partners up to the k-th distance (and what rounding adds), so that ties are settled by key later."""
            measure, slack = ways[-1]
            gaps = measure(rows)
            far = np.inf if gaps.dtype.kind == "f" else np.iinfo(gaps.dtype).max
            same = np.flatnonzero(np.isin(right, left[rows]))
            at, twin = np.nonzero(left[rows, None] == right[None, same])
            gaps[at, same[twin]] = far
            edge = np.partition(gaps, keep - 1, axis=1)[:, keep - 1].astype(float) + slack
            # Whole numbers are compared as such: an edge of `far` leaves out only `far` itself.
            near = gaps <= (edge if far == np.inf else np.minimum(edge, far - 1).astype(gaps.dtype))[:, None]
            if far == np.inf:
                near &= np.isfinite(gaps)
            row, col = np.divmod(np.flatnonzero(near), len(right))
            return row + rows.start, col, gaps[row, col]

        for top in range(0, len(left), step):
            rows = slice(top, top + step)
            row, col, gap = closest(rows)
            while len(ways) > 1 and len(row) > 16 * keep * step:  # rounding leaves too much open
                ways.pop()
                row, col, gap = closest(rows)
            if len(ways) > 1:
                gap = np.abs(asked[row] - held[col]).sum(1)
                order = np.lexsort((gap, row))
                row, col, gap = row[order], col[order], gap[order]
                last = np.minimum(np.searchsorted(row, row) + keep, np.searchsorted(row, row, "right")) - 1
                near = gap <= gap[last]
                row, col, gap = row[near], col[near], gap[near]
            parts.append(pd.DataFrame({"id": left[row], "other": right[col], "distance": gap}))
        return pd.concat(parts, ignore_index=True)

    kind = owners.schema["id"].dataType.simpleString()
    found = block_pairs(owners, partners, nearest, f"id {kind}, other {kind}, distance double", block_rows)
    window = Window.partitionBy("id").orderBy("distance", "other")
    return (
        found.groupBy("id", "other").agg(F.min("distance").alias("distance")).withColumn("r", F.row_number().over(window)).where(F.col("r") <= k)
        .select("id", "other", "distance")
    )


def neighbour_recall(
    found: DataFrame, df: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding", metric: str = "cosine"
) -> DataFrame:
    """(key, found, hits): for each of `queries` (key), its rows in `found` (a result of knn_graph), and how many are
    no farther than its k-th nearest row of `df`, found by comparing it with all rows.

    The queries' vectors meet all rows in blocks of bounded size, so a task holds one block of each.
    """
    value = l2_normalize(F.col(vector)) if metric == "cosine" else as_double(F.col(vector))
    rows = df.select(F.col(key).alias("id"), value.alias("vector"), F.lit(0).alias("cell"))
    wanted = df.join(queries.select(key), key, "left_semi")
    asked = wanted.select(F.col(key).alias("id"), value.alias("vector"), F.lit(0).alias("cell"))

    def nearest(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        gaps = distances(matrix(one["vector"]), matrix(two["vector"]), metric)
        gaps[one["id"].to_numpy()[:, None] == two["id"].to_numpy()[None, :]] = np.inf
        best = np.partition(gaps, min(k, gaps.shape[1]) - 1, axis=1)[:, :k]
        at, col = np.nonzero(np.isfinite(best))
        return pd.DataFrame({"key": one["id"].to_numpy()[at], "edge": best[at, col]})

    kind = df.schema[key].dataType.simpleString()
    pairs = block_pairs(asked, rows, nearest, f"key {kind}, edge double")
    edge = F.max("edge") * F.max("edge") / 2 if metric == "cosine" else F.max("edge")
    edges = first_rows_of(pairs, ["key"], [F.col("edge")], k).groupBy("key").agg(edge.alias("edge"))
    return edges.join(found, "key", "left").groupBy("key").agg(
        F.count("neighbour").alias("found"), F.count_if(F.col("distance") <= F.col("edge") + SLACK).alias("hits")
    )
