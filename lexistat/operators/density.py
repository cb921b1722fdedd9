"""Density clusters: connected groups of dense points at every distance, chosen by stability.

Two rows are as far apart as the largest of their distance and of their core distances (to the `min_samples`
nearest other row). Links by rising distance give a tree of groups; those of at least `min_cluster_size` rows are
clusters, and the branches with the greatest excess of mass are taken. Rows outside every chosen cluster are noise.

Only links of minimum spanning forests are written. Points lie in cells around pivots; a pair of cells is compared
only if some link between them can be lighter than the way over the pivots, and a pair of blocks sends one forest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexistat.functions.session import cut_lineage
from lexistat.functions.sums import matrix
from lexistat.operators.cells import MAX_PIVOTS, SLACK, assign_cells, block_pairs, distances, pick_pivots
from lexistat.operators.condense import RUN_LINKS, chosen_clusters, cluster_tree
from lexistat.operators.neighbours import distinct_vectors, knn_graph

NOISE = -1
CELL_ROWS = 512
BLOCK_ROWS = 2048


def connected_groups(nodes: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(level, id, root): the smallest id reachable inside each level, by repeated minimum joins.

    Every round takes the smallest label around a node and then jumps to the label of that label,
    so the rounds grow with the logarithm of the longest chain.
    """
    both = edges.select("level", F.col("a").alias("id"), F.col("b").alias("to")).unionByName(
        edges.select("level", F.col("b").alias("id"), F.col("a").alias("to"))
    ).distinct()
    both = cut_lineage(both)
    labels = nodes.select("level", "id", F.col("id").alias("root"))
    for _ in range(max_rounds):
        seen = both.join(
            labels.select("level", F.col("id").alias("to"), F.col("root").alias("near")), ["level", "to"]
        ).groupBy("level", "id").agg(F.min("near").alias("near"))
        lower = labels.join(seen, ["level", "id"], "left").select(
            "level", "id", "root", F.least("root", "near").alias("low")
        )
        # A root passes the lowest label of its group on to all nodes that carry it.
        best = lower.groupBy("level", "root").agg(F.min("low").alias("best"))
        hooked = lower.join(best, ["level", "root"]).select(
            "level", "id", "root", F.least("low", "best").alias("next")
        )
        hop = hooked.select("level", F.col("id").alias("next"), F.col("next").alias("jump"))
        moved = hooked.join(hop, ["level", "next"], "left").select(
            "level", "id", "root", F.coalesce("jump", "next").alias("next")
        )
        moved = cut_lineage(moved)
        labels = moved.select("level", "id", F.col("next").alias("root"))
        if moved.where("next <> root").isEmpty():
            return labels
    raise RuntimeError(f"labels still moved after {max_rounds} rounds")


def core_distances(df: DataFrame, key: str, vector: str, min_samples: int) -> DataFrame:
    """(key, core): distance to the min_samples-th nearest other row; fewer rows give infinity."""
    near = knn_graph(df, min_samples, key, vector, "euclidean")
    core = near.where(F.col("place") == min_samples).select("key", F.col("distance").alias("core"))
    return df.select(F.col(key).alias("key")).join(core, "key", "left").select(
        "key", F.coalesce("core", F.lit(float("inf"))).alias("core")
    )


def snapped(weights: np.ndarray) -> np.ndarray:
    """Weights to 40 binary digits: equal distances that were rounded differently stay equal."""
    part, power = np.frexp(weights)
    return np.ldexp(np.round(part * 2.0**40) / 2.0**40, power)


def spanning_links(weights: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) of a minimum spanning forest of the links between rows and columns, or between the rows
    of one block (`same`), by growing one tree at a time. Infinite weights are no links."""
    n, m = weights.shape
    across, total = weights.T.copy(), n if same else n + m
    best, reached = np.full(total, np.inf), np.zeros(total, bool)
    origin, out = np.full(total, -1), []
    for _ in range(total):
        at = int(np.argmin(np.where(reached, np.inf, best)))
        if reached[at] or not np.isfinite(best[at]):
            at = int(np.argmin(reached))  # no link leads on: a new tree
        elif origin[at] >= 0:
            out.append((origin[at], at))
        reached[at] = True
        if same:
            low, line = 0, weights[at]
        elif at < n:
            low, line = n, weights[at]
        else:
            low, line = 0, across[at - n]
        part, open_ = slice(low, low + len(line)), ~reached[low : low + len(line)]
        closer = open_ & (line < best[part])
        best[part][closer] = line[closer]
        origin[part][closer] = at
    ends = np.array(out, dtype=int).reshape(-1, 2)
    if same:
        return ends[:, 0], ends[:, 1]
    ends = np.sort(ends, axis=1)
    return ends[:, 0], ends[:, 1] - n


def cell_pairs(placed: DataFrame, pivots: np.ndarray) -> list[tuple[int, int, float]]:
    """(i, j, bound): pairs of cells that may hold a link of the spanning tree, and the heaviest such link.

    Any two points are joined by the way point, pivot, pivots, pivot, point; a link heavier than each step of that
    way is in no minimum spanning tree. At most one number per pair of pivots.
    """
    far, star, core = np.zeros(len(pivots)), np.full(len(pivots), -1.0), np.full(len(pivots), np.inf)
    for r in placed.groupBy("cell").agg(
        F.max("gap").alias("far"), F.max(F.greatest("gap", "core")).alias("star"), F.min_by("core", "gap").alias("core")
    ).collect():
        far[r["cell"]], star[r["cell"]], core[r["cell"]] = r["far"], r["star"], r["core"]
    used = np.flatnonzero(star >= 0)
    between = distances(pivots, pivots, "euclidean")
    star = np.maximum(star, core)  # the nearest point of a cell is its pivot, or a copy
    steps = np.maximum(between, np.maximum(core[:, None], core[None, :]))[np.ix_(used, used)]
    np.fill_diagonal(steps, np.inf)
    way = np.zeros((len(used), len(used)))
    a, b = spanning_links(steps, True)
    seen = [int(a[0])] if len(a) else []
    for x, y in zip(a, b):  # links come in the order in which the tree grew: y is new, x is not
        way[y, seen] = way[seen, y] = np.maximum(way[x, seen], steps[x, y])
        way[y, x] = way[x, y] = steps[x, y]
        seen.append(int(y))
    out = []
    for p, i in enumerate(used):
        bound = np.maximum(np.maximum(star[i], star[used[p:]]), way[p, p:])
        apart = between[i, used[p:]] - far[i] - far[used[p:]]
        for q in np.flatnonzero(apart <= bound + SLACK):
            out.append((int(i), int(used[p + q]), float(bound[q])))
    return out


def tree_links(points: DataFrame, n: int, seed: int = 42, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(w, a, b): links that hold a minimum spanning tree of points (id, vector, core), by mutual reachability."""
    pivots = pick_pivots(points, n, seed, max(1, min(MAX_PIVOTS, n // cell_rows)))
    placed = cut_lineage(assign_cells(points.select("id", "vector", "core"), pivots, "euclidean"))
    wanted = cell_pairs(placed, pivots)
    plan = F.broadcast(points.sparkSession.createDataFrame(  # at most one row per pair of pivots
        [(k, i, j, b) for k, (i, j, b) in enumerate(wanted)], "pair int, i int, j int, bound double"))

    def side(cell: str) -> DataFrame:
        rows = placed.select("id", "vector", "core", F.col("cell").alias(cell)).join(plan, cell)
        rows = rows.select("id", "vector", "core", "bound", (F.col("i") == F.col("j")).alias("same"), F.col("pair").alias("cell"))
        return rows.toDF(*rows.columns)  # columns of their own for each side

    def forest(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        gaps = distances(matrix(one["vector"]), matrix(two["vector"]), "euclidean")
        left, right = one["id"].to_numpy(), two["id"].to_numpy()
        weights = snapped(np.maximum(gaps, np.maximum(one["core"].to_numpy()[:, None], two["core"].to_numpy()[None, :])))
        weights[weights > one["bound"].iloc[0] * (1 + SLACK) + SLACK] = np.inf
        weights[left[:, None] == right[None, :]] = np.inf
        block = bool(one["same"].iloc[0]) and len(left) == len(right) and set(left) == set(right)
        if block:
            order = np.argsort(right, kind="stable")[np.argsort(np.argsort(left, kind="stable"))]
            weights, right = weights[:, order], right[order]
        a, b = spanning_links(weights, block)
        return pd.DataFrame({"w": weights[a, b], "a": left[a], "b": right[b]})

    kind = points.schema["id"].dataType.simpleString()
    return block_pairs(side("i"), side("j"), forest, f"w double, a {kind}, b {kind}", block_rows)


def linked_pieces(links: DataFrame) -> DataFrame:
    """(id, piece): the smallest end of the connected links around each end."""
    edges = links.select(F.lit(0).alias("level"), "a", "b")
    nodes = edges.select("level", F.col("a").alias("id")).union(edges.select("level", "b")).distinct()
    return connected_groups(nodes, edges).select("id", F.col("root").alias("piece"))


def density_cluster(
    df: DataFrame, key: str, vector: str = "embedding", min_cluster_size: int = 10,
    min_samples: int | None = None, run_links: int = RUN_LINKS, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(key, root): the chosen cluster of each row, named by its smallest row; null is noise."""
    k = int(min_samples or min_cluster_size)
    keys = df.select(F.col(key).alias("key"))
    nobody = keys.withColumn("root", F.lit(None).cast(df.schema[key].dataType))
    cores = cut_lineage(core_distances(df, key, vector, k))
    points, members = distinct_vectors(df, key, vector, "euclidean")
    members = cut_lineage(members)
    copies = members.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    points = cut_lineage(points.join(cores.withColumnRenamed("key", "id"), "id").join(copies, "id"))
    n, widest = points.agg(F.count(F.lit(1)), F.max("core")).first()
    if not n or widest == float("inf"):  # fewer rows than a core needs
        return nobody
    links = cut_lineage(tree_links(points, n, block_rows=block_rows, cell_rows=cell_rows))
    joined, nodes = cluster_tree(links, points, int(min_cluster_size), linked_pieces, run_links)
    chosen = joined.join(chosen_clusters(nodes).where("top is not null"), "cluster").select("id", "top")
    rows = cut_lineage(chosen.join(members, "id").select(F.col("member").alias("key"), "top"))
    named = rows.groupBy("top").agg(F.min("key").alias("root"))
    return keys.join(rows.join(named, "top").select("key", "root"), "key", "left")


def renumber_topics(assigned: DataFrame) -> DataFrame:
    """(key, topic_id): 0 is the largest cluster, ties by smallest row; noise is -1."""
    sizes = assigned.where(F.col("root").isNotNull()).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    # One row per cluster, each of at least min_cluster_size rows.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "root")
    numbers = sizes.select("root", (F.row_number().over(order) - 1).cast("int").alias("topic_id"))
    return assigned.join(numbers, "root", "left").select(
        "key", F.coalesce("topic_id", F.lit(NOISE)).alias("topic_id")
    )
