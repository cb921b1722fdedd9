"""The tree of density clusters from a list of weighted links, in runs of bounded size.

Links are taken by rising weight. Groups below the smallest cluster size keep their members; a group that reaches it
is born as a cluster, takes in smaller groups one by one, and ends where it meets another cluster. Each run of links
falls into pieces that touch no common group, and a piece is one task, so no task sees more than one run. Groups that
meet at one weight meet at once, so the order of equal links does not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistat.functions.session import cut_lineage

RUN_LINKS = 500_000
LEAST = 1e-12  # copies at distance 0 have the density of this distance


def density_of(weight: float) -> float:
    return 1.0 / max(weight, LEAST)


class Group:
    """A connected group so far: its members while it is small, then the sums of its cluster."""

    __slots__ = ("cluster", "inner", "mass", "members", "size")

    def __init__(self, size: int, members: list | None, cluster: str | None, mass: float, inner: float) -> None:
        self.size, self.members, self.cluster, self.mass, self.inner = size, members, cluster, mass, inner


def merge_links(links: list[tuple], groups: dict, least: int) -> Iterator[tuple]:
    """Rows (kind, id, size, members, cluster, mass, inner, parent, stays) of what the links of one piece do.

    kind: `joined` (member id belongs to a cluster), `node` (a cluster has ended), `moved` (group id is now part of its one member)
    and `group` (a group that is left). mass adds up the densities at which members leave, inner the best choice
    among the clusters inside.
    """
    root = {g: g for g in groups}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for weight, batch in groupby(sorted(links), itemgetter(0)):
        met: dict = {}  # groups that meet at this weight, under the root they get
        names = {}
        for _, a, b in batch:
            x, y = find(a), find(b)
            if x != y:
                root[y] = x
                names[x] = names.pop(x, names.pop(y, f"{a}|{b}"))
                met[x] = met.pop(x, [x]) + met.pop(y, [y])
        dense = density_of(weight)
        for x, parts in met.items():
            own = [groups.pop(g) for g in parts]
            clusters, small = [g for g in own if g.cluster], [m for g in own if not g.cluster for m in g.members]
            size = sum(g.size for g in own)
            if not clusters and size < least:
                groups[x] = Group(size, small, None, 0.0, 0.0)
                continue
            if len(clusters) == 1:
                one = clusters[0]
                new = Group(size, None, one.cluster, one.mass + (size - one.size) * dense, one.inner)
            else:  # a cluster is born, or several end in one
                best = 0.0
                for g in clusters:
                    stable = g.mass - g.size * dense
                    best += max(stable, g.inner)
                    yield "node", None, g.size, None, g.cluster, stable, g.inner, names[x], stable >= g.inner
                new = Group(size, None, names[x], size * dense, best)
            for m in small:
                yield "joined", m, None, None, new.cluster, None, None, None, None
            groups[x] = new
    for g in root:
        if find(g) != g:
            yield "moved", g, None, [find(g)], None, None, None, None, None
    for g, s in groups.items():
        yield "group", g, s.size, s.members, s.cluster, s.mass, s.inner, None, None


NAMES = ["kind", "id", "size", "members", "cluster", "mass", "inner", "parent", "stays"]


def run_pieces(links: DataFrame, groups: DataFrame, least: int, kind: str) -> DataFrame:
    """`merge_links` for every piece; links (piece, w, a, b), groups (piece, id, size, members, cluster, mass, inner)."""

    def work(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for row in two.itertuples(index=False):
            members = None if row.members is None else list(row.members)
            held[row.id] = Group(int(row.size), members, row.cluster, float(row.mass), float(row.inner))
        rows = merge_links(list(zip(one["w"], one["a"], one["b"])), held, least)
        return pd.DataFrame(list(rows), columns=NAMES, dtype=object)

    schema = (f"kind string, id {kind}, size bigint, members array<{kind}>, cluster string, mass double, inner double, "
              f"parent string, stays boolean")
    return links.groupBy("piece").cogroup(groups.groupBy("piece")).applyInPandas(work, schema)


def cluster_tree(
    links: DataFrame, points: DataFrame, least: int, pieces, run_links: int = RUN_LINKS
) -> tuple[DataFrame, DataFrame]:
    """(joined, nodes): id and cluster of every point, and (cluster, parent, stays) of every cluster.

    links: (w, a, b), enough to hold a minimum spanning tree. points: (id, copies, core); copies of a point are
    linked at its core distance. `pieces(links)` gives (id, piece) of connected links.
    """
    kind = points.schema["id"].dataType.simpleString()
    born = F.col("copies") >= least
    groups = points.select(
        "id", F.col("copies").cast("bigint").alias("size"),
        F.when(~born, F.array("id")).alias("members"),
        F.when(born, F.concat(F.lit("copies of "), F.col("id").cast("string"))).alias("cluster"),
        F.when(born, F.col("copies") / F.greatest(F.col("core"), F.lit(LEAST))).otherwise(0.0).alias("mass"),
        F.lit(0.0).alias("inner"),
    )
    joined = [groups.where("cluster is not null").select("id", "cluster")]
    nodes = []
    for first, last, final in runs(links, run_links):
        now = links.where((F.col("w") > first) & (F.col("w") <= last) & (F.col("a") != F.col("b")))
        if final and not nodes and len(joined) == 1:
            with_piece = now.withColumn("piece", F.lit(0).cast(kind))  # one run: one task of bounded size
            own = groups.withColumn("piece", F.lit(0).cast(kind))
            rest = None
        else:
            at = pieces(now)
            with_piece = now.join(at.toDF("a", "piece"), "a").select("piece", "w", "a", "b")
            own = groups.join(at, "id")
            rest = groups.join(at.select("id"), "id", "left_anti")
        done = cut_lineage(run_pieces(
            with_piece.select("piece", "w", "a", "b"),
            own.select("piece", "id", "size", "members", "cluster", "mass", "inner"), least, kind,
        ))
        joined.append(done.where("kind = 'joined'").select("id", "cluster"))
        nodes.append(done.where("kind = 'node'").select("cluster", "parent", "stays"))
        groups = done.where("kind = 'group'").select("id", "size", "members", "cluster", "mass", "inner")
        if rest is not None:
            groups = cut_lineage(groups.unionByName(rest))
        if not final:
            moved = done.where("kind = 'moved'").select("id", F.get("members", F.lit(0)).alias("to"))
            later = links.where(F.col("w") > last)
            for end in ("a", "b"):
                later = later.join(moved.withColumnRenamed("id", end), end, "left").withColumn(
                    end, F.coalesce("to", end)).drop("to")
            links = cut_lineage(later.select("w", "a", "b"))
    top = groups.where("cluster is not null").select("cluster", F.lit(None).cast("string").alias("parent"), F.lit(False).alias("stays"))
    for part in nodes:
        top = top.unionByName(part)
    members = joined[0]
    for part in joined[1:]:
        members = members.unionByName(part)
    return members, top


def runs(links: DataFrame, run_links: int) -> list[tuple[float, float, bool]]:
    """(above, up to, last) weights of runs of about `run_links` links."""
    n = links.count()
    count = max(1, math.ceil(n / run_links))
    shares = [k / count for k in range(1, count)]
    cuts = links.agg(F.percentile_approx("w", shares, 100_000)).first()[0] if shares else []
    edges = [-1.0, *sorted(set(cuts or [])), float("inf")]
    return [(a, b, b == edges[-1]) for a, b in zip(edges, edges[1:])]


def chosen_clusters(nodes: DataFrame) -> DataFrame:
    """(cluster, top): the highest cluster above or at each one that stays; null where none does.

    Every round follows the parent of the parent, so rounds grow with the logarithm of the tree's depth. The last
    cluster, which holds everything, is never a choice.
    """
    now = cut_lineage(nodes.select(
        "cluster", F.when(F.col("stays") & F.col("parent").isNotNull(), F.col("cluster")).alias("top"),
        F.col("parent").alias("up"),
    ))
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("cluster").alias("up"), F.col("top").alias("higher"), F.col("up").alias("next"))
        now = cut_lineage(now.join(above, "up", "left").select(
            "cluster", F.coalesce("higher", "top").alias("top"), F.col("next").alias("up")
        ))
    return now.select("cluster", "top")
