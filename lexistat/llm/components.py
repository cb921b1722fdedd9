"""Connected components of a graph of links, by smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistat.llm.frames import settle


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node of its component.

    In each round a node takes the smallest root among its neighbours, then the root of that root; rounds go on
    until none changes. Minima are taken before the shuffle, so a hub of many links is no single task.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    roots = settle(both.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("root")
    ))
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("low"))
        lower = roots.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("root").alias("was"), F.least("root", "low").alias("step")
        )
        jump = roots.select(F.col("node").alias("step"), F.col("root").alias("far"))
        after = settle(lower.join(jump, "step", "left").select(
            "node", "was", F.least("step", F.coalesce("far", "step")).alias("root")
        ))
        roots = after.select("node", "root")
        if not after.where("was <> root").limit(1).count():
            return roots
