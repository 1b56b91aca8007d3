"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwise.llm.common import fresh_folder, staged


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links`` (a, b).

    Labels and links contract together: every round each node takes the smallest label beside
    it, links are rewritten to connect labels, and links inside one label vanish. A round at
    least halves the labels of every component that is not finished, so rounds grow with the
    logarithm of its size. Rounds only group by minimum (combined map-side) and join on equal
    keys, where a hot label is split as a skewed join; each is written to the shared folder.
    """
    spark = links.sparkSession
    edges = staged(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(),
                   fresh_folder(spark, "component-links"))
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b"))
        parent = staged(least.select(F.col("a").alias("node"), F.least("a", "b").alias("up")), fresh_folder(spark, "component-up"))
        parent = flattened(parent)
        maps.append(parent)
        a = parent.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        b = parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = staged(
            edges.join(a, "a").join(b, "b").where("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(),
            fresh_folder(spark, "component-links"))
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[-1]
    for parent in reversed(maps[:-1]):
        up = out.select(F.col("node").alias("up"), F.col("up").alias("top"))
        out = staged(parent.join(up, "up", "left").select("node", F.coalesce("top", "up").alias("up")),
                     fresh_folder(spark, "component-up"))
    return out.select("node", F.col("up").alias("component"))


def flattened(parent: DataFrame) -> DataFrame:
    """Follow ``up`` to its root by pointer jumping (doubling the reach each round)."""
    spark = parent.sparkSession
    while True:
        up = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = parent.join(up, "up").select("node", "up", "top")
        if jumped.where("up <> top").isEmpty():
            return parent
        parent = staged(jumped.select("node", F.col("top").alias("up")), fresh_folder(spark, "component-up"))
