"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.scratch import tidy, written


def components(links: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (two long columns, either direction, repeats allowed).

    ``component`` is the least node reachable. Nodes without a link to another node are not returned.

    Each round needs the least neighbour of a node (an aggregate, combined map-side) and a join back on the node (which
    AQE can split), and is written to the shared folder, so a lost executor repeats one round at most. Links stay within
    a small factor of their first number; nothing but two totals a round reaches the driver.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    edges = written(edges, "links")
    before = None
    for _ in range(max_rounds):
        total = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(total) == before:
            break
        before = tuple(total)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        tidy(edges.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
