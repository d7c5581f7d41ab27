"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscore.llm.shared import release, written


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`node, root`: for every node of `links` (`a, b` of any ordered type) the smallest node reachable from it.

    Large-star links each node's larger neighbours to its smallest one; small-star links the smaller ones
    and itself. Both are one grouped minimum and one join on the node, so a hub with a third of all links is
    pre-aggregated on the map side and split by the join; no neighbour list is collected. The links become
    stars in a few rounds (logarithmic in their number); each round is written, which cuts the lineage.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = written(new, "links")
        # Stars: every node has one link, and no root is linked on.
        done = new.groupBy("a").count().filter("count > 1").isEmpty() and new.join(new.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        release(edges)
        edges = new
        if done:
            break
    else:
        raise RuntimeError(f"links have not become stars in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
