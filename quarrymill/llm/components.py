"""Connected components of a link table, in rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` (longs) to ``node, component``: the smallest node reachable from each node.

    Alternates the two star steps: first every node's larger neighbours are linked to its
    smallest neighbour, then its smaller ones. Both are a grouped minimum and a join, so a
    hub's links are never gathered in one place; the links end as stars in a number of
    rounds logarithmic in the longest chain. Each round is written to the shared folder.
    Only nodes with a link to another node appear; null ends are ignored.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(joined.select("a", F.col("m").alias("b"))).distinct()
        after = materialize(small, "links")
        # stars: every node has one smaller end, and no such end has a smaller one itself
        stats = after.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n").alias("most")).first()
        deeper = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        delete(edges.sparkSession, links)
        links = after
        if (stats.most or 1) == 1 and not deeper:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
