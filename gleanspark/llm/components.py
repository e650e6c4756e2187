"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.runtime import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node that has a link, with the smallest node it can reach.

    ``links`` has two columns of node ids. Large-star and small-star steps in
    turn: each hangs nodes under the smallest neighbour, by a minimum that is
    summed up before the shuffle, until every node hangs under its root. The
    number of steps grows with the logarithm of the longest chain. Self links
    and repeated links are harmless; no links give no rows.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    edges = materialize(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionByName(root.select("a", F.col("m").alias("b"))).distinct(), "links")
        inner = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        if not inner:
            # No root hangs under another node; now each node hangs under one root only.
            forked = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
            if not forked:
                break
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
