"""Connected components of a link table by alternating large and small stars.

Each round is two partial aggregates and two equi-joins; links shrink towards one star per
component, so the number of rounds grows with the logarithm of the longest path. Every round
is written to the shared folder. Nothing is collected but two counts per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comboscore.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the component's smallest node."""
    edges = cut_lineage(links.select("a", "b").where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .distinct())
        large = cut_lineage(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .unionByName(joined.select("a", F.col("m").alias("b"))).distinct())
        edges = cut_lineage(small)
        # done when every node hangs on one root, and no root hangs on another
        many, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
        if many == nodes and not edges.select(F.col("b").alias("a")).join(edges, "a", "left_semi").take(1):
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
