"""Connected components of an edge table, by DataFrame joins.

Every round, each node with a smaller neighbour hangs itself to the smallest one,
the chains so made are followed to their roots by doubling, and edges are moved to
the roots. At least half of the nodes go in a round, so there are few rounds. A
node with very many edges is no problem: its neighbours are combined before the
shuffle, and joins split hot keys at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that edges lead to, for every node with an edge.

    Loops and repeated edges do no harm; edges with a null end are left out. An
    empty edge table, or one of loops only, gives an empty result.
    """
    large, small = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    left = cut_lineage(both.select(large, small).distinct())
    hung = left.select("a", F.col("b").alias("to")).limit(0)
    while not left.isEmpty():
        rooted = followed(left.groupBy("a").agg(F.min("b").alias("to")))
        hung = hung.unionByName(rooted)
        of_b = rooted.select(F.col("a").alias("b"), F.col("to").alias("b_to"))
        ends = left.join(rooted, "a").join(of_b, "b", "left")
        moved = ends.select(F.col("to").alias("a"), F.coalesce("b_to", "b").alias("b"))
        left = cut_lineage(moved.where("a <> b").select(large, small).distinct())
    rooted = followed(hung)
    roots = rooted.select(F.col("to").alias("a"), "to").distinct()
    every = rooted.unionByName(roots)
    return every.select(F.col("a").alias("node"), F.col("to").alias("component"))


def followed(parents: DataFrame) -> DataFrame:
    """(a, to) with `to` the last of the chain that starts at a; a is unique, to < a."""
    known = cut_lineage(parents)
    while True:
        up = known.select(F.col("a").alias("to"), F.col("to").alias("next"))
        if known.join(up, "to", "left_semi").isEmpty():
            return known
        known = cut_lineage(
            known.join(up, "to", "left").select("a", F.coalesce("next", "to").alias("to"))
        )
