"""Connected components by rounds of joins: labels take the minimum of their neighbours, then jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from reelgrid.llm.texts import written


def starred(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Fewer edges (a, b) with the same components: each node hands its smaller neighbours to the smallest of them.

    Of a group whose k nodes are all linked, k - 1 edges stay. For nodes with a bounded number of neighbours.
    """
    pairs = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other")).where("node <> other")
    least = F.min("other").over(W.partitionBy("node"))
    handed = pairs.withColumn("least", least)
    return (handed.select(F.col("other").alias("a"), F.col("least").alias("b")).where("a <> b")
            .unionByName(handed.select(F.col("node").alias("a"), F.col("least").alias("b"))).distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge: root is the smallest node that can be reached. Nodes may be structs.

    Each round is written to the shared folder. The jumps double the reach of a label in a round, so the number of rounds
    grows with the logarithm of the longest path.
    """
    both = written(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
                   .unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other")).where("node <> other")).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("best"))
        lower = labels.join(seen, "node").select("node", F.least("root", "best").alias("root"), F.col("root").alias("before"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = written(lower.join(jump, "root", "left").select(
            "node", F.least("root", F.coalesce("up", "root")).alias("root"), "before"), "labels")
        labels = new.select("node", "root")
        if new.where("root <> before").isEmpty():
            return labels
