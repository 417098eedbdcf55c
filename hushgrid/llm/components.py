"""Connected components by contraction, in DataFrame operations only.

Each round every node moves to its smallest neighbour, and on to where that one moves, until
it stands still; edges move along, and edges within a node go. Components at least
halve a round. Only nodes that have an edge take part. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgrid.llm.runtime import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a long, b long); root is the smallest node that can be reached."""
    left = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")))
        while True:  # until each node knows the end of its way down; the ways halve each time
            ahead = moves.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
            longer = cut(moves.join(ahead, F.col("to") == F.col("_n")).select("node", "to", F.col("_t").alias("far")))
            moves = longer.select("node", F.col("far").alias("to"))
            if longer.where("far <> to").isEmpty():
                break
        a, b = (moves.select(F.col("node").alias(f"_{x}"), F.col("to").alias(f"_to_{x}")) for x in "ab")
        moved = left.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b")).select(F.greatest("_to_a", "_to_b").alias("a"), F.least("_to_a", "_to_b").alias("b"))
        left = cut(moved.where("a <> b").distinct())
        if labels is None:
            labels = moves.select("node", F.col("to").alias("root"))
        else:
            labels = labels.join(moves.select(F.col("node").alias("_n"), F.col("to").alias("_t")), F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_t", "root").alias("root"))
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
