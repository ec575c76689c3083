"""Connected components of an edge table, by contraction: nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaneworks.llm.common import drop_stored, stored


def _tidy(edges: DataFrame) -> DataFrame:
    up, down = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    return edges.where(F.col("a") != F.col("b")).select(up, down).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the edges (a, b); the root is the smallest node of its component.

    Each round every node moves to its smallest neighbour below it, and so do the ends of the edges; paths map onto
    paths and the smallest node never moves, so the edges end when each component is one node. Each round's tables are
    written to the shared folder and those before it removed.
    """
    edges = stored(_tidy(edges), "edges")
    labels = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        moves = stored(edges.groupBy("a").agg(F.min("b").alias("to")), "moves")
        of_a, of_b = moves.select(F.col("a").alias("k"), F.col("to").alias("ta")), moves.select(F.col("a").alias("k2"), F.col("to").alias("tb"))
        moved = edges.join(of_a, edges["a"] == of_a["k"]).join(of_b, F.col("b") == F.col("k2"), "left")
        older = (edges, labels, moves)
        edges = stored(_tidy(moved.select(F.col("ta").alias("a"), F.coalesce("tb", "b").alias("b"))), "edges")
        to = moves.select(F.col("a").alias("k"), "to")
        labels = stored(labels.join(to, labels["root"] == to["k"], "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        for df in older:
            drop_stored(df)
    return labels
