"""Connected components of an edge table by repeated contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root), one row per node that has an edge.

    Every round each node points to its neighbour of least hash (or itself),
    pointers are followed twice, and the edges move to the ends of the
    pointers.  Hash order makes long chains shrink by a constant factor a
    round.  Every round is written to the shared folder.
    """
    edges = settle(edges.filter("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        self_ = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("to"))
        up = settle(near.select("a", F.least("m", self_)["to"].alias("p")), "parents")
        for _ in range(2):
            above = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            up = up.join(above, "p").select("a", F.col("pp").alias("p"))
        up = settle(up, "parents")
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            moved = up.select(F.col("a").alias("root"), "p")
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = settle(labels, "labels")
        pa = up.select("a", F.col("p").alias("x"))
        pb = up.select(F.col("a").alias("b"), F.col("p").alias("y"))
        edges = settle(edges.join(pa, "a").join(pb, "b").filter("x <> y")
                       .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
