"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step is an aggregation with partial sums before its shuffle and a join that Spark may split where a node is hot.
Every round is written to the shared folder, so a lost executor costs that round at most, in as many files as the
number of edges asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) of every node with an edge (columns a, b, long); root is the least node of its component. rows: of edges, at most."""
    now = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        before = state
        # large star: larger neighbours go to the least neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = common.written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges", 2 * state[0])
