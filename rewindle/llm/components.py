"""Connected components of a graph given by its edges, by alternating stars over Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewindle.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``): each node of ``edges`` (``x`` long, ``y`` long) and the smallest node it reaches.

    Large and small stars take turns: the first hangs the greater neighbours of a node below its smallest
    one, the second the smaller neighbours. Rounds are logarithmic in the longest path. Minima are written
    before they are joined, so that Spark can split the partition of a node with very many edges.
    """
    low, high = F.least("x", "y"), F.greatest("x", "y")
    edges = written(edges.where("x <> y").select(low.alias("x"), high.alias("y")).distinct(), "edges")
    seen = None
    while True:
        both = edges.select("x", "y").unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m")), "least")
        large = written(edges.join(least, "x").select(F.col("m").alias("x"), "y").where("x <> y").distinct(), "large")
        least_of = written(large.groupBy("y").agg(F.min("x").alias("m")), "least")
        small = large.join(least_of, "y").where("x <> m").select(F.col("m"), F.col("x").alias("y")).unionAll(least_of.select("m", "y"))
        after = written(small.select(F.least("m", "y").alias("x"), F.greatest("m", "y").alias("y")).where("x <> y").distinct(), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        for old in (least, large, least_of, edges):
            dropped(old)
        edges = after
        if state == seen:
            roots = edges.select(F.col("x").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return edges.select(F.col("y").alias("node"), F.col("x").alias("root")).unionAll(roots)
        seen = state
