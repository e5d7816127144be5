"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Alternating large-star and small-star steps: each links a node's larger neighbours, then its smaller ones, to the
    smallest neighbour.  Neighbours are never gathered: a step is one grouped minimum and a join, which adaptive
    execution splits where one node holds many edges.  Empty edges give an empty result.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def settled() -> bool:
        """Whether all edges form stars: no node has two smaller neighbours, or both a smaller and a larger one."""
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 or (up = 1 and low = 0)")
        return not odd.head(1)

    for _ in range(max_rounds):
        if settled():
            break
        both = now.union(now.select(F.col("b"), F.col("a")).toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = written(large.distinct(), "edges")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        now = written(small.distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").toDF("node", "component").distinct())
