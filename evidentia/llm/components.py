"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.storage import drop, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that has an edge; component is the smallest id reachable.

    Each round replaces the edges by those to the smallest neighbour, first of
    the larger ends and then of the smaller ones, so the number of rounds grows with
    the logarithm of the diameter. Aggregation is partial before each shuffle; a
    vertex with many edges is split by the skew handling of the join. Edges of a
    vertex to itself and nulls count for nothing; repeated edges count once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = edges = written(e, "edges")
    while True:
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        near = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        old, e = edges, written(near.union(least).distinct(), "edges")
        drop(old)
        edges = e
