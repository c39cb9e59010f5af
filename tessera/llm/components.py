"""Connected components by alternating large-star and small-star steps on DataFrames.

Every node's smallest neighbour is an aggregate, with partial sums before the shuffle, joined back to its
edges; a hub's edges are never gathered in one task. The number of edges doesn't grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame) -> DataFrame:
    """Links every edge's larger end to the smallest number known beside its smaller end (large star), then hands on (small star)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``u`` and ``root`` (the smallest number that it reaches) for every number in ``edges`` (``u``, ``v`` longs) but the roots."""
    edges = materialize(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while True:
        # A forest of stars: every number has one edge down, and none of those has another.
        done = edges.groupBy("u").agg((F.count("*") - 1).alias("n"))
        ups = edges.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct().join(edges.select("u").distinct(), "u", "left_semi").select("u", F.lit(1).alias("n"))
        if not done.where("n > 0").unionByName(ups, allowMissingColumns=True).limit(1).count():
            return edges.withColumnRenamed("v", "root")
        edges = materialize(_star(edges), name)
