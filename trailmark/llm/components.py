"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame) -> bool:
    """Whether each vertex that has a smaller neighbour has one only, and that has none."""
    ends = F.array(*(F.struct(F.col(c).alias("x"), F.lit(int(c == "u")).alias("up")) for c in ("u", "v")))
    ends = edges.select(F.explode(ends).alias("end")).select("end.*").groupBy("x")
    ends = ends.agg(F.sum("up").alias("up"), F.sum(1 - F.col("up")).alias("down"))
    return not ends.where("up > 1 or up > 0 and down > 0").agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) longs -> (u, component): every linked vertex but the least with the least vertex it reaches.

    Each step is a minimum by vertex, combined before the shuffle, and a join back, which AQE splits at hubs; edges are
    written between rounds, which end when only stars are left.  Self-links and repeated links don't matter; no edges: no rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()  # its exchange is reused below
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct(), "small")
    return edges.select("u", F.col("v").alias("component"))
