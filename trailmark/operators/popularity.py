"""Popularity rankings, global and by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.weights import quantised
from trailmark.sources.tables import written


def popularity(log: DataFrame, weight: str = "weight_recent") -> DataFrame:
    """itemid, score.  Ranked by score, then itemid; without the recent weight the plain one counts."""
    weight = weight if weight in log.columns else "weight"
    return log.groupBy("itemid").agg(F.sum(weight).alias("score"))


def ranked(scores: DataFrame, n: int | None = None) -> DataFrame:
    """itemid, score, rank: of the best n, or of all.

    All are dealt by ranges of the order and ranked within each; the sizes of the ranges before it, one number a range,
    are added.
    """
    order = [F.desc(quantised(F.col("score"), 9)), F.col("itemid")]
    if n:
        top = scores.orderBy(*order).limit(n).withColumn("part", F.lit(0))
        return top.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long")).drop("part")
    dealt = written(scores.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before, base = 0, []
    for part, size in sorted(tuple(r) for r in dealt.groupBy("part").count().collect()):  # as many as there are ranges
        base.append((part, before))
        before += size
    base = F.broadcast(scores.sparkSession.createDataFrame(base, "part int, base long"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("rank", own.cast("long")).join(base, "part").select(*scores.columns, (F.col("rank") + F.col("base")).alias("rank"))


def by_category(scores: DataFrame, categories: DataFrame) -> DataFrame:
    """categoryid, itemid, score, rank."""
    order = Window.partitionBy("categoryid").orderBy(F.desc(quantised(F.col("score"), 9)), "itemid")
    return scores.join(categories, "itemid").withColumn("rank", F.row_number().over(order).cast("long"))
