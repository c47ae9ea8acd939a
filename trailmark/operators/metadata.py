"""Item metadata: the latest category, category paths, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.sources.tables import written


def latest_category(properties: DataFrame) -> DataFrame:
    """properties (timestamp, itemid, property, value) -> itemid, categoryid: the newest value; the larger of simultaneous ones."""
    return dated_categories(properties).select("itemid", "categoryid")


def dated_categories(properties: DataFrame) -> DataFrame:
    """itemid, timestamp, categoryid: as ``latest_category``, with the time.  Combined before the shuffle."""
    own = properties.where("property = 'categoryid'").select("itemid", "timestamp", F.col("value").cast("long").alias("categoryid"))
    return newest(own)


def newest(rows: DataFrame) -> DataFrame:
    """Of rows (itemid, timestamp, categoryid) the newest of each item."""
    latest = F.max(F.struct("timestamp", "categoryid")).alias("latest")
    return rows.groupBy("itemid").agg(latest).select("itemid", "latest.timestamp", "latest.categoryid")


def category_paths(tree: DataFrame, max_depth: int | None = 5) -> DataFrame:
    """categoryid, path: "category -> parent -> ..." with at most ``max_depth`` parents, round a cycle if need be.

    max_depth None: all parents, each category once, so that a cycle ends where it began.  By pointer doubling: after k joins a
    category knows its next 2 ** k parents and the one to go on from, so a chain needs as many joins as its length has bits.
    """
    up = F.col("parentid")
    own = F.when(up.isNotNull(), F.array(up)).otherwise(F.array().cast("array<bigint>"))
    paths = tree.select("categoryid", F.coalesce(own, F.array().cast("array<bigint>")).alias("parents"), up.alias("up"))
    paths, k = written(paths, "paths"), 1
    while max_depth is None or k < max_depth:
        more = paths.select(F.col("categoryid").alias("up"), F.col("parents").alias("further"), F.col("up").alias("next"))
        grown = paths.join(more, "up", "left").select(
            "categoryid", F.concat("parents", F.coalesce("further", F.array().cast("array<bigint>"))).alias("parents"), F.col("next").alias("up")
        )
        if max_depth is None:  # a list with a category twice, or with its own, has been round a cycle: it ends before the second
            whole = F.concat(F.array("categoryid"), F.col("parents"))
            once = F.array_distinct(whole)
            grown = grown.select(
                "categoryid", F.slice(once, 2, F.size(once)).alias("parents"), F.when(F.size(once) == F.size(whole), F.col("up")).alias("up")
            )
        paths, k = written(grown, "paths"), 2 * k
        if not paths.where("up is not null").take(1):
            break
    parents = F.col("parents") if max_depth is None else F.slice("parents", 1, max_depth)
    return paths.select("categoryid", F.array_join(F.concat(F.array("categoryid"), parents), " -> ").alias("path"))


def item_label(itemid: Column, categoryid: Column, path: Column) -> Column:
    own = F.concat(F.lit("Item "), itemid.cast("string"))
    known = F.concat(own, F.lit(" (Category "), F.coalesce(path, categoryid.cast("string")), F.lit(")"))
    return F.when(categoryid.isNull(), F.concat(own, F.lit(" (Category unknown)"))).otherwise(known)


def customer_label(visitorid: Column) -> Column:
    return F.concat(F.lit("Customer #"), visitorid.cast("string"))
