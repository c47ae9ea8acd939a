"""Parquet tables that later loads are merged into.

Rows are dealt to folders by a hash of their key.  A merge reads and rewrites only the folders that the new rows have keys of, first
beside the table and then, by dynamic partition overwrite, in it: a merge that fails before that leaves the table alone.
How many folders there are is set by the first load and kept beside the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.sources.tables import written

PARTS = 64


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _place(spark, path)
    return files.exists(at)


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def parts_of(spark: SparkSession, path: str) -> int | None:
    """How many folders a table has; None if there is no table."""
    return int(spark.read.text(f"{path}/_parts").first()[0]) if exists(spark, f"{path}/_parts") else None


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table with their ``part``, or None where nothing has been merged yet."""
    if parts_of(spark, path) is None:
        return None
    return spark.read.option("basePath", path).parquet(path)


def merge(path: str, key: str, new: DataFrame, merged: Callable[[DataFrame | None, DataFrame], DataFrame], parts: int = PARTS) -> list[int]:
    """Merges ``new`` into the table and gives the parts that were rewritten.

    merged: gets the old rows of the touched parts (None for a new table) and the new rows, and gives all rows that these parts hold
    from now on.  ``parts`` counts for a new table only.  No new rows: nothing happens.
    """
    spark = new.sparkSession
    had = parts_of(spark, path)
    parts = had or parts
    new = written(new.withColumn("part", part_of(key, parts)), "new")
    touched = sorted(r[0] for r in new.select("part").distinct().collect())  # ``parts`` at most
    if not touched:
        return []
    old = read(spark, path).where(F.col("part").isin(touched)) if had else None
    rows = merged(old.drop("part") if old is not None else None, new.drop("part"))
    rows = written(rows.withColumn("part", part_of(key, parts)).repartition("part"), "merged")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    if not had:
        spark.createDataFrame([(str(parts),)], "value string").coalesce(1).write.text(f"{path}/_parts")
    return touched


def merge_categories(path: str, properties: DataFrame, parts: int = PARTS) -> list[int]:
    """Merges properties (timestamp, itemid, property, value) into a category map: of each item the newest category stays, the
    larger of simultaneous ones, in whatever order loads come."""
    from trailmark.operators.metadata import dated_categories, newest

    def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if old is None else newest(old.unionByName(new))

    return merge(path, "itemid", dated_categories(properties), merged, parts)


def category_map(spark: SparkSession, path: str, properties: Callable[[], DataFrame] | None = None) -> DataFrame:
    """itemid, categoryid of a category map; where there is none yet, ``properties`` is loaded and becomes one."""
    if parts_of(spark, path) is None and properties is not None:
        merge_categories(path, properties())
    rows = read(spark, path)
    if rows is None:
        return spark.createDataFrame([], "itemid long, categoryid long")
    return rows.select("itemid", "categoryid")


def merge_history(path: str, log: DataFrame, parts: int = PARTS) -> list[int]:
    """Merges a part of a log into stored histories (case_id, itemid, weight, last_ts, pos): weights are summed, the latest time of
    an item stays, and the visitors that the part has are numbered anew.  Each event may come once."""

    def ordered(rows: DataFrame) -> DataFrame:
        rows = rows.groupBy("case_id", "itemid").agg(F.sum("weight").alias("weight"), F.max("last_ts").alias("last_ts"))
        return rows.withColumn("pos", F.expr("bigint(row_number() OVER (PARTITION BY case_id ORDER BY last_ts, itemid))"))

    def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
        if old is None:
            return ordered(new)
        visitors = new.select("case_id").distinct()
        own = old.join(visitors, "case_id", "left_semi").drop("pos")
        return old.join(visitors, "case_id", "left_anti").unionByName(ordered(own.unionByName(new)))

    part = log.groupBy(F.col("visitorid").alias("case_id"), "itemid").agg(F.sum("weight").alias("weight"), F.max("ts").alias("last_ts"))
    return merge(path, "case_id", part, merged, parts)


def merge_recent(path: str, log: DataFrame, parts: int = PARTS) -> list[int]:
    """Merges a part of a log into each visitor's latest item (case_id, itemid, ts, eid), the first of simultaneous events."""

    def latest(rows: DataFrame) -> DataFrame:
        one = F.min_by(F.struct("itemid", "ts", "eid"), F.struct(-F.col("ts"), F.col("eid"))).alias("one")
        return rows.groupBy("case_id").agg(one).select("case_id", "one.*")

    part = latest(log.select(F.col("visitorid").alias("case_id"), "itemid", "ts", "eid"))
    return merge(path, "case_id", part, lambda old, new: new if old is None else latest(old.unionByName(new)), parts)
