"""Sessions, histories and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Minutes of a visitor's log that one task looks at together.
CHUNK_MINUTES = 60


def with_sessions(log: DataFrame, gap_minutes: float = 30, chunk_minutes: float = CHUNK_MINUTES) -> DataFrame:
    """session_no from 1 for each visitor: a new one after a gap of more than ``gap_minutes``.

    A segmented scan: starts are counted within (visitor, chunk of time), then the ends of chunks, one small row each, tell a chunk
    whether it begins with a start and how many there were before.  So a visitor's log is many tasks' work.
    """
    gap = F.lit(int(gap_minutes * 60_000_000))
    rows = log.withColumn("chunk", F.floor(F.col("ts") / F.lit(float(chunk_minutes * 60_000_000))))
    order = Window.partitionBy("visitorid", "chunk").orderBy("ts", "eid")
    rows = rows.withColumn("starts", F.coalesce((F.col("ts") - F.lag("ts").over(order) > gap).cast("long"), F.lit(0)))
    ends = rows.groupBy("visitorid", "chunk").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("starts").alias("inner"))
    chunks = Window.partitionBy("visitorid").orderBy("chunk")
    opens = F.coalesce((F.col("first") - F.lag("last").over(chunks) > gap).cast("long"), F.lit(1))
    before = F.sum(F.col("opens") + F.col("inner")).over(chunks.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("opens", opens).withColumn("base", F.coalesce(before, F.lit(0)) + F.col("opens"))
    within = F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("within", within).join(ends.select("visitorid", "chunk", "base"), ["visitorid", "chunk"])
    return numbered.select(*log.columns, (F.col("base") + F.col("within")).alias("session_no"))


def by_unit(log: DataFrame, unit: str, gap_minutes: float = 30) -> DataFrame:
    """The log with the column that ``unit`` names: a session is its visitor and number."""
    if unit != "sessionid":
        return log
    return with_sessions(log, gap_minutes).withColumn("sessionid", F.struct("visitorid", "session_no"))


def ordered_history(log: DataFrame) -> DataFrame:
    """visitorid, itemid, weight (summed), last_ts, pos (from 1, oldest first): distinct items of each visitor."""
    agg = log.groupBy("visitorid", "itemid").agg(F.sum("weight").alias("weight"), F.max("ts").alias("last_ts"))
    return agg.withColumn("pos", F.row_number().over(Window.partitionBy("visitorid").orderBy("last_ts", "itemid")).cast("long"))


def recent_item(log: DataFrame) -> DataFrame:
    """visitorid, itemid of the latest event; the first of simultaneous ones.  Combined before the shuffle."""
    latest = F.min_by("itemid", F.struct(-F.col("ts"), F.col("eid")))
    return log.groupBy("visitorid").agg(latest.alias("itemid"))


def profile(
    history: DataFrame,
    current_session_only: bool | Column = False,
    max_items: int | None | Column = None,
    gap_minutes: float = 30,
) -> DataFrame:
    """The slice of each case's history (case_id, pos, itemid, weight, last_ts) that is scored.  A column of the history may tell for
    each case whether it is the current session only, and how many items at most (null: all)."""
    order = Window.partitionBy("case_id").orderBy("pos")
    out = history
    if current_session_only is not False:
        gap = F.col("last_ts") - F.lag("last_ts").over(order) > F.lit(int(gap_minutes * 60_000_000))
        after = order.rowsBetween(1, Window.unboundedFollowing)
        out = out.withColumn("cut", F.coalesce(gap.cast("int"), F.lit(0)))
        out = out.withColumn("later", F.coalesce(F.sum("cut").over(after), F.lit(0)))
        out = out.where(~F.lit(current_session_only) | (F.col("later") == 0)).drop("cut", "later")
    if max_items is not None:
        back = Window.partitionBy("case_id").orderBy(F.desc("pos"))
        out = out.withColumn("back", F.row_number().over(back))
        out = out.where(F.coalesce(F.col("back") <= F.lit(max_items), F.lit(True))).drop("back")
    return out
