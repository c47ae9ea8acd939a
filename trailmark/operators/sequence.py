"""Directed transitions and scores from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.config import Settings
from trailmark.operators.sessions import with_sessions


def transitions(log: DataFrame, catalog: DataFrame, s: Settings) -> DataFrame:
    """prev_item, next_item, p.  Sessions are of the whole log; distance counts catalog events only."""
    known = with_sessions(log, s.session_gap_minutes).join(catalog, "itemid", "left_semi")
    session = Window.partitionBy("visitorid", "session_no")
    order = session.orderBy("ts", "eid")
    known = known.withColumn("n", F.count(F.lit(1)).over(session)).where(F.col("n") <= s.max_session_length)
    back = F.array(
        *(
            F.struct(F.lag("itemid", d).over(order).alias("prev_item"), F.lit(1.0 / d).alias("w"))
            for d in range(1, s.sequence_window + 1)
        )
    )
    known = known.select(F.col("itemid").alias("next_item"), back.alias("back"))
    pairs = known.select(F.explode("back").alias("b"), "next_item").select("b.*", "next_item")
    pairs = pairs.where("prev_item is not null and prev_item <> next_item")
    raw = pairs.groupBy("prev_item", "next_item").agg(F.sum("w").alias("p"))
    if not s.normalize_rows:
        return raw
    total = raw.groupBy("prev_item").agg(F.sum("p").alias("total"))
    return raw.join(total, "prev_item").select("prev_item", "next_item", (F.col("p") / F.col("total")).alias("p"))


def sequence_scores(profile: DataFrame, steps: DataFrame, s) -> DataFrame:
    """case_id, itemid, score: decay counts all of the last items, known or not; event weights don't matter.

    s: Settings; sequence_max_items and sequence_position_decay may be columns of the profile.  Where steps has a column ``step``, the
    profile has one, too, and tells which steps a case takes.
    """
    back = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("pos"))) - 1
    last = profile.withColumn("back", back)
    if s.sequence_max_items is not None:
        last = last.where(F.coalesce(F.col("back") < F.lit(s.sequence_max_items), F.lit(True)))
    last = last.withColumn("w", F.pow(F.lit(s.sequence_position_decay), F.col("back"))).withColumn("prev_item", F.col("itemid"))
    on = ["prev_item", *(c for c in ("step",) if c in steps.columns)]
    got = last.select("case_id", "w", *on).join(steps, on).groupBy("case_id", F.col("next_item").alias("itemid"))
    return got.agg(F.sum(F.col("w") * F.col("p")).alias("score"))
