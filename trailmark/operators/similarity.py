"""The co-support filter, item-item similarity and scores from it."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from trailmark.config import Settings
from trailmark.functions.weights import quantised, saturated, user_idf
from trailmark.sources import tables
from trailmark.sources.tables import bucketed, written

log = logging.getLogger(__name__)


def interactions(log: DataFrame, unit: str = "visitorid") -> DataFrame:
    return log.groupBy(F.col(unit).alias("unit"), "itemid").agg(F.sum("weight").alias("weight"))


#: Rows of two ids that may be broadcast: a few megabytes.
SMALL = 100_000
#: A unit or item with more than one in HOT of all rows, and more than HOT_ROWS, isn't put in one bucket.
HOT, HOT_ROWS = 1000, 100_000


def _near(df: DataFrame, n: int) -> DataFrame:
    """``df`` of n rows as the side of a join that is looked up: everywhere if it is small, else dealt by the key."""
    return F.broadcast(df) if n <= SMALL else df.hint("shuffle_hash")


def _hot(rows: DataFrame, key: str, total: int) -> DataFrame | None:
    """key, n: the ids with more than one in HOT of ``total`` rows, and more than HOT_ROWS; None if there are none."""
    if total <= HOT_ROWS:
        return None
    often = rows.stat.freqItems([key], 1 / HOT).select(F.explode(f"{key}_freqItems").alias(key))  # HOT at most; these are among them
    counts = rows.join(F.broadcast(often), key).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot, n = tables.written_counted(counts.where((F.col("n") * HOT > total) & (F.col("n") > HOT_ROWS)), "hot")
    return hot if n else None


class _Side:
    """Rows filed by one of their two ids, in buckets: a join or a count by it moves none.  Rows of hot ids stay where they are."""

    def __init__(self, rows: DataFrame, key: str, total: int):
        counts = _hot(rows, key, total)
        self.key, self.hot = key, None if counts is None else counts.select(key)
        self.spread = None if self.hot is None else rows.join(F.broadcast(self.hot), key, "left_semi")
        self.filed = bucketed(rows if self.hot is None else rows.join(F.broadcast(self.hot), key, "left_anti"), key, "filed")
        own = self.filed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        self.counts = own if counts is None else own.unionByName(counts)

    def joined(self, ids: DataFrame, n: int, how: str) -> DataFrame:
        """The rows that have (left_semi) or lack (left_anti) one of n ``ids``."""
        out = self.filed.join(_near(ids, n), self.key, how)
        if self.hot is None:
            return out
        few = F.broadcast(ids.join(F.broadcast(self.hot), self.key, "left_semi"))
        return out.unionByName(self.spread.join(few, self.key, how))


def written_counted(changes: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``changes`` of a pass as a table, and how many rows the pass drops: units tell, as a row has one."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    n = F.sum(F.when(F.col("of") == "unit", F.col("gone")))
    table = written(changes.observe(seen, n.alias("n")), name)
    return table, seen.get.get("n") or 0


def co_support(rows: DataFrame, min_units: int, min_items: int, passes: int = 10) -> DataFrame:
    """Drops units with fewer than ``min_units`` items and items with fewer than ``min_items`` units until none is left.

    Both counts of a pass are of the same rows.  Peeling by counts: rows are filed once by unit and once by item.  As long as an
    item is there, it loses rows by their units only, and each unit goes but once; so what a pass takes from the items that stay is
    one count of the rows of the units that it drops, read where they are filed, and what it takes from units likewise.  A row
    moves at most once for its unit and once for its item, as part of a count; a pass writes one row for each id that lost some.
    Survivors are written once, at the end.
    """
    rows, total = tables.written_counted(rows.select("unit", "itemid", "weight"), "interactions")
    if min_units <= 1 and min_items <= 1:
        return rows
    least = {"unit": min_units, "itemid": min_items}
    names = ["of", *least, "rows", "left", "gone"]

    def told(df: DataFrame, c: str) -> DataFrame:
        """df (c, rows, left, gone) as rows of a table of changes."""
        nulls = {k: F.lit(None).cast(rows.schema[k].dataType) for k in least if k != c}
        return df.withColumns({"of": F.lit(c), **nulls}).select(*names)

    def weak(c: str) -> Column:
        return (F.col("of") == c) & (F.col("left") > 0) & (F.col("left") < least[c])

    def noted(changes: DataFrame, write: Callable) -> tuple[DataFrame, dict[str, int]]:
        """Written, with the number of ids that the next pass drops and of all rows that these ever had."""
        seen = Observation(f"weak-{uuid.uuid4().hex}")
        numbers = [F.count(F.when(weak(c), 1)).alias(c) for c in least] + [F.sum(F.when(weak(c), F.col("rows"))).alias(f"{c}_rows") for c in least]
        out = write(changes.observe(seen, *numbers))
        return out, {k: v or 0 for k, v in seen.get.items()}

    with ThreadPoolExecutor(2) as pool:  # both ids at the same time
        by = dict(zip(least, pool.map(lambda c: _Side(rows if c == "unit" else rows.drop("weight"), c, total), least), strict=True))
    first = [told(by[c].counts.select(c, F.col("n").alias("rows"), F.col("n").alias("left"), F.lit(0).cast("long").alias("gone")), c) for c in least]
    table, n = noted(first[0].unionByName(first[1]), lambda df: written(df, "counts"))
    if not any(n[c] for c in least):
        return rows
    known = table  # what each id has left after the passes that took rows of it
    gone: dict[str, DataFrame] = {}
    n_gone = dict.fromkeys(least, 0)
    for turn in range(passes):
        few = {c: table.where(weak(c)).select(c, "rows", "left") for c in least}
        for c, own in few.items():
            gone[c] = gone[c].unionByName(own.select(c)) if c in gone else own.select(c)
            n_gone[c] += n[c]

        def lessened(c: str) -> DataFrame:
            """The ids that stay and lose rows in this pass."""
            other = "itemid" if c == "unit" else "unit"
            lost = by[other].joined(few[other].select(other), n[other], "left_semi").groupBy(c).agg(F.count(F.lit(1)).alias("gone"))
            both = known.where(F.col("of") == c).select(c, "rows", "left").join(_near(lost, n[f"{other}_rows"]), c)
            both = both.groupBy(c).agg(F.min("left").alias("left"), F.first("rows").alias("rows"), F.first("gone").alias("gone"))
            return told(both.where(F.col("left") >= least[c]).withColumn("left", F.col("left") - F.col("gone")), c)

        changes = told(few["unit"].withColumns({"gone": F.col("left"), "left": F.lit(0).cast("long")}), "unit")
        for c, other in (("itemid", "unit"), ("unit", "itemid")):
            if n[other]:
                changes = changes.unionByName(lessened(c))
        (table, dropped), n = noted(changes, lambda df: written_counted(df, "dropped"))
        log.info("pass %d drops %d rows", turn + 1, dropped)
        if not any(n[c] for c in least):
            break
        known = known.unionByName(table)
    kept = by["unit"].joined(gone["unit"], n_gone["unit"], "left_anti")
    kept = kept.join(_near(gone["itemid"], n_gone["itemid"]), "itemid", "left_anti")
    return written(kept.select("unit", "itemid", "weight"), "supported")


def bot_filtered(rows: DataFrame, max_items: int | None) -> DataFrame:
    if max_items is None:
        return rows
    many = rows.groupBy("unit").count().where(F.col("count") > max_items).select("unit")
    return rows.join(many, "unit", "left_anti")


def signal(rows: DataFrame, s: Settings) -> DataFrame:
    """unit, itemid, w: bot filter, then saturation, then idf."""
    kept = bot_filtered(rows, s.max_user_items)
    out = saturated(kept, s.weight_scheme, total=rows)
    if s.use_idf:
        out = out.join(user_idf(kept, rows), "unit").withColumn("w", F.col("w") * F.col("idf"))
    return out.select("unit", "itemid", "w")


def _pairs_of_units(unit: DataFrame, block: int) -> DataFrame:
    """unit (unit, itemid, w) -> i, j, product: the items of a unit two by two, i < j.

    The items of a unit are dealt to blocks of about ``block``, and pairs of blocks are the keys of the join: no task holds more than the
    square of a block for a key, however many items a unit has.
    """
    sizes = unit.groupBy("unit").agg(F.count(F.lit(1)).alias("size"))
    dealt = unit.join(sizes, "unit").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("itemid"), F.col("blocks")).cast("int"))
    lower = dealt.withColumn("hi", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)))
    upper = dealt.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("own"))))
    a = lower.select("unit", F.col("own").alias("lo"), "hi", F.col("itemid").alias("i"), F.col("w").alias("wi"))
    b = upper.select("unit", "lo", F.col("own").alias("hi"), F.col("itemid").alias("j"), F.col("w").alias("wj"))
    pairs = a.join(b, ["unit", "lo", "hi"]).where("lo < hi or i < j")
    return pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (F.col("wi") * F.col("wj")).alias("product"))


#: Items of a unit that are multiplied in one go.
BLOCK = 256


def products(unit: DataFrame, block: int = BLOCK) -> DataFrame:
    """unit (unit, itemid, w) -> i, j, total (of the products), co (units that have both): pairs of items, i < j, combined before the
    shuffle by pair."""
    return _pairs_of_units(unit, block).groupBy("i", "j").agg(F.sum("product").alias("total"), F.count(F.lit(1)).alias("co"))


def cosines(rows: DataFrame, s: Settings, block: int = BLOCK) -> DataFrame:
    """i, j, cosine, co (units that have both): pairs of items, i < j, combined before the shuffle by pair."""
    w = signal(rows, s)
    norms = w.groupBy("itemid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 0")
    unit = w.join(norms, "itemid").select("unit", "itemid", (F.col("w") / F.col("norm")).alias("w"))
    if s.max_user_items is not None and s.max_user_items <= block:
        a, b = unit.alias("a"), unit.alias("b")
        pairs = a.join(b, (F.col("a.unit") == F.col("b.unit")) & (F.col("a.itemid") < F.col("b.itemid"))).select(
            F.col("a.itemid").alias("i"), F.col("b.itemid").alias("j"), (F.col("a.w") * F.col("b.w")).alias("product")
        )
    else:
        pairs = _pairs_of_units(unit, block)
    return pairs.groupBy("i", "j").agg(F.sum("product").alias("cosine"), F.count(F.lit(1)).alias("co"))


def neighbours(pairs: DataFrame, s: Settings) -> DataFrame:
    """itemid, neighbor, sim, rank: shrunk cosines, the best ``k_neighbors`` of each item."""
    shrink = F.col("co") / (F.col("co") + s.shrinkage) if s.shrinkage else F.lit(1.0)
    pairs = pairs.withColumn("sim", F.col("cosine") * shrink).where("sim <> 0")
    both = F.explode(F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    both = pairs.select(both.alias("p"), "sim").select(F.col("p.i").alias("itemid"), F.col("p.j").alias("neighbor"), "sim")
    order = Window.partitionBy("itemid").orderBy(F.desc(quantised(F.col("sim"), 9)), "neighbor")
    top = both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= s.k_neighbors)
    return top.withColumn("sim", F.pow("sim", F.lit(s.similarity_power)))


def similarity(rows: DataFrame, s: Settings) -> DataFrame:
    """itemid, neighbor, sim, rank of interactions (unit, itemid, weight)."""
    return neighbours(cosines(rows, s), s)


def with_categories(similar: DataFrame, categories: DataFrame) -> DataFrame:
    """Similar items (itemid, neighbor, ...) with the categories of both, null where unknown."""
    own = categories.select("itemid", F.col("categoryid").alias("category"))
    near = categories.select(F.col("itemid").alias("neighbor"), F.col("categoryid").alias("neighbor_category"))
    return similar.join(own, "itemid", "left").join(near, "neighbor", "left")


def similar_items(sim: DataFrame, ids: DataFrame, n: int = 10) -> DataFrame:
    return sim.join(ids, "itemid", "left_semi").where(F.col("rank") <= n)


def known_items(history: DataFrame, catalog: DataFrame) -> DataFrame:
    """case_id, known: how many history rows of each case are of catalog items, repeated ones included."""
    known = history.join(catalog.withColumn("there", F.lit(1)), "itemid", "left")
    return known.groupBy("case_id").agg(F.count("there").alias("known"))


def is_known_item(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """ids (itemid) with known."""
    return ids.join(catalog.withColumn("there", F.lit(True)), "itemid", "left").select(
        "itemid", F.coalesce("there", F.lit(False)).alias("known")
    )


def _by(a: DataFrame, b: DataFrame, *names: str) -> list[str]:
    """The columns to join by: ``fit``, too, where each row tells of which fit it is."""
    return [*names, *(c for c in ("fit",) if c in a.columns and c in b.columns)]


def history_weights(profile: DataFrame, catalog: DataFrame, s) -> DataFrame:
    """case_id, pos, itemid, w of known profile items: the scheme first, then decay by known items from the end.

    s: Settings; history_weight_scheme and position_decay may be columns of the profile.
    """
    known = profile.join(catalog, _by(profile, catalog, "itemid"), "left_semi")
    log_ = F.greatest(1 + F.ln(F.greatest("weight", F.lit(1e-9))), F.lit(1e-6))
    scheme = F.lit(s.history_weight_scheme)
    w = F.when(scheme == "raw", F.col("weight")).when(scheme == "binary", F.lit(1.0)).when(scheme == "log", log_)
    back = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("pos"))) - 1
    more = [c for c in ("fit",) if c in profile.columns]
    return known.withColumn("w", w * F.pow(F.lit(s.position_decay), back)).select("case_id", "pos", "itemid", "w", *more)


def cf_scores(weights: DataFrame, sim: DataFrame, profile: DataFrame) -> DataFrame:
    """case_id, itemid, score of items that aren't in the profile."""
    on = _by(weights, sim, "itemid")
    rows = sim.select(*on, F.col("neighbor").alias("candidate"), "sim")
    got = weights.join(rows, on).groupBy("case_id", F.col("candidate").alias("itemid"))
    return got.agg(F.sum(F.col("w") * F.col("sim")).alias("score")).join(profile, ["case_id", "itemid"], "left_anti")


def predict_scores(targets: DataFrame, history: DataFrame, sim: DataFrame) -> DataFrame:
    """targets (case_id, itemid) with predicted: the mean raw weight of history items by their nearness to the target."""
    near = targets.join(sim, "itemid").select("case_id", F.col("itemid").alias("target"), F.col("neighbor").alias("itemid"), "sim")
    both = near.join(history.select("case_id", "itemid", "weight"), ["case_id", "itemid"])
    sums = both.groupBy("case_id", "target").agg(
        F.sum(F.col("sim") * F.col("weight")).alias("num"), F.sum(F.abs("sim")).alias("den")
    )
    sums = sums.select("case_id", F.col("target").alias("itemid"), F.try_divide("num", "den").alias("predicted"))
    return targets.join(sums, ["case_id", "itemid"], "left")
