"""Exact deduplication by deterministic block naming.

Every text is cut into fixed-size blocks; the distinct blocks are sorted and named with integers.  Then adjacent names
are paired and the distinct pairs named, again and again, until each document has one name: two documents
have the same (level, name) if and only if their texts are equal.  Only DataFrame functions are used.

Scale: block texts are shuffled once, after map-side deduplication; from then on rows are a few integers.  Rows
find their name by the block's 64-bit hash; where two different blocks share a hash (counted, not assumed),
those blocks are named and joined by their text instead.  A key that holds a large share of the rows is combined
before the shuffle on the naming side and split by AQE's skew join on the row side.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, public_id, written

BLOCK = 2048


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` does the same, faster, where every character is one byte."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def _blocks(docs: DataFrame, block_size: int, *more: Column) -> DataFrame:
    texts = docs.select(*more, F.col("text"), ascii_lower(F.col("text")).alias("norm"))
    cut = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_size}}}"), F.lit(0))
    )
    return texts.withColumn("blocks", cut)


def _stats() -> list[Column]:
    """Of the documents that a name stands for alone: how many, and which row is the largest."""
    return [
        F.count_if("alone").alias("group_size"),
        F.max(F.when(F.col("alone"), F.struct("doc_id", "row_id"))).alias("keep"),
    ]


def _name(rows: DataFrame, keys: list[str], first: int = 0) -> DataFrame:
    """One row for each distinct key, sorted and numbered within its partition, written once so that names stay."""
    named = rows.groupBy(*keys).agg(*_stats()).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()
    return named.withColumn("name", number if not first else F.lit(-1).cast("long") - number)


def _hashed(docs: DataFrame, block_size: int) -> tuple[DataFrame, DataFrame]:
    """(row_id, doc_id, alone, own, n, i, h: a row for each block of each document; h, name: the distinct blocks)."""
    n = F.size("blocks")
    hashed = _blocks(docs, block_size, F.col("row_id"), F.col("doc_id")).select(
        "row_id",
        "doc_id",
        (n == 1).alias("alone"),
        F.struct(F.unhex(F.sha2("norm", 256)).alias("sha"), F.xxhash64("text").alias("rk")).alias("own"),
        n.alias("n"),
        F.posexplode(F.transform("blocks", lambda b: F.xxhash64(b))).alias("i", "h"),
    )
    rows = written(hashed.withColumn("own", F.when(F.col("i") == 0, F.col("own"))), "blocks")
    # The distinct blocks with their hash: the one shuffle of text.  Names come from the sorted blocks.
    texts = _blocks(docs, block_size).select(F.explode("blocks").alias("block")).select(F.xxhash64("block").alias("h"), "block")
    distinct = texts.groupBy("h", "block").agg(F.lit(1).alias("one")).sortWithinPartitions("block", "h")
    return rows, written(distinct.select("h", F.monotonically_increasing_id().alias("name")), "names")


def exact_groups(docs: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (hex, of the normalised text), rk (a
    hash of the text).

    Null text: empty; all empty texts are one group.  Rows repeated with the same doc_id are members like any other
    and exactly one row of a group is kept (the later one among equal ids).  A null doc_id sorts after all ids.
    An empty table gives an empty result.
    """
    docs = doc_rows(docs).withColumn("row_id", F.monotonically_increasing_id())
    rows, names = _hashed(docs, block_size)
    clash = names.groupBy("h").count().where("count > 1").select("h")
    if clash.take(1):
        # Written first, as row numbers needn't repeat in another pass over ``docs``.
        docs = written(docs, "rows")
        rows, names = _hashed(docs, block_size)
        clash = written(names.groupBy("h").count().where("count > 1").select("h"), "clash")
        again = _blocks(docs, block_size, F.col("row_id")).select("row_id", F.posexplode("blocks").alias("i", "block"))
        again = again.withColumn("h", F.xxhash64("block")).join(clash, "h", "left_semi")
        apart = again.groupBy("h", "block").agg(F.lit(1).alias("one")).sortWithinPartitions("block")
        apart = written(apart.select("h", "block", (F.lit(-1) - F.monotonically_increasing_id()).alias("name")), "apart")
        again = again.join(apart, ["h", "block"]).select("row_id", "i", "name")
        named = rows.join(clash, "h", "left_anti").join(names, "h").drop("h").unionByName(
            rows.join(clash, "h", "left_semi").join(again, ["row_id", "i"]).drop("h")
        )
    else:
        named = rows.join(names, "h").drop("h")
    named = written(named, "named")

    done = []
    most = rows.agg(F.max("n")).first()[0] or 0
    alone = named.where("alone")
    done.append(_with_stats(alone, alone.groupBy("name").agg(*_stats()), ["name"]))
    level = named.where("not alone")
    while most > 1:
        pairs = (
            level.groupBy("row_id", (F.col("i") / 2).cast("int").alias("i"))
            .agg(
                F.first("doc_id").alias("doc_id"),
                F.first("n").alias("n"),
                F.max("own").alias("own"),
                F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
                F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("b"),
            )
            .withColumn("n", ((F.col("n") + 1) / 2).cast("int"))
            .withColumn("alone", F.col("n") == 1)
            .withColumn("has_b", F.col("b").isNotNull())
            .withColumn("b", F.coalesce("b", F.lit(0)))
        )
        pairs = written(pairs, "pairs")
        keys = ["a", "b", "has_b"]
        names = written(_name(pairs, keys), "names")
        alone = pairs.where("alone")
        done.append(_with_stats(alone, names.where("group_size > 0"), keys))
        # Not written: only the next round's pairs read it.
        level = pairs.where("not alone").join(names.select(*keys, "name"), keys)
        most = (most + 1) // 2
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _with_stats(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    return (
        rows.select(*keys, "row_id", "doc_id", "own")
        .join(stats.select(*keys, "group_size", "keep"), keys)
        .select(
            public_id().alias("doc_id"),
            public_id(F.col("keep.doc_id")).alias("keep_id"),
            "group_size",
            (F.col("keep.row_id") == F.col("row_id")).alias("kept"),
            F.lower(F.hex("own.sha")).alias("text_sha256"),
            F.col("own.rk").alias("rk"),
        )
    )
