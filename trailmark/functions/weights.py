"""Weights of interactions: recency, saturation schemes, idf."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.config import BM25_B, BM25_K1, HALF_LIFE_DAYS


def quantised(c: Column, digits: int = 6) -> Column:
    """The same rounding in any engine."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def with_recency(log: DataFrame, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """weight_recent: the weight halves with each half-life before the log's latest event."""
    latest = log.agg(F.max("ts").alias("latest"))  # one row
    age = (F.col("latest") - F.col("ts")) / F.lit(86_400_000_000.0)
    return (
        log.join(F.broadcast(latest))
        .withColumn("weight_recent", F.col("weight") * F.exp(F.lit(-math.log(2) / half_life_days) * age))
        .drop("latest")
    )


def saturated(interactions: DataFrame, scheme: str, n_items: Column | None = None, total: DataFrame | None = None) -> DataFrame:
    """interactions (unit, itemid, weight) with w.  bm25 needs the mean item length over the whole catalog: ``total``."""
    if scheme == "raw":
        return interactions.withColumn("w", F.col("weight"))
    if scheme == "binary":
        return interactions.withColumn("w", F.lit(1.0))
    if scheme == "log":
        return interactions.withColumn("w", 1 + F.ln("weight"))
    if scheme != "bm25":
        raise ValueError(f"unknown scheme {scheme!r}")
    catalog = total if total is not None else interactions
    lengths = interactions.groupBy("itemid").agg(F.sum("weight").alias("len"))
    items = catalog.agg(F.countDistinct("itemid").alias("n_items"))
    mean = interactions.agg(F.sum("weight").alias("all")).join(items).select((F.col("all") / F.col("n_items")).alias("mean_len"))
    scale = (1 - BM25_B) + BM25_B * F.col("len") / F.col("mean_len")
    w = F.col("weight") * (BM25_K1 + 1) / (F.col("weight") + BM25_K1 * scale)
    return interactions.join(lengths, "itemid").join(F.broadcast(mean)).withColumn("w", w).drop("len", "mean_len")


def user_idf(interactions: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """unit, idf = ln(1 + items / (1 + items of the unit))."""
    items = (catalog if catalog is not None else interactions).agg(F.countDistinct("itemid").alias("n_items"))
    own = interactions.groupBy("unit").agg(F.count(F.lit(1)).alias("k"))
    return own.join(F.broadcast(items)).select("unit", F.ln(1 + F.col("n_items") / (1 + F.col("k"))).alias("idf"))
