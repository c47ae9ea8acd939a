"""The bounded labelled sample that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, doc_rows


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, by ``modulus``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, size: int, most_bytes: int, *more: str) -> DataFrame:
    """doc_id, text, label (0 or 1) and the columns ``more`` of labelled documents: of each label ``size`` ids at most, those
    of the least hash, and of their texts as many in this order as ``most_bytes`` hold.

    A text of over a hundredth of most_bytes isn't learned from.  Labels that are null or of null ids don't count;
    repeated ones of an id count once, as the highest; of rows of one id the least text counts.
    learn_from: a condition on doc_id.  The ids are at most 2 x ``size`` rows, so they are broadcast.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    ids = ids.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.where(learn_from)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [ids.where(F.col("label") == x).orderBy(*order).limit(size) for x in (0, 1)]
    rows = doc_rows(docs, *more).where((F.col("doc_id") != F.lit(NULL_ID)) & (F.octet_length("text") <= most_bytes // 100))
    rows = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    names = [c for c in rows.columns if c not in ("doc_id", "label")]
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(*names)).alias("own")).select("doc_id", "label", "own.*")
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(*order))  # 2 x size rows at most
    return rows.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).drop("so_far")
