"""Helpers shared by the training-data operators.

Rows are identified by ``(doc_id, text)``: a null ``doc_id`` is carried as the largest long (it sorts after every
id and comes back as null), a null text counts as empty.  Operators read only ``doc_id`` and ``text`` (plus
the columns that they name), so further columns, whatever their names, cannot clash.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = 2**63 - 1
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_rows(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` long without nulls, ``text`` without nulls, and the columns named in ``more``."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def public_id(col: str | Column = "doc_id") -> Column:
    """Undoes what doc_rows does to a null id."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != F.lit(NULL_ID), c)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only a local session may do without one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trailmark-{name}-{uuid.uuid4().hex}"


#: Paths of tables that an open ``scratch`` removes at its end.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` made within are removed at the end: what is still needed must be written with ``keep``."""
    _scratch.append([])
    try:
        yield
    finally:
        remove(spark, _scratch.pop())


def remove(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it holds more than one in HOT of all rows, so at most HOT keys are.
HOT = 1000


def spread_join(
    rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner", total: int | None = None
) -> DataFrame:
    """``rows`` joined with a written ``table`` of one row a key, whose column ``count`` tells how many of ``rows`` a key has.

    Rows of hot keys meet the at most HOT rows of the table by broadcast, wherever they are; only the others are shuffled.
    """
    total = rows.count() if total is None else total
    hot = F.col(count) * HOT > total
    few = F.broadcast(table.where(hot))
    rest = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(rest.join(table.where(~hot), keys, how))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
