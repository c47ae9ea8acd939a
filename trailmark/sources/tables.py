"""Reading logs and metadata, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

EVENTS_SCHEMA = "timestamp long, visitorid long, event string, itemid long, transactionid long"
PROPERTIES_SCHEMA = "timestamp long, itemid long, property string, value string"
TREE_SCHEMA = "categoryid long, parentid long"


#: What each open ``scratch`` does at its end.
_scratch: list[list[Callable[[], object]]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list]:
    """Paths that ``new_path`` gave within, and the tables in them, are removed at the end, but for those asked to be kept."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        for end in reversed(_scratch.pop()):
            end()


def at_the_end(action: Callable[[], object]) -> None:
    """``action`` is done when the innermost scratch ends; never, if none is open."""
    if _scratch:
        _scratch[-1].append(action)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder in ``spark.checkpoint.dir``; only a local session may do without that."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        path = spark.sparkContext.getCheckpointDir()
    path = f"{path.rstrip('/')}/trailmark-{name}-{uuid.uuid4().hex}"
    if not keep:
        at_the_end(lambda: remove(spark, path))
    return path


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts lineage."""
    spark = df.sparkSession
    path = new_path(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``written``, in as many buckets of ``key`` as a shuffle has partitions, one sorted file each: joins by ``key`` leave it in place."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"trailmark_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
    at_the_end(lambda: spark.sql(f"DROP TABLE IF EXISTS {table}"))  # the files go with their path
    return spark.table(table)


@contextmanager
def dealt_by_one_key(spark: SparkSession) -> Iterator[None]:
    """Plans made within join by several keys where rows lie, if both sides are dealt by one of them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives.  If it wrote tables on its way, they are removed, and the result is a table of its own."""
    with scratch(spark) as own:
        out = make()
        return written(out, "result", keep=True) if own else out


def written_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``written``, and how many rows there are, counted while they are written."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return table, seen.get.get("n", 0)


def event_weight(event: Column, weights: dict[str, float]) -> Column:
    out = F.when(F.lit(False), F.lit(1.0))
    for name, w in weights.items():
        out = out.when(event == name, F.lit(w))
    return out.otherwise(F.lit(1.0))


def load_events(spark: SparkSession, path: str, weights: dict[str, float]) -> DataFrame:
    """A click log in CSV: visitorid, itemid, ts (microseconds), eid (ties), event, weight.

    eid is the place in the log as it is read; where files or their parts may come in another order, simultaneous events of
    a visitor may, too.
    """
    log = spark.read.schema(EVENTS_SCHEMA).csv(path, header=True)
    return log.select(
        "visitorid",
        "itemid",
        (F.col("timestamp") * 1000).alias("ts"),
        F.monotonically_increasing_id().alias("eid"),
        "event",
        event_weight(F.col("event"), weights).alias("weight"),
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("user_id").alias("visitorid"),
        F.get_json_object("props", "$.k").cast("long").alias("itemid"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("eid"),
        F.col("event_type").alias("event"),
        event_weight(F.col("event_type"), {"view": 1.0, "click": 4.0, "purchase": 10.0}).alias("weight"),
    )


def purchase_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("visitorid"),
        F.col("l_partkey").alias("itemid"),
        event_weight(F.col("l_returnflag"), {"N": 1.0, "A": 4.0, "R": 10.0}).alias("weight"),
    )


def item_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """itemid, categoryid: 99 and the brand's number."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(
        F.col("p_partkey").alias("itemid"), (F.substring("p_brand", 7, 9).cast("long") + 99).alias("categoryid")
    )


def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """categoryid, parentid: nations under regions, which have no parent."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    return nation.select(
        (F.col("n_nationkey") + 100).cast("long").alias("categoryid"), F.col("n_regionkey").cast("long").alias("parentid")
    ).unionByName(region.select(F.col("r_regionkey").cast("long").alias("categoryid"), F.lit(None).cast("long").alias("parentid")))


def load_category_map(spark: SparkSession, paths: list[str]) -> DataFrame:
    from trailmark.operators.metadata import latest_category

    return latest_category(spark.read.schema(PROPERTIES_SCHEMA).csv(paths, header=True))


def load_category_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREE_SCHEMA).csv(path, header=True)
