"""A fitted model as a folder of Parquet tables and a manifest.

``sim`` and ``steps`` are bucketed and sorted by the item that scoring looks up, one file a bucket: a loaded model is scored without moving
them, only the histories are shuffled.  Histories are merged into by later parts of the log (see merged).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.config import Settings
from trailmark.operators.hybrid import Model
from trailmark.sources import merged
from trailmark.sources.tables import at_the_end, remove

VERSION = 2
TABLES = ("vectors", "sim", "steps", "scores", "lists", "categories")
BUCKETED = {"sim": "itemid", "steps": "prev_item"}


def _narrow(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"})


def _write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    name = f"trailmark_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    rows.mode("overwrite").format("parquet").option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay


def save(model: Model, path: str, buckets: int | None = None) -> str:
    """Doubles are stored as floats, as they are large in number and small in need.  An attached history goes along, as it is.

    buckets: of similarities and steps; as many as a shuffle has partitions if not told.
    """
    spark = model.vectors.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = {t: _narrow(getattr(model, t)) for t in TABLES if getattr(model, t) is not None}
    for name, df in tables.items():
        if name in BUCKETED:
            remove(spark, f"{path}/{name}")
            _write_bucketed(df, f"{path}/{name}", BUCKETED[name], buckets)
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    for name in ("history", "recent"):
        remove(spark, f"{path}/{name}")
    if model.history is not None:
        merged.merge(f"{path}/history", "case_id", model.history, lambda _, new: new)
    about = {
        "format_version": VERSION,
        "settings": asdict(model.settings),
        "tables": {t: ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes) for t, df in tables.items()},
        "buckets": buckets,
        "saved": uuid.uuid4().hex,
    }
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return path


def attach_history(log: DataFrame, path: str) -> str:
    """Merges a log, or a further part of it, into the histories and latest items of a saved model."""
    merged.merge_history(f"{path}/history", log)
    merged.merge_recent(f"{path}/recent", log)
    return path


def load(spark: SparkSession, path: str) -> Model:
    """The bucketed tables are registered under names of their own in the session's catalog, as only a table can tell its buckets."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest["format_version"] != VERSION:
        raise ValueError(f"the artifact has format {manifest['format_version']}, not {VERSION}")

    def table(name: str) -> DataFrame | None:
        if name not in manifest["tables"]:
            return None
        if name in BUCKETED:
            known, key = f"trailmark_{name}_{manifest['saved']}", BUCKETED[name]
            at = f"{path}/{name}".replace("'", "''")
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {known} ({manifest['tables'][name]}) USING parquet"
                f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {manifest['buckets']} BUCKETS LOCATION '{at}'"
            )
            df = spark.table(known)
            at_the_end(lambda: spark.sql(f"DROP TABLE IF EXISTS {known}"))
        else:
            df = spark.read.parquet(f"{path}/{name}")
        return df.withColumns({c: F.col(c).cast("double") for c, t in df.dtypes if t == "float"})

    def attached(name: str) -> DataFrame | None:
        rows = merged.read(spark, f"{path}/{name}")
        return rows.drop("part") if rows is not None else None

    model = Model(Settings(**manifest["settings"]), *(table(t) for t in TABLES))
    model.history, model.recent = attached("history"), attached("recent")
    return model
