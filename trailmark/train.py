"""python -m trailmark.train --events LOG.csv --output FOLDER: fits a model, saves it and holds the saved one against it."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.config import EVENT_WEIGHTS, TUNED, Settings
from trailmark.operators.hybrid import Model, fit, recommend
from trailmark.sources import artifact, merged, tables


def probe(model: Model, n: int = 10) -> list[int]:
    """What is suggested to someone who has done one thing with the catalog's first item."""
    first = model.catalog.agg(F.min("itemid").alias("itemid")).where("itemid is not null")
    history = first.select(F.lit(0).cast("long").alias("case_id"), F.lit(1).cast("long").alias("pos"), "itemid", F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("last_ts"))
    cases = first.select(F.lit(0).cast("long").alias("case_id"), F.lit(None).cast("long").alias("category"))
    return [r["itemid"] for r in recommend(model, cases, history, n).orderBy("rank").collect()]  # n rows


def train_and_verify(log: DataFrame, categories: DataFrame, s: Settings, path: str, with_history: bool = False) -> Model:
    """The model as it is loaded; a ValueError if it suggests something else than the one that was saved."""
    model = fit(log, categories, s)
    artifact.save(model, path)
    if with_history:
        artifact.attach_history(log, path)
    again = artifact.load(log.sparkSession, path)
    if not again.ready or probe(model) != probe(again):
        raise ValueError(f"the model saved in {path} doesn't suggest what the fitted one does")
    return again


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="trailmark.train", description=__doc__)
    parser.add_argument("--events", required=True, help="the click log in CSV, a file or a folder")
    parser.add_argument("--output", required=True, help="the folder of the model")
    parser.add_argument("--properties", nargs="*", default=[], help="item properties in CSV, for categories")
    parser.add_argument("--category-map", help="a stored category map, which properties are merged into")
    parser.add_argument("--include-history", action="store_true", help="attach the visitors' histories")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    log = tables.load_events(spark, args.events, EVENT_WEIGHTS)
    properties = spark.read.schema(tables.PROPERTIES_SCHEMA).csv(args.properties, header=True) if args.properties else None
    if args.category_map:
        if properties is not None:
            merged.merge_categories(args.category_map, properties)
        categories = merged.category_map(spark, args.category_map)
    elif properties is not None:
        categories = tables.load_category_map(spark, args.properties)
    else:
        categories = spark.createDataFrame([], "itemid long, categoryid long")
    model = train_and_verify(log, tables.written(categories, "categories"), TUNED, args.output, args.include_history)
    edges = {"similarities": model.sim, "steps": model.steps, "histories": model.history}
    print(f"catalog: {model.catalog_size()} items")
    for name, df in edges.items():
        print(f"{name}: {df.count() if df is not None else 0}")
    print(f"the model in {args.output} suggests what the fitted one does")


if __name__ == "__main__":
    main()
