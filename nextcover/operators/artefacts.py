"""Stored models: fitted pipelines in folders, described by a row of the metadata table.

A model is written to a folder of its own; its metadata row, which names the folder, is replaced
afterwards, so a row never points at a half-written model. A stored model serves as long as it fits
the data at hand, else it is fitted anew and stored in its place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nextcover.operators.clean import compatible
from nextcover.sources.writers import write_metadata

METADATA = "product string, features array<string>, classes array<string>, model_path string, training_month int"


def stored_row(spark: SparkSession, table: str, product: str, month: int) -> dict | None:
    """The product's newest metadata row up to a month: one row, by its key."""
    if not spark.catalog.tableExists(table):
        return None
    rows = spark.table(table).filter((F.col("product") == product) & (F.col("training_month") <= month))
    found = rows.orderBy(F.desc("training_month"), "model_path").limit(1).collect()
    return found[0].asDict() if found else None


def store_model(spark: SparkSession, model: PipelineModel, table: str, folder: str, product: str, month: int,
                features: list[str], classes: list) -> str:
    """Write a model and put its row into the metadata table, beside the month's other products."""
    path = f"{folder.rstrip('/')}/{product}/{month}-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.createDataFrame([(product, features, [str(c) for c in classes], path, month)], METADATA)
    if spark.catalog.tableExists(table):
        others = spark.table(table).filter((F.col("training_month") == month) & (F.col("product") != product))
        # read before the month's partition is replaced; a row per product
        rows = rows.unionByName(spark.createDataFrame(others.select(*rows.columns).collect(), METADATA))
    write_metadata(rows, table)
    return path


def model_for(spark: SparkSession, table: str, folder: str, product: str, month: int, features: list[str], classes: list,
              fit: Callable[[], PipelineModel]) -> tuple[PipelineModel, bool]:
    """The stored model where there is one with as many features and classes, else a new one, which
    is stored; and whether it was fitted now."""
    row = stored_row(spark, table, product, month)
    if row is not None and compatible(row, features, classes):
        return PipelineModel.load(row["model_path"]), False
    model = fit()
    store_model(spark, model, table, folder, product, month, features, classes)
    return model, True
