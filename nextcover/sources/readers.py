"""Sources. All of them return lazy frames; none takes a value to the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_sql(spark: SparkSession, sql: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """SQL text with ``:name`` parameters and ``{frame}`` references."""
    return spark.sql(sql, args=args, **frames) if args else spark.sql(sql, **frames)


def read_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_csv_tolerant(spark: SparkSession, path: str, schema: str, bad: str = "drop",
                      quote: str = '"', header: bool = True) -> DataFrame:
    """CSV with a declared schema and a choice for lines that do not fit it.

    ``drop`` skips them, ``permissive`` keeps them with the raw text in ``_corrupt_record``,
    ``fail`` stops. An empty ``quote`` reads quotes as plain characters.
    """
    modes = {"drop": "PERMISSIVE", "permissive": "PERMISSIVE", "fail": "FAILFAST"}
    if bad != "fail":
        schema = f"{schema}, _corrupt_record string"
    lines = (
        spark.read.schema(schema)
        .options(header=header, quote=quote, mode=modes[bad], columnNameOfCorruptRecord="_corrupt_record")
        .csv(path)
    )
    # Spark parses only the columns a query uses, and finds only their errors. This condition
    # is always true and uses all of them, so that which lines are bad never depends on the query.
    columns = [c for c in lines.columns if c != "_corrupt_record"]
    parsed = lines.filter(F.length(F.concat_ws("", *[F.col(c).cast("string") for c in columns])) >= 0)
    return parsed.filter("_corrupt_record IS NULL").select(*columns) if bad == "drop" else parsed


def latest_month(df: DataFrame, month_col: str = "business_month", within: Column | None = None) -> DataFrame:
    """Rows of the newest month. The maximum is a subquery inside the same plan.

    With ``within`` both the rows and the maximum are restricted to it.
    """
    scope = df if within is None else df.filter(within)
    return scope.filter(F.col(month_col) == scope.select(F.max(month_col)).scalar())


def partition_values(spark: SparkSession, name: str, column: str) -> list[str]:
    """The values of a partition column, from the catalogue; no data is read."""
    shown = spark.sql(f"SHOW PARTITIONS {name}").select(F.regexp_extract("partition", f"(?:^|/){column}=([^/]*)", 1).alias("v"))
    return [r["v"] for r in shown.distinct().collect()]


def latest_partition(spark: SparkSession, name: str, month_col: str = "business_month") -> DataFrame:
    """Rows of the newest month of a table that is partitioned by month (a whole number).

    The maximum comes from the catalogue's list of partitions, so the filter is a constant: only
    that partition's files are listed and read. A table without partitions gives no row.
    """
    months = [int(v) for v in partition_values(spark, name, month_col) if v.isdigit()]
    return spark.table(name).filter(F.col(month_col) == max(months) if months else F.lit(False))


def up_to_month(df: DataFrame, month, month_col: str = "business_month") -> DataFrame:
    return df.filter(F.col(month_col) <= month)


def select_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in columns if c in df.columns])


def rows_df(spark: SparkSession, rows: list, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def read_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """The table with the declared columns, or an empty frame when it does not exist.

    Columns the table lacks come back as null.
    """
    empty = spark.createDataFrame([], schema)
    if not spark.catalog.tableExists(name):
        return empty
    table = spark.table(name)
    return table.select(*[
        (F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in empty.schema.fields
    ])


def read_feature_sets(metadata: DataFrame, month) -> DataFrame:
    """Feature lists of the newest training month up to ``month``, one row per product."""
    known = metadata.filter(F.col("training_month") <= month)
    return latest_month(known, "training_month").select("product", "training_month", "features")


def clean_name(name: str) -> str:
    """Trimmed, with every run-free non-alphanumeric character as an underscore."""
    return re.sub(r"[^0-9A-Za-z_]", "_", name.strip())
