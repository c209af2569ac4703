"""Sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nextcover.operators.ordered import first_by
from nextcover.session import setting


def replace_table(df: DataFrame, name: str, partition_by: list[str] | None = None,
                  merge_schema: bool = False) -> None:
    """Replace a table, or with ``partition_by`` only the partitions that occur in ``df``.

    Whether other partitions stay is up to this function, whatever the session's overwrite mode:
    Spark reads the mode of an insert from the session and not from the write's options, so it is
    set for this one statement. ``merge_schema`` keeps columns of the existing table that ``df`` lacks, as nulls, and
    accepts new ones.
    """
    spark = df.sparkSession
    exists = spark.catalog.tableExists(name)
    if merge_schema and exists:
        known = spark.table(name).schema.fields
        df = df.select(
            *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in known],
            *[c for c in df.columns if c not in [f.name for f in known]],
        )
    if partition_by and exists and not merge_schema:
        columns = spark.table(name).columns
        with setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            df.select(*columns).write.mode("overwrite").insertInto(name, overwrite=True)
        return
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        # rows of a partition value stay spread over tasks; each task writes sorted runs
        writer = df.sortWithinPartitions(*partition_by).write.mode("overwrite").format("parquet")
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def store_by_client(df: DataFrame, name: str, key: str = "party_id", buckets: int = 200) -> None:
    """Replace a table, dealt out and sorted by client. Tables stored with the same ``buckets`` join
    and aggregate by client without moving rows, run after run; the number should give a bucket
    the size of a task at the largest month. Each bucket is one file, as rows are dealt out first.
    """
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))


def unseen_rows(df: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not in ``existing`` yet."""
    return df.join(existing.select(*key), key, "left_anti")


def _literal(value: int | str) -> str:
    if isinstance(value, int):
        return str(value)
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _described(spark: SparkSession, name: str, field: str, partition: str = "") -> str | None:
    """A line of the description: a partition's own comes before its table's."""
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {name} {partition}").filter(F.col("col_name") == field).select("data_type").collect()
    return found[0][0] if found else None


def _removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_run(df: DataFrame, name: str, run: str, value: int | str, key: list[str], order: list[Column]) -> None:
    """Store one run (a month, say) as the partition ``run = value`` of a table, in place of what
    the table has of that run. Other runs are not touched and not read.

    Of rows with one key the first by ``order`` is kept, so ``order`` must tell them apart. The rows
    are written to a folder of their own, and only then does the catalogue point the partition at
    it, in one step: readers see the run before or the whole new one. A write that fails or is
    killed leaves a folder that nothing refers to, and the same run can simply be written again.
    """
    spark = df.sparkSession
    rows = first_by(df.drop(run), key, order)
    if not spark.catalog.tableExists(name):
        empty = spark.createDataFrame([], rows.schema).withColumn(run, F.lit(value))
        empty.write.format("parquet").partitionBy(run).saveAsTable(name)
    columns = [c for c in spark.table(name).columns if c != run]
    folder = f"{_described(spark, name, 'Location').rstrip('/')}/_runs/{uuid.uuid4().hex}"
    rows.select(*columns).write.parquet(folder)

    partition = f"PARTITION ({run} = {_literal(value)})"
    before = None
    if spark.sql(f"SHOW PARTITIONS {name} {partition}").isEmpty():
        spark.sql(f"ALTER TABLE {name} ADD {partition} LOCATION {_literal(folder)}")
    else:
        before = _described(spark, name, "Location", partition)
        spark.sql(f"ALTER TABLE {name} {partition} SET LOCATION {_literal(folder)}")
    spark.catalog.refreshTable(name)
    if before and "/_runs/" in before:
        _removed(spark, before)


def write_splits(splits: dict[str, DataFrame], path: str) -> None:
    for part, frame in splits.items():
        frame.write.mode("overwrite").parquet(f"{path}/{part}")


def as_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def write_metadata(rows: DataFrame, name: str) -> None:
    """Model metadata, one row per product and training month; a month is replaced as a whole."""
    replace_table(rows, name, partition_by=["training_month"])


def stage_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows at each stage, in stage order."""
    parts = [
        f.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("stage_no"), F.lit(s).alias("stage"), "rows")
        for i, (s, f) in enumerate(frames.items(), 1)
    ]
    return reduce(DataFrame.unionAll, parts)
