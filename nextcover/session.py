"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "16g",
                  settings: dict[str, str] | None = None) -> SparkSession:
    """Session for tests and the benchmark. On a cluster, submit with its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("nextcover")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # column building asks for the Python call site of every operation otherwise
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in (settings or {}).items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Settings of a running session that the plans count on.

    Generated methods above 8000 bytes are never compiled by the JVM and run interpreted; the
    rule cascades and flag projections pass that size, so such stages fall back to smaller
    methods, which are compiled.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the statements inside, put back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write an intermediate to the session's checkpoint folder, or the one it names in
    ``spark.checkpoint.dir`` (shared by all executors on a cluster), and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(folder)
    return df.checkpoint()
