"""Registered queries: a Spark function over the bound tables and, where SQL can say it, the
DuckDB text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nextcover.session import tune
from workload.views import Tables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register a function of ``Tables``. ``sql`` may use every view of ``workload.views``."""

    def add(build):
        key = name or build.__name__
        if key in REGISTRY:
            raise ValueError(f"registered twice: {key}")
        REGISTRY[key] = Query(key, covers, build, with_views(sql) if sql else None)
        return build

    return add


def rounded(c, digits: int):
    """Rounding by scaling, the way DuckDB rounds, so that exact halves agree."""
    scale = float(10**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * scale) / scale


def comparable(df: DataFrame) -> DataFrame:
    """Plain types for the comparison: whole numbers as bigint, doubles to six digits, dates as
    text, arrays as comma-separated text."""
    out = []
    for f in df.schema.fields:
        c, t = f"`{f.name}`", f.dataType
        if isinstance(t, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            text = f"CAST({c} AS BIGINT)"
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            # adding zero turns -0.0 into 0.0
            text = f"round(CAST({c} AS DOUBLE) * 1e6D) / 1e6D + 0D"
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            text = f"CAST({c} AS STRING)"
        elif isinstance(t, T.ArrayType):
            text = f"array_join(CAST({c} AS ARRAY<STRING>), ',', 'null')"
        else:
            text = c
        out.append(f"{text} AS {c}")
    return df.selectExpr(*out)


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(q.build(Tables(tune(spark), sf_dir)))

    return run
