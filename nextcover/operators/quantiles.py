"""Exact ranks and exact quantiles without a single-task sort.

Rows are first counted per distinct value, which also folds a value that a third of the rows
share into one row. The distinct values of all groups are cut into slices at values of their own,
about one in ``SLICE_VALUES`` by hash (see ``ordered.cuts``); they are numbered inside each slice
and shifted by the number of rows in their group's lower slices. So slices hold about equally many
values wherever these lie: heavy tails, or a million values within a thousandth of each other. The
cuts are a function of the values; nothing is estimated and every use of the slices agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nextcover.operators.ordered import bound, cuts, place

#: distinct values that one task numbers
SLICE_VALUES = 100_000


def with_fitted(df: DataFrame, fitted: DataFrame, name: str = "_fit") -> DataFrame:
    """Attach the single row of a fitted frame as a struct column.

    It is a scalar subquery, evaluated once before the scan of ``df`` starts. Having it as one
    column keeps its plan from being repeated for every use.
    """
    return df.withColumn(name, fitted.select(F.struct(*fitted.columns)).scalar())


def quantile_row(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """One row with the array of quantiles of every column."""
    fitted = column_quantiles(df, columns, probabilities)
    return fitted.agg(*[F.expr(f"max(CASE WHEN column = '{c}' THEN q END)").alias(c) for c in columns])


def unpivoted(df: DataFrame, columns: list[str], keep: list[str] | None = None,
              name: str = "column", value: str = "value") -> DataFrame:
    """Numeric columns as (name, value) rows, nulls left out."""
    keep = keep or []
    return (
        df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(keep, columns, name, value)
        .filter(F.col(value).isNotNull())
    )


def value_slices(df: DataFrame, groups: list[str], value: str, slice_values: int = SLICE_VALUES) -> DataFrame:
    """Distinct values of each group with ``n`` rows and ``_slice``, a number that rises with
    (group, value); nulls are left out, NaN is the largest."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    order = [*groups, value]
    with_cuts = counts.withColumn("_cuts", cuts(counts, order, slice_values, also=["n"]))
    return with_cuts.withColumn("_slice", bound(F.col("_cuts"), lambda c: place(c, order))).drop("_cuts")


def value_ranks(df: DataFrame, groups: list[str], value: str, slice_values: int = SLICE_VALUES) -> DataFrame:
    """Per distinct value of each group: ``n`` rows, ``before`` rows with a smaller value,
    ``total`` rows.
    """
    sliced = value_slices(df, groups, value, slice_values)
    sizes = sliced.groupBy(*groups, "_slice").agg(F.sum("n").alias("_size"))
    lower = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*groups, "_slice", F.coalesce(F.sum("_size").over(lower), F.lit(0)).alias("_shift"),
                          F.sum("_size").over(Window.partitionBy(*groups)).alias("total"))
    inside = Window.partitionBy(*groups, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("_local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(shifts, [*groups, "_slice"])
        .select(*groups, value, "n", (F.col("_local") + F.col("_shift")).alias("before"), "total")
    )


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """Interpolated quantiles, long form: groups, ``p``, ``quantile``."""
    ranks = value_ranks(df, groups, value)
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    span_end = F.col("before") + F.col("n")

    def target(p: Column) -> Column:
        at = p * (F.col("total") - 1)
        return F.struct(p.alias("p"), F.floor(at).alias("lo"), F.ceil(at).alias("hi"), (at - F.floor(at)).alias("w"))

    def inside(i: Column) -> Column:
        return (i >= F.col("before")) & (i < span_end)

    hits = ranks.select(
        *groups, value, "before", "n",
        F.explode(F.filter(F.transform(wanted, target), lambda t: inside(t["lo"]) | inside(t["hi"]))).alias("t"),
    )
    low = F.max(F.when(inside(F.col("t.lo")), F.col(value)))
    high = F.max(F.when(inside(F.col("t.hi")), F.col(value)))
    return (
        hits.groupBy(*groups, F.col("t.p").alias("p"))
        .agg(low.alias("_lo"), high.alias("_hi"), F.max("t.w").alias("_w"))
        .select(*groups, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")).alias("quantile"))
    )


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], exact: bool = True) -> DataFrame:
    """One row per column with an array of quantiles ``q`` in the order of ``probabilities``."""
    long = unpivoted(df, columns)
    if not exact:
        return long.groupBy("column").agg(F.percentile_approx("value", probabilities, 10000).alias("q"))
    points = exact_quantiles(long, ["column"], "value", probabilities)
    return points.groupBy("column").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("p", "quantile"))), lambda s: s["quantile"]).alias("q")
    )
