"""Scalar column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_of(value) -> Column:
    """A date column, or a literal date given as text or ``datetime.date``."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def flag(condition: str | Column) -> Column:
    """1 where the condition (a column or SQL text) holds, 0 where it is false or null."""
    if isinstance(condition, str):
        return F.expr(f"CASE WHEN {condition} THEN 1 ELSE 0 END")
    return F.when(condition, 1).otherwise(0)


def normalize_code(c: str | Column) -> Column:
    """Strip leading zeros and keep inner ones; blanks count as zeros on the way."""
    blanked = F.ltrim(F.replace(col(c), F.lit("0"), F.lit(" ")))
    return F.trim(F.upper(F.replace(blanked, F.lit(" "), F.lit("0"))))


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Quotient, null where the denominator is zero or null."""
    return col(numerator) / F.nullif(col(denominator), F.lit(0))


def plus_one_ratio(numerator: str | Column, denominator: str | Column, missing=0) -> Column:
    """Quotient with one added below, missing inputs replaced first."""
    return F.coalesce(col(numerator), F.lit(0)) / (F.coalesce(col(denominator), F.lit(missing)) + 1)


def finite(c: str | Column) -> Column:
    """Null for NaN and both infinities."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def correlation(a: str | Column, b: str | Column) -> Column:
    """Aggregate correlation over rows with both values; null where one of them is constant."""
    a, b = col(a).cast("double"), col(b).cast("double")
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def log_amount(c: str | Column) -> Column:
    """log(1 + x) with negatives clipped to zero."""
    return F.log1p(F.greatest(col(c), F.lit(0)).cast("double"))


def years_between(start: str | Column, end: str | Column) -> Column:
    return F.datediff(col(end), col(start)) / DAYS_PER_YEAR


def month_index(month: str | Column) -> Column:
    """A yyyymm number as a running month number, so that calendar steps are plain sums."""
    m = col(month)
    return F.floor(m / 100) * 12 + m % 100 - 1


def month_from_index(index: str | Column) -> Column:
    i = col(index)
    return (F.floor(i / 12) * 100 + i % 12 + 1).cast("int")


def shift_month(month: str | Column, by: int) -> Column:
    """Calendar step on a yyyymm number: one month before 200201 is 200112."""
    return month_from_index(month_index(month) + by)


def yyyymm(d: str | Column) -> Column:
    return F.year(col(d)) * 100 + F.month(col(d))


def right_closed_band(c: str | Column, edges: list, labels: list) -> Column:
    """Bin with bins open on the left and closed on the right; null outside them."""
    c = col(c)
    out = None
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        inside = c > low if high is None else (c > low) & (c <= high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def money(c: str | Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(col(c).cast("double"), 0))


def percent(c: str | Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", col(c).cast("double") * 100)


def signed(c: str | Column, digits: int) -> Column:
    return F.format_string(f"%+.{digits}f", col(c).cast("double"))
