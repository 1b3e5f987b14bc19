"""Fiscal periods: cumulative and single-quarter values, trailing twelve months, year over year.

Prior periods come from equi-joins on (keys, year, quarter), not from lag: a quarter may be missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio_or_null


def ytd(df: DataFrame, keys: list[str], year: str, quarter: str, value: str, out: str) -> DataFrame:
    """Running sum within a fiscal year."""
    order = Window.partitionBy(*keys, year).orderBy(quarter).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(order))


def ytd_to_quarter(df: DataFrame, keys: list[str], year: str, quarter: str, value: str, out: str) -> DataFrame:
    """The quarter's own value of a cumulative one; null after a missing quarter, the value itself in the first."""
    order = Window.partitionBy(*keys, year).orderBy(quarter)
    before = F.when(F.lag(quarter).over(order) == F.col(quarter) - 1, F.lag(value).over(order))
    return df.withColumn(out, F.when(F.col(quarter) == 1, F.col(value)).otherwise(F.col(value) - before))


def prior(df: DataFrame, keys: list[str], year: str, quarter: str, values: list[str], years: int, suffix: str, annual: bool = False) -> DataFrame:
    """values of so many years before, as rows of df to join to: of the same quarter, or of the whole year."""
    rows = df.filter(F.col(quarter) == 4) if annual else df
    kept = [*keys, year] if annual else [*keys, year, quarter]
    return rows.select(*((F.col(k) + years).alias(k) if k == year else F.col(k) for k in kept), *(F.col(v).alias(v + suffix) for v in values))


def against_prior(df: DataFrame, keys: list[str], year: str, quarter: str, trailing: dict[str, str], growth: dict[str, str], available: str | None = None) -> DataFrame:
    """df with trailing values and growth, each an out and its cumulative column; prior periods are joined once for all.

    Trailing: value + last annual - last year's value; the annual value itself in the fourth quarter; null if a part is
    missing. Growth: over the same period of the year before; null without it or where it is not positive. With
    `available`, out + '_available' is the day from which all that an out is made of was known.
    """
    values = list(dict.fromkeys([*trailing.values(), *growth.values(), *([available] if available else [])]))
    rows = df.join(prior(df, keys, year, quarter, values, 1, "_before"), [*keys, year, quarter], "left")
    if trailing:
        rows = rows.join(prior(df, keys, year, quarter, values, 1, "_annual", annual=True), [*keys, year], "left")
    annual, found = F.col(quarter) == 4, {}
    for out, c in trailing.items():
        found[out] = F.when(annual, F.col(c)).otherwise(F.col(c) + F.col(f"{c}_annual") - F.col(f"{c}_before"))
        if available:
            parts = F.when(annual, F.col(available)).otherwise(F.greatest(available, f"{available}_annual", f"{available}_before"))
            found[f"{out}_available"] = F.when(found[out].isNotNull(), parts)
    for out, c in growth.items():
        found[out] = ratio_or_null(F.col(c), F.col(f"{c}_before")) - 1
        if available:
            found[f"{out}_available"] = F.when(found[out].isNotNull(), F.greatest(available, f"{available}_before"))
    return rows.select(*df.columns, *(x.alias(n) for n, x in found.items()))


def ttm(df: DataFrame, keys: list[str], year: str, quarter: str, cum: str, available: str | None = None, out: str = "ttm") -> DataFrame:
    """The trailing value of one column, see against_prior."""
    return against_prior(df, keys, year, quarter, {out: cum}, {}, available)


def yoy(df: DataFrame, keys: list[str], year: str, quarter: str, cum: str, available: str | None = None, out: str = "yoy") -> DataFrame:
    """The growth of one column, see against_prior."""
    return against_prior(df, keys, year, quarter, {}, {out: cum}, available)
