"""Column functions. Every division is guarded: ANSI mode raises on zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def third_friday(c: Column | str) -> Column:
    """The third Friday of the month of a date."""
    first = F.trunc(as_col(c), "MM")
    return F.date_add(F.next_day(F.date_sub(first, 1), "FRI"), 14)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(as_col(later), as_col(earlier))


def annualize(pct: Column | str, days: Column | str) -> Column:
    """pct over days, per 365 days; null on or after the last day."""
    pct, days = as_col(pct), as_col(days)
    return F.when(days > 0, F.try_divide(pct * 365, days))


def basis_points(future: Column | str, spot: Column | str) -> Column:
    return as_col(future) - as_col(spot)


def basis_pct(future: Column | str, spot: Column | str) -> Column:
    """Per cent of the spot."""
    return (F.try_divide(as_col(future), as_col(spot)) - 1) * 100


def ratio_or_null(n: Column | str, d: Column | str, valid: Column | None = None) -> Column:
    """n / d where the condition holds (default: d > 0), else null."""
    n, d = as_col(n), as_col(d)
    return F.when(d > 0 if valid is None else valid, F.try_divide(n, d))


def clip(c: Column | str, low: Column | float, high: Column | float) -> Column:
    """Null stays null."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def null_safe_sum(*cols: Column | str) -> Column:
    """A sum in which null counts as 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(as_col(c), F.lit(0)) for c in cols))


def any_date_on_or_after(cols: list[Column | str], day: Column | str) -> Column:
    """Whether any of the dates is known and not before the day; never null."""
    day = F.to_date(F.lit(day)) if isinstance(day, str) else day
    return reduce(lambda a, b: a | b, (F.coalesce(as_col(c) >= day, F.lit(False)) for c in cols))


def available_on(*dates: Column | str) -> Column:
    """The day from which all of the dates have passed; null ones are left out."""
    return F.greatest(*map(as_col, dates))


def quarter_end(year: Column, quarter: Column) -> Column:
    return F.last_day(F.make_date(year, quarter * 3, F.lit(1)))


def quarter_label(c: Column | str) -> Column:
    """2024q1"""
    c = as_col(c)
    return F.format_string("%dq%d", F.year(c), F.quarter(c))


def code_prefix(c: Column | str, mark: str = ".") -> Column:
    return F.split_part(as_col(c), F.lit(mark), F.lit(1))


def code_suffix(c: Column | str, mark: str = ".") -> Column:
    return F.split_part(as_col(c), F.lit(mark), F.lit(2))


def contract_product(c: Column | str) -> Column:
    """The letters of a contract such as AB2610; null if it has another form."""
    return F.nullif(F.regexp_extract(as_col(c), r"^([A-Za-z]+)\d{4}$", 1), F.lit(""))


def contract_month(c: Column | str) -> Column:
    """The first day of the delivery month of such a contract; null if it has another form or no such month."""
    digits = F.regexp_extract(as_col(c), r"^[A-Za-z]+(\d{2}(?:0[1-9]|1[0-2]))$", 1)
    return F.when(digits != "", F.to_date(F.concat(F.lit("20"), digits, F.lit("01")), "yyyyMMdd"))


def debt_ratio(liability: Column | str, assets: Column | str) -> Column:
    return F.try_divide(as_col(liability), as_col(assets))


def roe(profit: Column | str, equity: Column | str) -> Column:
    """Profit over equity at the period's end, not annualised; null where the equity is not positive."""
    return ratio_or_null(profit, equity)


def gross_margin(revenue: Column | str, cost: Column | str) -> Column:
    """Null where the cost is unknown."""
    return F.try_divide(as_col(revenue) - as_col(cost), as_col(revenue))


def ex_price(previous: Column | str, cash_per_share: Column | str, added_per_10: Column | str) -> Column:
    """Theoretical price after a cash dividend and added shares."""
    cash, added = (F.coalesce(as_col(c), F.lit(0)) for c in (cash_per_share, added_per_10))
    return F.try_divide(as_col(previous) - cash, 1 + added / 10)


def exact_sum(c: Column | str, scale: int = 2) -> Column:
    """A sum of money as double, free of the order of addition."""
    return F.sum(as_col(c).cast(f"decimal(28,{scale})")).cast("double")
