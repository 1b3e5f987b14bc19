"""Row filters: what was known when, horizons, exclusions, and views without columns that look ahead."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def periodic_first(df: DataFrame, report_type: str, first: int, source: str, periodic: str) -> DataFrame:
    """First disclosures from periodic reports."""
    return df.filter((F.col(report_type) == first) & (F.col(source) == periodic))


def exclude(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose value is not among these; rows without a value stay."""
    return df.filter(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def within_horizon(df: DataFrame, day: str, asof: Column, days: int) -> DataFrame:
    """From asof up to so many days after it."""
    return df.filter(F.col(day).between(asof, F.date_add(asof, days)))


def known_by(df: DataFrame, available: str | Column, cutoff: Column | str) -> DataFrame:
    """Rows available on or before the cutoff; rows of unknown availability are not known."""
    cutoff = F.to_date(F.lit(cutoff)) if isinstance(cutoff, str) else cutoff
    return df.filter((F.col(available) if isinstance(available, str) else available) <= cutoff)


#: Columns of each kind of table that tell what came after the row: no view as of a day may hold them.
LOOKS_AHEAD = {
    "suspensions": ("resume_date", "last_suspended_date", "suspended_trading_days", "still_suspended_at_data_end"),
    "st_daily_intervals": ("last_st_date", "st_end_date_exclusive", "st_trading_days"),
    "industry_intervals": ("last_observed", "effective_to_exclusive"),
    "status_intervals": ("end_date_exclusive",),
    "listing": ("latest_listing_status", "is_delisted", "delist_date"),
    "dividends": ("status", "cash_total_10k_cny", "share_base_10k_shares"),
}


#: Columns of each kind of table that a stage of its own makes known, by the date of that stage.
STAGES = {
    "dividends": {
        "shareholder_pub_date": (),
        "implementation_pub_date": ("record_date", "ex_date", "pay_date", "cash_per_10", "cash_per_share", "bonus_per_10", "transfer_per_10", "added_per_10"),
    },
}


def pit_view(df: DataFrame, kind: str, available: str | Column, cutoff: Column | str) -> DataFrame:
    """The rows known by a day, without the columns that look ahead of it.

    A column that a later stage makes known is null until the date of that stage, and so is the date itself.
    """
    day = F.to_date(F.lit(cutoff)) if isinstance(cutoff, str) else cutoff
    rows = known_by(df, available, day).drop(*LOOKS_AHEAD[kind])
    for date, columns in STAGES.get(kind, {}).items():
        if date in rows.columns:
            come = F.col(date) <= day
            rows = rows.withColumns({c: F.when(come, F.col(c)) for c in (*columns, date) if c in rows.columns})
    return rows
