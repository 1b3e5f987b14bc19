"""Panels: first and top rows of a group, ranks, differences, change points, period ends, winsorizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import Split, beside


def top_n_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark drops the rest before the exchange. `order` ends with what breaks ties."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def first_disclosure(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each period."""
    return top_n_by(df, keys, [F.col(c).asc_nulls_last() for c in order])


def flag_top(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """1 on the first row of each group, 0 on the others."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1).cast("int"))


def rank_within(df: DataFrame, keys: list[str], order: list[Column], out: str, method: str = "row_number") -> DataFrame:
    function = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[method]
    return df.withColumn(out, function().over(Window.partitionBy(*keys).orderBy(*order)))


def diff_prev(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, split: Split = None) -> DataFrame:
    """Change against the previous record, however long ago. split: see scan."""
    return beside(df, keys, order, {"_before": F.col(value)}, split=split).withColumn(out, F.col(value) - F.col("_before")).drop("_before")


def change_points(df: DataFrame, keys: list[str], order: list[str], value: str, split: Split = None) -> DataFrame:
    """Rows whose value differs from the previous record's; the first of each key is one. split: see scan."""
    rows = beside(df, keys, order, {"_before": F.col(value)}, split=split, first="_first")
    return rows.filter(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_first")


def period_end_sample(df: DataFrame, keys: list[str], day: str, period: str, data_end: Column | None, ties: list[Column]) -> DataFrame:
    """The last row of each key and period ('week', 'month', 'quarter', 'year') up to the end of the data."""
    rows = df if data_end is None else df.filter(F.col(day) <= data_end)
    rows = rows.withColumn("period", F.date_trunc(period, F.col(day)).cast("date"))
    return top_n_by(rows, [*keys, "period"], [F.col(day).desc(), *ties])


#: Accuracy of the first pass over a group's values; the second pass looks at 4 in ACCURACY of them on either side of a rank.
ACCURACY = 10_000


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, q0, q1, ...): the exact percentiles of each group, interpolated between neighbours; nulls do not count.

    Two passes, so that no task holds a group: approximate percentiles, whose error is bounded, enclose each rank; then
    only values between the bounds are counted and put in order, a share of 8 / ACCURACY of a group for each percentile.
    What is below or above them is one row each, with the value next to the bound.
    """
    slack = 4 / ACCURACY
    around = [min(1.0, max(0.0, s + d)) for s in shares for d in (-slack, slack)]
    rows = df.filter(F.col(value).isNotNull()).select(*(F.struct(F.col(k).alias("k")).alias(k) for k in keys), F.col(value).cast("double").alias("_v"))
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", around, ACCURACY).alias("_cuts"))
    spots = F.array(*(F.struct(F.lit(k).alias("_k"), F.lit(s).alias("_share"), F.col("_cuts")[2 * k].alias("_low"), F.col("_cuts")[2 * k + 1].alias("_high")) for k, s in enumerate(shares)))
    rows = rows.join(bounds, keys).select(*keys, "_n", "_v", F.explode(spots).alias("_s")).select(*keys, "_n", "_v", "_s.*")
    side = F.when(F.col("_v") < F.col("_low"), -1).when(F.col("_v") > F.col("_high"), 1).otherwise(0)
    place = [*keys, "_k", "_share", "_n", side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_at")]
    counted = rows.groupBy(*place).agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    order = Window.partitionBy(*keys, "_k").orderBy("_side", "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = counted.withColumn("_upto", F.sum("_c").over(order)).withColumn("_v", F.when(F.col("_side") < 0, F.col("_most")).otherwise(F.col("_least")))
    spot = F.col("_share") * (F.col("_n") - 1)
    holds = lambda rank: F.min(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col("_v")))
    found = counted.groupBy(*keys, "_k").agg(holds(F.floor(spot)).alias("_a"), holds(F.ceil(spot)).alias("_b"), F.first(spot - F.floor(spot)).alias("_part"))
    q = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")
    found = found.groupBy(*keys).agg(*(F.max(F.when(F.col("_k") == k, q)).alias(f"q{k}") for k in range(len(shares))))
    return found.select(*(F.col(k)["k"].alias(k) for k in keys), *(f"q{k}" for k in range(len(shares))))


def winsorize(df: DataFrame, keys: list[str], value: str, share: float, out: str) -> DataFrame:
    """value clipped to the exact percentiles share and 1 - share of its group; a null key is a group too."""
    bounds = exact_percentiles(df, keys, value, [share, 1 - share]).select(*(F.col(k).alias(f"_{k}_b") for k in keys), "q0", "q1")
    clipped = F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.col("q0")), F.col("q1")))
    joined = df.join(bounds, [F.col(k).eqNullSafe(F.col(f"_{k}_b")) for k in keys], "left")
    return joined.withColumn(out, clipped).drop("q0", "q1", *(f"_{k}_b" for k in keys))
