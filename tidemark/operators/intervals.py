"""Validity intervals [start, end), null end open: made from events, flags and samples, and joined to days."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.interval_sets import dyadic_join
from tidemark.operators.scan import MEASURED, Split, beside, crowds, running


def events_to_intervals(df: DataFrame, keys: list[str], start: str, ties: list[str], end: str = "end_exclusive", split: Split = None) -> DataFrame:
    """Each event holds until the next of its key; the last stays open. split: see scan."""
    return beside(df, keys, [start, *ties], {end: F.col(start)}, ahead=True, split=split)


def calendar_of(df: DataFrame, day: str) -> DataFrame:
    """(day, i, next_day): the distinct days with their places. One row a day of history."""
    order = Window.orderBy("day")
    days = df.select(F.col(day).alias("day")).filter(F.col(day).isNotNull()).distinct()
    return days.withColumn("i", F.row_number().over(order)).withColumn("next_day", F.lead("day").over(order))


def flags_to_runs(df: DataFrame, keys: list[str], day: str, flag: Column, calendar: DataFrame) -> DataFrame:
    """(keys, start_day, last_day, end_exclusive, n_days, is_open): runs of flagged days that follow each other in the calendar.

    The end is the calendar day after the last one, null (open) where the calendar ends. Days that are not in the
    calendar count for nothing; repeated days count once.
    """
    days = df.filter(flag).select(*keys, F.col(day).alias("day")).distinct()
    placed = days.join(calendar, "day")
    island = F.col("i") - F.row_number().over(Window.partitionBy(*keys).orderBy("i"))
    runs = placed.withColumn("island", island).groupBy(*keys, "island").agg(F.min("day").alias("start_day"), F.max("day").alias("last_day"), F.max(F.struct("i", "next_day"))["next_day"].alias("end_exclusive"), F.count("*").alias("n_days"))
    return runs.drop("island").withColumn("is_open", F.col("end_exclusive").isNull())


def fold_runs(df: DataFrame, keys: list[str], order: list[str], value: str, split: Split = None) -> DataFrame:
    """(keys, value, effective_from, last_observed, effective_to_exclusive, n): runs of equal consecutive values.

    order[0] is the time; the rest break ties. A run ends where the next begins. split: see scan.
    """
    split = crowds(df, keys, order[0], split)
    before = beside(df, keys, order, {"_before": F.col(value)}, split=split, first="_first")
    marked = before.withColumn("_new", (F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).cast("long")).drop("_before", "_first")
    runs = running(marked, keys, order, F.col("_new"), "_run", "sum", split)
    runs = runs.groupBy(*keys, "_run").agg(F.first(value).alias(value), F.min(order[0]).alias("effective_from"), F.max(order[0]).alias("last_observed"), F.count("*").alias("n"))
    return beside(runs, keys, ["effective_from", "_run"], {"effective_to_exclusive": F.col("effective_from")}, ahead=True, split=split).drop("_run")


def in_interval(df: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """df joined to the intervals of the same keys that hold `at`: an equi-join with a residual range.

    Intervals of a key may overlap. The work is rows times intervals of a key; where they do not overlap, in_state has no
    such product.
    """
    on = [df[k] == intervals[k] for k in by] + [df[at] >= intervals[start], intervals[end].isNull() | (df[at] < intervals[end])]
    joined = df.join(intervals, on, how)
    for k in by:
        joined = joined.drop(intervals[k])
    return joined


def in_state(df: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, values: list[str], split: Split = MEASURED) -> DataFrame:
    """df with `values` of the interval that holds `at`, for intervals of a key that do not overlap; rows in none go.

    An as-of join on the starts and a check of the ends: linear in both sides. split: see asof_join. Empty intervals hold
    nothing.
    """
    open_ = intervals.filter(F.col(end).isNull() | (F.col(start) < F.col(end)))
    known = open_.select(*by, F.col(start).alias("_start"), F.col(end).alias("_end"), *(F.col(v).alias(f"_{v}_value") for v in values))
    found = asof_join(df, known, by, at, "_start", ["_start", "_end", *(f"_{v}_value" for v in values)], split=split)
    held = F.col("_start").isNotNull() & (F.col("_end").isNull() | (F.col(at) < F.col("_end")))
    return found.filter(held).select(*df.columns, *(F.col(f"_{v}_value").alias(v) for v in values))


def cap_open_ends(intervals: DataFrame, caps: DataFrame, by: list[str], end: str, cap: str) -> DataFrame:
    """Open intervals ended at their key's cap, such as the day of delisting; keys without a cap stay open.

    An open end says that no later change is known, not that the state still holds: a delisted security has one too.
    """
    return intervals.join(caps.select(*by, F.col(cap).alias("_cap")), by, "left").withColumn(end, F.coalesce(end, "_cap")).drop("_cap")


#: Ranges of one list; pairs of one slice of a day with one list, and of one partition; about.
LIST, PAIRS = 256, 1 << 23


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width_days: int, keep: list[str] | None = None) -> DataFrame:
    """points joined to the ranges [start, end) that hold their day, without another key; a null start or end is open.

    Ranges of up to 4 * width_days are listed by the days they hold, in lists of about LIST; a point meets the lists of its
    day by an equi-join, and every pair it makes is a result. Points of a day are slices, and partitions follow the number of
    pairs, so neither a slice with a list nor a task has many more than PAIRS. A list is gone through once for each point in
    turn, and what one point makes is handed on before the next: the points are the outer loop of the join, as Spark keeps
    all rows of one row of that side. Rows that follow each other repeat a list that fits into a compressor's window, so the
    pairs take a fraction of their bytes when written. Choose the width near the usual length of a range; longer and open
    ones go by the nodes of a tree instead (see interval_sets.dyadic_join). keep: the columns of ranges that are wanted, all
    if None.
    """
    kept = ranges.columns if keep is None else keep
    length = F.datediff(end, start)
    short = length.isNotNull() & (length <= 4 * width_days)
    cut = ranges.filter(short & (length > 0)).select(F.struct(*kept).alias("_range"), F.explode(F.sequence(F.col(start), F.date_sub(end, 1))).alias("_day"))
    parts = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    asked = points.filter(F.col(at).isNotNull()).groupBy(F.col(at).cast("date").alias("_day")).agg(F.count("*").alias("_n"))
    # one row for each day of the calendar
    days = asked.join(cut.groupBy("_day").agg(F.count("*").alias("_m")), "_day")
    pairs = days.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0
    days = F.broadcast(days.select("_day", parts("_n", PAIRS // LIST).alias("_slices"), parts("_m", LIST).alias("_lists")))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lists = cut.join(days, "_day").groupBy("_day", dealt("_range", "_lists").alias("_list"), "_slices").agg(F.collect_list("_range").alias("_ranges"))
    # a single column is an array of its values, which is gone through faster than structs
    one = len(kept) == 1
    held = F.transform("_ranges", lambda r: r[kept[0]]) if one else F.col("_ranges")
    lists = lists.select("_day", "_list", held.alias("_ranges"), each("_slices").alias("_slice"))
    sliced = points.select(F.struct(*points.columns).alias("_point"), F.col(at).cast("date").alias("_day")).join(days, "_day")
    sliced = sliced.select("_day", "_point", dealt("_point", "_slices").alias("_slice"), each("_lists").alias("_list"))
    # a number of partitions of our own is not coalesced by bytes, of which pairs to be made have none yet
    by = ["_day", "_slice", "_list"]
    sliced, lists = (side.repartition(max(1, math.ceil(pairs / PAIRS)), *by) for side in (sliced, lists))
    met = sliced.hint("merge").join(lists, by).select("_point", F.explode("_ranges").alias("_range"))
    found = [F.col("_range").alias(kept[0])] if one else [F.col("_range")[c].alias(c) for c in kept]
    near = met.select(*(F.col("_point")[c].alias(c) for c in points.columns), *found)
    long_ = ranges.filter(~short)
    if long_.isEmpty():
        return near
    far = dyadic_join(points, long_, at, start, end)
    return near.union(far if keep is None else far.select(*points.columns, *kept))


def check_overlap(df: DataFrame, keys: list[str], start: str, end: str, ties: list[str], split: Split = None) -> DataFrame:
    """Intervals that reach beyond the start of the next of their key, or do not end after they start. split: see scan."""
    rows = beside(df, keys, [start, *ties], {"_next": F.col(start)}, ahead=True, split=split)
    reaches = F.col("_next").isNotNull() & (F.col(end).isNull() | (F.col("_next") < F.col(end)))
    return rows.filter(reaches | (F.col(end) <= F.col(start))).drop("_next")
