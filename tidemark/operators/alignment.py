"""Steps of a series against the days that should explain them: matched one to one, in trading days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.intervals import calendar_of
from tidemark.operators.scan import Split
from tidemark.sources.scratch import written


def trading_index(df: DataFrame, keys: list[str], day: str, index: DataFrame) -> DataFrame:
    """(keys, i) of distinct rows: the place of the first trading day on or after `day`; rows beyond the calendar go.

    index: (day, i) of every calendar day, see calendar_index.
    """
    return df.join(index, F.col(day) == F.col("_cal_day")).select(*keys, "i").distinct()


def calendar_index(calendar: DataFrame, day: str) -> DataFrame:
    """(_cal_day, i, trading_day): every day from the first trading day to the last with the next trading day on or after it.

    Some hundreds of rows for each year of history, whatever the size of the data.
    """
    days = calendar_of(calendar, day)
    own = days.select(F.col("day").alias("_cal_day"), "i", F.col("day").alias("trading_day"))
    gaps = days.filter("next_day > date_add(day, 1)").select(F.explode(F.sequence(F.date_add("day", 1), F.date_sub("next_day", 1))).alias("_cal_day"), (F.col("i") + 1).alias("i"), F.col("next_day").alias("trading_day"))
    return own.unionByName(gaps)


def _nearest(rows: DataFrame, others: DataFrame, keys: list[str], out: str, before_first: bool, split: Split) -> DataFrame:
    """rows (keys, i) with out: the place of the nearest of others; of two as near, the earlier one (or the later one)."""
    known = others.select(*keys, F.col("i").alias("_i"), (-F.col("i")).alias("_back"), F.col("i").alias("_low"), F.col("i").alias("_high"))
    found = asof_join(rows, known, keys, "i", "_i", ["_low"], split=split).withColumn("_neg", -F.col("i"))
    found = asof_join(found, known, keys, "_neg", "_back", ["_high"], split=split)
    down, up = F.col("i") - F.col("_low"), F.col("_high") - F.col("i")
    lower = F.col("_high").isNull() | (down < up) | ((down == up) & F.lit(before_first))
    return found.withColumn(out, F.when(F.col("_low").isNotNull() & lower, F.col("_low")).otherwise(F.col("_high"))).drop("_neg", "_low", "_high")


def align_steps(steps: DataFrame, announced: DataFrame, keys: list[str], step_day: str, announced_day: str, index: DataFrame, tolerance: int = 1, window: int = 20, split: Split = None) -> DataFrame:
    """(keys, step_day, announced_day, lag, state): every step and every announcement, each once.

    A step and an announcement belong together if each is the other's nearest, at most `window` trading days away: of two
    as near, a step takes the announcement before it and an announcement the step after it. lag counts trading days from
    the announcement, which on a day without trading counts as of the next trading day, to the step: 'matched' from 0 to
    `tolerance`, 'early' below, 'late' above. Steps left over are 'unexplained', announcements left over 'unanswered'.
    Several of one key on one trading day count once. Null keys and days match nothing and are left out.
    """
    usable = lambda df, day: df.filter(F.col(day).isNotNull() & F.forall(F.array(*(F.col(k).isNotNull() for k in keys)), lambda x: x))
    # both are read several times below
    s = written(trading_index(usable(steps, step_day), keys, step_day, index), "steps")
    a = written(trading_index(usable(announced, announced_day), keys, announced_day, index), "announced")
    s_near = _nearest(s, a, keys, "_a", True, split).select(*keys, F.col("i").alias("_s"), "_a")
    a_near = _nearest(a, s, keys, "_s", False, split).select(*keys, F.col("i").alias("_a"), "_s")
    near = F.abs(F.col("_s") - F.col("_a")) <= window
    pairs = written(s_near.filter(near).join(a_near.filter(near), [*keys, "_s", "_a"]), "pairs")
    lone_s = s.select(*keys, F.col("i").alias("_s")).join(pairs, [*keys, "_s"], "left_anti")
    lone_a = a.select(*keys, F.col("i").alias("_a")).join(pairs, [*keys, "_a"], "left_anti")
    rows = pairs.unionByName(lone_s, allowMissingColumns=True).unionByName(lone_a, allowMissingColumns=True)
    lag = F.col("_s") - F.col("_a")
    state = F.when(lag.between(0, tolerance), "matched").when(lag < 0, "early").when(lag > tolerance, "late").when(F.col("_s").isNotNull(), "unexplained").otherwise("unanswered")
    days = index.filter("_cal_day = trading_day").select("i", "trading_day")
    rows = rows.withColumns({"lag": lag.cast("int"), "state": state})
    for place, out in (("_s", "step_day"), ("_a", "announced_day")):
        rows = rows.join(days.select(F.col("i").alias(place), F.col("trading_day").alias(out)), place, "left")
    return rows.select(*keys, "step_day", "announced_day", "lag", "state")
