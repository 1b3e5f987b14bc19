"""Combining sources: only where complete, by precedence, and as shares of a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.panel import top_n_by
from tidemark.operators.scan import Split, running


def aggregate(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*(c.alias(name) for name, c in measures.items()))


def combine_members(df: DataFrame, key: list[str], member: str, members: list, measures: dict[str, Column], require_all: bool = True) -> DataFrame:
    """Measures summed over the members of each key, in total and as <measure>_<member>; one aggregation, no join.

    require_all: only keys that have every member. measures: name -> value of a row.
    """
    rows = df.filter(F.col(member).isin(members))
    columns = [F.count_distinct(member).alias("_n")]
    for name, value in measures.items():
        columns.append(F.sum(value).alias(name))
        columns += [F.sum(F.when(F.col(member) == m, value)).alias(f"{name}_{m}") for m in members]
    rows = rows.groupBy(*key).agg(*columns)
    return (rows.filter(F.col("_n") == len(members)) if require_all else rows).drop("_n")


def completeness(df: DataFrame, dim: DataFrame, group: str, key: list[str], member: str, valid_from: str | None = None, valid_to: str | None = None, split: Split = None) -> DataFrame:
    """(group, key, n, n_expected, complete): members seen against members that the dimension expects.

    With valid_from, a member is expected from that day on (key[0] is the day), with valid_to until the day before that.
    A member without a valid_from is expected at no time; of one that has several spans, those must not overlap. Expected
    members of a day are a running sum of starts less ends, so days are not joined to members: linear in both.
    """
    seen = df.groupBy(group, *key).agg(F.count_distinct(member).alias("n"))
    if valid_from is None:
        expected = dim.groupBy(group).agg(F.count_distinct(member).alias("n_expected"))
        rows = seen.join(expected, group)
    else:
        spans = dim.select(group, member, F.col(valid_from).alias("_from"), (F.col(valid_to) if valid_to else F.lit(None).cast("date")).alias("_to")).filter("_from is not null and (_to is null or _from < _to)").distinct()
        edges = spans.select(group, F.explode(F.array(F.struct(F.col("_from").alias("_day"), F.lit(1).alias("_d")), F.struct(F.col("_to").alias("_day"), F.lit(-1).alias("_d")))).alias("_e"))
        edges = edges.select(group, "_e.*").filter("_day is not null").groupBy(group, "_day").agg(F.sum("_d").alias("_d"))
        # a day's edges come before the rows seen on it
        marks = edges.select(group, "_day", F.lit(0).alias("_tag"), "_d")
        days = seen.select(group, F.col(key[0]).cast("date").alias("_day"), F.lit(1).alias("_tag"), F.struct(*key, "n").alias("_seen"))
        both = running(days.unionByName(marks, allowMissingColumns=True), [group], ["_day", "_tag"], F.coalesce("_d", F.lit(0)), "n_expected", "sum", split)
        rows = both.filter("_tag = 1 and n_expected > 0").select(group, "_seen.*", "n_expected")
    return rows.withColumn("complete", (F.col("n") == F.col("n_expected")).cast("int"))


def complete_only(rows: DataFrame) -> DataFrame:
    """The rows of completeness() in which every expected member is there; rows of unknown completeness go."""
    return rows.filter("complete = 1")


def coverage(part: DataFrame, whole: DataFrame, key: list[str], measure: str) -> DataFrame:
    """(key, part, whole, coverage) for every key of the whole; null without a whole."""
    joined = whole.select(*key, F.col(measure).alias("whole")).join(part.select(*key, F.col(measure).alias("part")), key, "left")
    return joined.withColumn("coverage", F.try_divide("part", "whole"))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_precedence(primary: DataFrame, secondary: DataFrame, keys: list[str], ties: list[Column]) -> DataFrame:
    """Both sources, one row a key; where they overlap the primary's."""
    both = primary.withColumn("_source", F.lit(0)).unionByName(secondary.withColumn("_source", F.lit(1)))
    return top_n_by(both, keys, [F.col("_source"), *ties]).drop("_source")
