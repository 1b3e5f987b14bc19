"""Chains of versions: what each key's record was said to be, and between which times each version was the known one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import in_state
from tidemark.operators.scan import MEASURED, Split, beside, crowds, running


def revision_chain(df: DataFrame, keys: list[str], known: str, ties: list[str], values: list[str], deleted: Column | None = None, split: Split = None) -> DataFrame:
    """(keys, ties, values, version, known_from, known_to, is_first, is_last): the versions of each key, from 1.

    A version is known from its own time until the next; known_to of the last is null. Rows that repeat count once; of
    several at one time the last by `ties` is the version. A row that says what the one before it said is no version.
    deleted: rows that end the chain until a later one takes it up again; they are no versions themselves. Rows
    without a known time are left out; null keys are a key. split: see scan.
    """
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    rows = df.filter(F.col(known).isNotNull()).select(*keys, F.col(known).alias("_known"), F.struct(*ties).alias("_ties"), F.struct(*values).alias("_values"), gone.alias("_gone"))
    rows = rows.groupBy(*keys, "_known").agg(F.max(F.struct("_ties", "_gone", "_values")).alias("_row")).select(*keys, "_known", "_row.*")
    split = crowds(rows, keys, "_known", split)
    rows = beside(rows, keys, ["_known"], {"_said": F.struct("_values", "_gone")}, split=split)
    rows = rows.filter(~F.struct("_values", "_gone").eqNullSafe(F.col("_said"))).drop("_said")
    rows = beside(rows, keys, ["_known"], {"_next": F.col("_known")}, ahead=True, split=split)
    rows = running(rows, keys, ["_known"], F.when(F.col("_gone"), 0).otherwise(1).cast("long"), "version", "sum", split).filter(~F.col("_gone"))
    rows = beside(rows, keys, ["_known"], {"_later": F.col("version")}, ahead=True, split=split)
    last = F.col("_later").isNull().alias("is_last")
    return rows.select(*keys, "_ties.*", *(F.col("_values")[v].alias(v) for v in values if v not in ties), "version", F.col("_known").alias("known_from"), F.col("_next").alias("known_to"), (F.col("version") == 1).alias("is_first"), last)


def as_of(chain: DataFrame, time: Column) -> DataFrame:
    """The versions known at one time, one a key at most."""
    return chain.filter((F.col("known_from") <= time) & (F.col("known_to").isNull() | (F.col("known_to") > time)))


def known_at(df: DataFrame, chain: DataFrame, by: list[str], at: str, values: list[str], split: Split = MEASURED) -> DataFrame:
    """df with `values` of the version of its key that was known at each row's own time; rows without one go."""
    return in_state(df, chain, by, at, "known_from", "known_to", values, split)
