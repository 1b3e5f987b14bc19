"""Data quality: schemas, profiles, duplicates, reconciliation, identities, date orders, confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_schema(df: DataFrame, expected: T.StructType) -> list[str]:
    """Differences in names and types; empty if there are none."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in expected}
    found = [f"missing {n}" for n in want if n not in have] + [f"unexpected {n}" for n in have if n not in want]
    return found + [f"{n}: {have[n].simpleString()} for {t.simpleString()}" for n, t in want.items() if n in have and have[n] != t]


def schema_profile(df: DataFrame, expected: T.StructType) -> DataFrame:
    """(column_name, state, n_rows, n_null): every column that is there or expected, with the rows that bear it out.

    state: 'ok', 'missing', 'unexpected', or the type found 'for' the expected one; n_null of a missing column is null. One
    scan for all columns, of which only null counts leave a task.
    """
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in expected}
    state = {n: "missing" if n not in have else "unexpected" if n not in want else "ok" if have[n] == want[n] else f"{have[n].simpleString()} for {want[n].simpleString()}" for n in [*want, *(n for n in have if n not in want)]}
    column = lambda n: F.col("`" + n.replace("`", "``") + "`")
    counts = [F.count_if(column(n).isNull()).alias(f"c{k}") if n in have else F.lit(None).cast("long").alias(f"c{k}") for k, n in enumerate(state)]
    one = df.agg(F.count("*").alias("n_rows"), *(F.max(c).alias(f"c{k}") if n not in have else c for k, (n, c) in enumerate(zip(state, counts, strict=True))))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.lit(s).alias("state"), F.col(f"c{k}").alias("n_null")) for k, (n, s) in enumerate(state.items()))))
    return one.select("n_rows", rows.alias("r")).select("r.column_name", "r.state", "n_rows", "r.n_null")


def profile(df: DataFrame, dates: list[str], key: str, cutoff: str) -> DataFrame:
    """(column_name, min_day, max_day, missing, through_cutoff, distinct_keys, n_rows): one scan for all date columns."""
    day = F.to_date(F.lit(cutoff))
    parts = [F.count_distinct(key).alias("keys"), F.count("*").alias("n")]
    for c in dates:
        parts += [F.min(c).cast("date").alias(f"{c}_min"), F.max(c).cast("date").alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_missing"), F.count_if(F.col(c).cast("date") <= day).alias(f"{c}_through")]
    one = df.agg(*parts)
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_min").alias("min_day"), F.col(f"{c}_max").alias("max_day"), F.col(f"{c}_missing").alias("missing"), F.col(f"{c}_through").alias("through_cutoff")) for c in dates)))
    return one.select(rows.alias("r"), F.col("keys").alias("distinct_keys"), F.col("n").alias("n_rows")).select("r.*", "distinct_keys", "n_rows")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, state): 'equal', 'different', 'only_a' or 'only_b' for every key of either side; nulls equal nulls."""
    left = a.select(*keys, F.struct(*values).alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(*keys, F.struct(*values).alias("_b"), F.lit(True).alias("_in_b"))
    state = F.when(F.col("_in_b").isNull(), "only_a").when(F.col("_in_a").isNull(), "only_b").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("different")
    return left.join(right, keys, "full_outer").select(*keys, state.alias("state"))


def agreement(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(a).eqNullSafe(F.col(b))).alias("n_equal"))


def confusion(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, recall, precision of predicted keys against true ones."""
    t, p = truth.select(*keys).distinct().withColumn("_t", F.lit(True)), pred.select(*keys).distinct().withColumn("_p", F.lit(True))
    hit, both = F.coalesce("_t", F.lit(False)), F.coalesce("_p", F.lit(False))
    one = t.join(p, keys, "full_outer").agg(F.count_if(hit & both).alias("tp"), F.count_if(~hit & both).alias("fp"), F.count_if(hit & ~both).alias("fn"))
    return one.withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp")))


def check_identity(df: DataFrame, a: Column, b: Column, eps: float) -> DataFrame:
    """One row: rows compared and rows that differ by more than eps; rows with a null are not compared."""
    known = a.isNotNull() & b.isNotNull()
    return df.agg(F.count_if(known).alias("n_compared"), F.count_if(known & (F.abs(a - b) > eps)).alias("n_mismatch"))


def check_order(df: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): rows with a <= b or a null, and rows with a > b, which are set aside and not mended."""
    bad = F.coalesce(F.col(a) > F.col(b), F.lit(False))
    return df.filter(~bad), df.filter(bad)


def tolerance_match(a: DataFrame, b: DataFrame, keys: list[str], value_a: str, value_b: str, tolerance: float) -> DataFrame:
    """a joined to b with whether the values agree within the tolerance; null values do not."""
    return a.join(b, keys).withColumn("matches", F.coalesce(F.abs(F.col(value_a) - F.col(value_b)) <= tolerance, F.lit(False)))
