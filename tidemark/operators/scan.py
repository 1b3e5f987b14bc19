"""Values of earlier and later rows and running sums, where one key may hold a large share of all rows.

A window is one task for a key. Here keys are counted first, and only those with more than one in PIECES of all rows are
cut: at quantiles of their first order column, into blocks of about that many rows. Windows are then a key and a block
each. What a block starts with comes from the blocks before it: one summary row a block, combined in order - there are
PIECES blocks at most, and one more for each crowded key, of which there are fewer than PIECES - and joined to the rows
by broadcast. Where no key is crowded, the plan is the plain window's; counting the keys is one aggregation.

`split` is None, MEASURED, or the Crowds of an earlier measure of the same keys.

Rows of one key that agree in the first order column stay in one block. Null keys are a key; nulls come first in order.
There is one key at least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import forget, written

#: A key with more than one in so many rows is cut, into blocks of as many.
PIECES = 256
#: Rows of a key that no task minds.
FEW = 20_000
#: What `split` says where keys are to be counted and crowded ones cut.
MEASURED = "measured"

ALL_BEFORE = (Window.unboundedPreceding, Window.currentRow)


class Crowds:
    """The crowded keys of a frame and where they are cut: _crowd0, _crowd1, ... and _cuts, a table of fewer than PIECES rows.

    Measured once, it serves every scan over the same keys and the same kind of time: blocks follow from key and time.
    """

    def __init__(self, cuts: DataFrame, time: str):
        self.cuts, self.time = cuts, time


Split = None | str | Crowds


def crowds(df: DataFrame, keys: list[str], time: str, split: Split) -> Crowds | None:
    """What `split` comes to: None if nothing is to be cut."""
    if split is None or isinstance(split, Crowds):
        return split
    if split != MEASURED:
        raise ValueError(f"split is None or {MEASURED!r}, not {split!r}")
    named = [F.col(k).alias(f"_crowd{i}") for i, k in enumerate(keys)]
    same = [F.col(k).eqNullSafe(F.col(f"_crowd{i}")) for i, k in enumerate(keys)]
    counts = df.groupBy(*named).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(FEW, (total or 0) // PIECES)
    if (most or 0) <= limit:
        return None
    crowded = counts.filter(F.col("_n") > limit)
    rows = df.select(*keys, F.col(time).alias("_t")).join(F.broadcast(crowded.drop("_n")), same)
    cuts = rows.groupBy(*(f"_crowd{i}" for i in range(len(keys)))).agg(F.count("*").alias("_n"), F.percentile_approx("_t", [k / PIECES for k in range(1, PIECES)], 100 * PIECES).alias("_all"))
    # of the quantiles, as many as the key has pieces
    step = F.greatest(F.lit(1), F.floor(F.lit(PIECES) / F.ceil(F.col("_n") / limit))).cast("int")
    picked = F.array_distinct(F.filter("_all", lambda x, i: (i + 1) % step == 0))
    found = cuts.select(*(f"_crowd{i}" for i in range(len(keys))), picked.alias("_cuts"))
    # fewer than PIECES keys with as many cuts in all: measured once, not again with every use
    return Crowds(df.sparkSession.createDataFrame(found.collect(), found.schema), time)


class Cut:
    """Rows with their blocks: column _block, 0 for keys that are not cut.

    Where keys are cut the rows become a table, from which both the windows and the summaries of the blocks are taken.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], split: Split):
        self.keys, self.order = keys, order
        found = crowds(df, keys, order[0], split)
        self.crowded = found is not None
        if self.crowded:
            same = [F.col(k).eqNullSafe(F.col(f"_crowd{i}")) for i, k in enumerate(keys)]
            block = F.when(F.col("_cuts").isNotNull(), 1 + F.size(F.filter("_cuts", lambda c: c < F.col(order[0])))).otherwise(0)
            rows = df.join(F.broadcast(found.cuts), same, "left").withColumn("_block", block).drop("_cuts", *(f"_crowd{i}" for i in range(len(keys))))
            self.rows = written(rows, "cut")
        else:
            self.rows = df.withColumn("_block", F.lit(0))

    def window(self):
        return Window.partitionBy(*self.keys, "_block").orderBy(*(F.col(c).asc_nulls_first() for c in self.order))

    def forget(self) -> None:
        """Delete the table of rows, once nothing reads it any more."""
        if self.crowded:
            forget(self.rows)

    def with_carried(self, rows: DataFrame, summary: Column, combine, out: str) -> DataFrame:
        """rows with out: the summaries of the blocks of the key that combine, an aggregate over ordered blocks, takes."""
        if not self.crowded:
            return rows.withColumn(out, F.lit(None).cast(self.rows.select(summary.alias("x")).schema["x"].dataType))
        ends = self.rows.filter("_block > 0").groupBy(*self.keys, "_block").agg(summary.alias("_summary"))
        by = Window.partitionBy(*self.keys).orderBy("_block")
        carried = ends.select(*(F.col(k).alias(f"_{k}_c") for k in self.keys), F.col("_block").alias("_block_c"), combine(F.col("_summary"), by).alias(out))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}_c")) for c in self.keys] + [F.col("_block") == F.col("_block_c")]
        # two PIECES rows at most
        return rows.join(F.broadcast(carried), same, "left").drop("_block_c", *(f"_{k}_c" for k in self.keys))


def beside(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], ahead: bool = False, split: Split = None, first: str | None = None) -> DataFrame:
    """df with values of the row before it in its key (ahead: of the row after it), null where there is none.

    first: a column that says whether there is none.
    """
    cut = Cut(df, keys, order, split)
    packed = F.struct(*(c.alias(n) for n, c in values.items()))
    own = (F.lead if ahead else F.lag)(packed).over(cut.window())
    rows = cut.rows.withColumn("_beside", own)
    place = F.struct(*order)
    summary = F.min_by(packed, place) if ahead else F.max_by(packed, place)
    rows = cut.with_carried(rows, summary, lambda s, by: (F.lead if ahead else F.lag)(s).over(by), "_carried")
    rows = rows.withColumn("_beside", F.coalesce("_beside", "_carried")).drop("_carried", "_block")
    if first:
        rows = rows.withColumn(first, F.col("_beside").isNull())
    return rows.withColumns({n: F.col("_beside")[n] for n in values}).drop("_beside")


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, how: str, split: Split = None) -> DataFrame:
    """df with out: value up to and with each row of its key: its 'sum', its 'max' or the 'last' that is not null."""
    return running_all(Cut(df, keys, order, split), {out: (value, how)})


def running_all(cut: Cut, values: dict[str, tuple[Column, str]]) -> DataFrame:
    """The rows of cut with several running values, of {out: (value, how)}, by one sort."""
    by = cut.window().rowsBetween(*ALL_BEFORE)
    within = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    rows = cut.rows.withColumns({out: within[how](value).over(by) for out, (value, how) in values.items()})
    for out, (value, how) in values.items():
        summary = F.max_by(value, F.when(value.isNotNull(), F.struct(*cut.order))) if how == "last" else within[how](value)
        before = lambda s, w, how=how: within[how](s).over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = cut.with_carried(rows, summary, before, "_carried")
        both = {"sum": F.coalesce(F.col(out) + F.col("_carried"), out, "_carried"), "max": F.greatest(out, "_carried"), "last": F.coalesce(out, "_carried")}[how]
        rows = rows.withColumn(out, both).drop("_carried")
    return rows.drop("_block")
