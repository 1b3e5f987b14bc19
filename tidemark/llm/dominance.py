"""Dominance counting by CDQ divide and conquer: for every row, how many come no later and lie strictly higher.

Rows are first added up in cells of one slot and level, so that a slot or level that very many rows have is few cells.
Slots get dense ranks. The recursion halves a range of ranks: a cell of the right half counts the cells of the left half
that have a larger level, whatever their slots, as these are all earlier. Each level of the recursion is one exchange of
the cells by node - the bits of the rank above the level - in which both halves are merged by level and the left half is
added up from the top. The lowest level is the slot itself, in which every cell counts those above it.

A node of the upper levels holds all cells. So a node is cut by level into blocks at the quantiles of the levels: BLOCKS
for a node with all cells, half as many for each halving of its size, whether ranks or a crowded slot make it large. What
the left half has in the blocks above comes with the exchange as one carried row for each block; at most BLOCKS rows of a
node are ordered to find it. No task takes more than a few blocks, and only the number of slots, one cell count and
BLOCKS quantiles come to the driver.

Rows without slot or level are above none and get null counts; rows that repeat are rows of their own and are counted
each; rows of one slot and one level are not above each other. Totals that are not a number or reach 2^55 have no level.
No rows give no rows. Columns of the input that are not asked for are dropped.
"""

from __future__ import annotations

from math import inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import forget, written

#: Blocks of levels of a node that holds all cells.
BLOCKS = 1024
#: Slots ranked in one task: ranks within a run of so many hours, then runs after another.
RUN = 1024
#: Levels of the recursion between two written tables.
CUT = 5

HOUR = 3600


def slot_of(df: DataFrame, column: str) -> Column:
    """Hours since 1970 of a time: of one without a zone as it is written, in any session zone."""
    c = F.col(column)
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return (F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(c)).cast("long")
    return F.floor(F.unix_seconds(c) / F.lit(HOUR)).cast("long")


def level_of(total: Column) -> Column:
    """Whole units of an amount rounded to hundredths, in double arithmetic."""
    cents = F.floor(F.lit(100.0) * total + F.lit(0.5)).cast("double")
    usable = ~F.isnan(total) & (F.abs(total) < F.lit(float(1 << 55)))
    return F.when(usable, F.floor(cents / F.lit(100.0)).cast("long"))


def ranks(cells: DataFrame) -> DataFrame:
    """(slot, rank, cells): dense ranks from 0. Runs of RUN hours are ranked apart; of runs there are as many as time has."""
    slots = cells.groupBy("slot").agg(F.count("*").alias("cells")).withColumn("run", F.floor(F.col("slot") / RUN))
    runs = slots.groupBy("run").agg(F.count("*").alias("c"))
    runs = runs.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    within = F.row_number().over(Window.partitionBy("run").orderBy("slot"))
    return slots.withColumn("within", within).join(runs, "run").select("slot", (F.col("before") + F.col("within") - 1).cast("int").alias("rank"), "cells")


def with_shifts(slots: DataFrame, depth: int, total: int) -> DataFrame:
    """slots with shifts: for each level of the recursion, by how many bits blocks are merged in the node of the slot."""
    on = slots.select("slot", "rank", "cells", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    on = on.withColumn("node", F.expr("shiftright(rank, d)"))
    sizes = on.groupBy("d", "node").agg(F.sum("cells").alias("size"))
    shift = F.least(F.floor(F.log2(F.lit(float(total)) / F.col("size"))), F.lit(BLOCKS.bit_length())).cast("tinyint")
    found = on.join(sizes, ["d", "node"]).groupBy("slot", "rank").agg(F.sort_array(F.collect_list(F.struct("d", shift.alias("s")))).alias("s"))
    return found.select("slot", "rank", F.transform("s", lambda x: x["s"]).alias("shifts"))


def cells_of(rows: DataFrame) -> tuple[DataFrame, int]:
    """The table (slot, level, rank, block, shifts, n, w) of the cells of rows (slot, level, w), and the depth of the recursion."""
    first = written(rows.groupBy("slot", "level").agg(F.count("*").alias("n"), F.sum("w").alias("w")), "cells")
    slots = written(ranks(first), "slots")
    last, total = slots.agg(F.max("rank"), F.sum("cells")).first()
    depth = int(last or 0).bit_length()
    cuts = first.agg(F.percentile_approx(F.col("level").cast("double"), [k / BLOCKS for k in range(1, BLOCKS)], 20 * BLOCKS)).first()[0] or []
    splits = [-inf, *sorted(set(cuts) or {0.0}), inf]
    located = first.withColumn("height", F.col("level").cast("double"))
    located = Bucketizer(splits=splits, inputCol="height", outputCol="block").transform(located).drop("height")
    cells = located.withColumn("block", F.col("block").cast("int")).join(with_shifts(slots, depth, total or 1), "slot")
    cells = written(cells.select("slot", "level", "rank", "block", "shifts", "n", "w"), "ranked")
    forget(first, slots)
    return cells, depth


def one_level(found: DataFrame, blocks: DataFrame, d: int) -> DataFrame:
    """found with the counts of one level of the recursion added: that of nodes of 2^d ranks; 0: that of slots.

    blocks: (rank, block, shifts, n, w), the cells added up by slot and block, from which the carried rows come.
    """
    node, part = F.shiftright("rank", d), F.expr(f"shiftright(block, cast(shifts[{d}] as int))")
    left = (F.shiftright("rank", d - 1) % 2 == 0) if d else F.lit(True)
    sums = blocks.groupBy(node.alias("node"), part.alias("part")).agg(*(F.sum(F.when(left, F.col(c)).otherwise(0)).alias(c) for c in "nw"))
    above = Window.partitionBy("node").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("node", "part", *(F.sum(c).over(above).alias(f"give_{c}") for c in "nw")).filter("give_n > 0")
    own = found.withColumns({"node": node, "part": part, "side": F.when(left, 2).otherwise(1)} | {f"give_{c}": F.when(left, F.col(c)).otherwise(0) for c in "nw"})
    rows = own.unionByName(carried.withColumn("side", F.lit(0)), allowMissingColumns=True)
    # what is carried comes first, then larger levels, and of one level the right half: it counts what is strictly above
    order = Window.partitionBy("node", "part").orderBy(F.col("side") > 0, F.desc("level"), "side")
    frame = order.rowsBetween(Window.unboundedPreceding, -1)
    takes = (F.col("side") == 1) if d else F.lit(True)
    rows = rows.withColumns({f"got_{c}": F.sum(f"give_{c}").over(frame) for c in "nw"}).filter("side > 0")
    kept = [c for c in found.columns if c not in ("above_n", "above_w")]
    return rows.select(*kept, *((F.col(f"above_{c}") + F.when(takes, F.coalesce(f"got_{c}", F.lit(0))).otherwise(0)).alias(f"above_{c}") for c in "nw"))


def dominance(rows: DataFrame) -> DataFrame:
    """(slot, level, above_n, above_w) of every distinct slot and level of rows (slot, level, w), both not null."""
    cells, depth = cells_of(rows)
    blocks = written(cells.groupBy("rank", "block", "shifts").agg(F.sum("n").alias("n"), F.sum("w").alias("w")), "blocks")
    found, tables = cells.withColumns({"above_n": F.lit(0).cast("long"), "above_w": F.lit(0).cast("long")}), [cells]
    for d in range(depth + 1):
        found = one_level(found, blocks, d)
        if d % CUT == CUT - 1 or d == depth:
            found = written(found, "counted")
            forget(tables.pop())
            tables.append(found)
    forget(blocks)
    return found.select("slot", "level", "above_n", "above_w")


def rows_above(df: DataFrame, id_column: str, time_column: str, amount_column: str) -> DataFrame:
    """(id, slot, level, n_above, rows_above) for every row of df: how many rows are above it, and how many rows those stand for.

    A row stands for one row, or two if the crc32 of its id in decimal digits is odd; a null id counts as an empty text.
    """
    odd = F.crc32(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).cast("binary")) % 2
    base = df.select(F.col(f"`{id_column}`").alias("id"), slot_of(df, time_column).alias("slot"), level_of(F.col(f"`{amount_column}`").cast("double")).alias("level"), (odd + 1).alias("w"))
    whole = F.col("slot").isNotNull() & F.col("level").isNotNull()
    counts = dominance(base.filter(whole).select("slot", "level", "w"))
    placed = base.filter(whole).join(counts, ["slot", "level"])
    rest = base.filter(~whole).withColumns({"above_n": F.lit(None).cast("long"), "above_w": F.lit(None).cast("long")})
    return placed.unionByName(rest, allowMissingColumns=True).select("id", "slot", "level", F.col("above_n").alias("n_above"), F.col("above_w").alias("rows_above"))
