"""Sets of intervals of a key as sets of times: union, intersection, difference, and how much of each; stabbing joins.

Intervals are [start, end), a null start or end open. They may overlap, touch, repeat and be empty. Nothing is expanded to
days: an interval is its two ends, and ends are swept in order, in blocks where a key holds a large share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import Crowds, Split, beside, crowds, running

#: Which times each operation keeps, from whether either set holds them.
KEEPS = {
    "union": lambda a, b: a | b,
    "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "symmetric": lambda a, b: a != b,
}


def _ends(df: DataFrame, keys: list[str], start: str, end: str, side: str) -> DataFrame:
    """Two rows of each interval that is not empty: +1 where it starts, -1 where it ends; open ends as a flag before all times or none."""
    held = df.filter(F.col(start).isNull() | F.col(end).isNull() | (F.col(start) < F.col(end)))
    edge = lambda t, first, n: F.struct(F.col(t).alias("_time"), F.lit(first).alias("_begins"), F.lit(n).alias("_d"))
    both = F.array(edge(start, True, 1), edge(end, False, -1))
    rows = held.select(*keys, F.explode(both).alias("_e")).select(*keys, "_e.*").filter("_time is not null or _begins")
    other = "b" if side == "a" else "a"
    return rows.withColumn(f"_d{side}", F.col("_d").cast("long")).withColumn(f"_d{other}", F.lit(0).cast("long")).drop("_d", "_begins")


def _both() -> Column:
    """The changes of both sets as one number, so that one running sum counts both: fewer than 2^31 intervals of a key hold at once."""
    return F.col("_da") * (1 << 32) + F.col("_db")


def _held(n: Column) -> tuple[Column, Column]:
    """Whether either set holds, from a running sum of _both."""
    return n >= 1 << 32, n.bitwiseAND(F.lit((1 << 32) - 1)) > 0


def segments(a: DataFrame, b: DataFrame | None, keys: list[str], start: str, end: str, split: Split = None) -> DataFrame:
    """(keys, start, end, in_a, in_b): the times between two neighbouring ends, and which set holds them.

    The first segment of a key may have a null start, the last has a null end. Ends at one time are added up before they
    are sent; null keys are a key.
    """
    rows = _ends(a, keys, start, end, "a")
    rows = rows if b is None else rows.unionByName(_ends(b, keys, start, end, "b"))
    rows = rows.groupBy(*keys, "_time").agg(F.sum("_da").alias("_da"), F.sum("_db").alias("_db"))
    split = crowds(rows, keys, "_time", split)
    rows = running(rows, keys, ["_time"], _both(), "_n", "sum", split)
    rows = beside(rows.drop("_da", "_db"), keys, ["_time"], {"_until": F.col("_time")}, ahead=True, split=split)
    in_a, in_b = _held(F.col("_n"))
    return rows.select(*keys, F.col("_time").alias(start), F.col("_until").alias(end), in_a.alias("in_a"), in_b.alias("in_b"))


def combined(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str, operation: str, split: Split = None) -> DataFrame:
    """(keys, start, end): the times that the operation keeps, as the fewest intervals: disjoint, and none touches the next."""
    return combined_all(a, b, keys, start, end, [operation], split).drop("op")


def combined_all(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str, operations: list[str], split: Split = None) -> DataFrame:
    """(keys, op, start, end): what combined gives, of several operations in one sweep over the ends.

    How many intervals of each set hold before and after a time follows from one running sum, so a time changes an
    operation or not by itself; only changes are put next to each other.
    """
    rows = _ends(a, keys, start, end, "a").unionByName(_ends(b, keys, start, end, "b"))
    rows = rows.groupBy(*keys, "_time").agg(F.sum("_da").alias("_da"), F.sum("_db").alias("_db"))
    split = crowds(rows, keys, "_time", split)
    rows = running(rows, keys, ["_time"], _both(), "_n", "sum", split)
    now, before = _held(F.col("_n")), _held(F.col("_n") - _both())
    kept = [(op, KEEPS[op](*now), KEEPS[op](*before)) for op in operations]
    changed = F.array_compact(F.array(*(F.when(x != y, F.struct(F.lit(op).alias("op"), x.alias("_kept"))) for op, x, y in kept)))
    changes = rows.select(*keys, F.col("_time").alias(start), F.explode(changed).alias("_c")).select(*keys, "_c.*", start)
    # the changes of an operation are no more than the times that were cut
    found = beside(changes, [*keys, "op"], [start], {end: F.col(start)}, ahead=True, split=_of_operations(split, keys, operations))
    return found.filter("_kept").select(*keys, "op", start, end)


def _of_operations(split: Split, keys: list[str], operations: list[str]) -> Split:
    """The cuts of keys as those of each key and operation."""
    if split is None:
        return None
    ops = F.explode(F.array(*(F.lit(op) for op in operations))).alias(f"_crowd{len(keys)}")
    return Crowds(split.cuts.select("*", ops), split.time)


def merged(a: DataFrame, keys: list[str], start: str, end: str, split: Split = None) -> DataFrame:
    """(keys, start, end): the times of one set as the fewest intervals."""
    nothing = a.select(*keys, start, end).limit(0)
    return combined(a, nothing, keys, start, end, "union", split)


def compared_days(truth: DataFrame, pred: DataFrame, keys: list[str], start: str, end: str, first: Column, until: Column, split: Split = None) -> DataFrame:
    """(keys, covered, missed, spurious): days of [first, until) that both sets hold, that only truth and that only pred holds.

    Equal to counting the days of either set one by one; keys without a day in either set have no row.
    """
    rows = segments(truth, pred, keys, start, end, split)
    days = F.greatest(F.datediff(F.least(F.coalesce(end, until), until), F.greatest(F.coalesce(start, first), first)), F.lit(0)).cast("long")
    count = lambda which: F.sum(F.when(which, days).otherwise(0))
    a, b = F.col("in_a"), F.col("in_b")
    return rows.groupBy(*keys).agg(count(a & b).alias("covered"), count(a & ~b).alias("missed"), count(~a & b).alias("spurious")).filter("covered + missed + spurious > 0")


class Tree:
    """A binary tree over the days from the first point to the last, and the nodes that cover a range."""

    def __init__(self, points: DataFrame, at: str, start: str, end: str):
        first, last = points.agg(F.min(F.unix_date(at)), F.max(F.unix_date(at))).first()
        self.first, last = (0, 0) if first is None else (first, last)
        size = last - self.first + 1
        within = lambda c, other: F.greatest(F.least(F.coalesce(F.unix_date(c) - self.first, F.lit(other)), F.lit(size)), F.lit(0))
        low, high = within(F.col(start), 0), within(F.col(end), size)

        def nodes(level: Column) -> Column:
            left, right = F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1), level) - 1, level), F.call_function("shiftright", high, level)
            node = lambda n, used: F.when(used & (left < right), F.struct(level.alias("level"), n.alias("node")))
            return F.array(node(left, left % 2 == 1), node(right - 1, right % 2 == 1))

        every = F.sequence(F.lit(0), F.lit(size.bit_length()))
        self.cover = F.filter(F.flatten(F.transform(every, nodes)), lambda x: x.isNotNull())
        self.usable = F.col(start).isNull() | F.col(end).isNull() | (F.col(start) < F.col(end))

    def cut(self, ranges: DataFrame, *kept: Column) -> DataFrame:
        """kept, _level and _node of every node of every range."""
        found = ranges.filter(self.usable).select(*kept, F.explode(self.cover).alias("_n"))
        return found.select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")

    def above(self, points: DataFrame, at: str, cut: DataFrame) -> DataFrame:
        """points with _level and _node of the node above their day, of each level that has nodes; 40 levels at most."""
        used = sorted(r["_level"] for r in cut.select("_level").distinct().collect()) or [0]
        nodes = F.explode(F.array(*(F.struct(F.lit(k).alias("_level"), F.shiftright(F.unix_date(at) - self.first, k).alias("_node")) for k in used)))
        return points.filter(F.col(at).isNotNull()).select("*", nodes.alias("_m")).select(*points.columns, "_m.*")


def dyadic_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """points joined to the ranges [start, end) of days that hold their day, of any length and open on either side.

    A range is cut into the largest whole nodes of a binary tree inside it, two of a level at most: 24 rows for ten years.
    A point meets the nodes above its day, one of each level that ranges use; the nodes of a range are disjoint, so the
    equi-join by level and node gives every pair once and no other, and nothing has to be filtered afterwards. by: columns
    of the same name that have to agree too; those of ranges are dropped, as is no other column, whatever its name. Points
    without a day, empty ranges and null `by` match nothing.
    """
    tree = Tree(points, at, start, end)
    kept = [c for c in ranges.columns if c not in by]
    cut = tree.cut(ranges, *(F.col(c).alias(f"_by_{c}") for c in by), F.struct(*kept).alias("_range"))
    asked = tree.above(points, at, cut)
    on = [asked["_level"] == cut["_level"], asked["_node"] == cut["_node"], *(asked[c] == cut[f"_by_{c}"] for c in by)]
    return asked.join(cut, on).select(*(asked[c] for c in points.columns), *(F.col("_range")[c].alias(c) for c in kept))


def stabbing_counts(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, out: str) -> DataFrame:
    """points with out: how many ranges [start, end) of days hold their day. No pair is made.

    Ranges of one start and end are counted first, then nodes; the count of a day is the sum over the nodes above it. Days
    are as many as the calendar has, whatever the number of points and ranges. Points without a day have no count.
    """
    tree = Tree(points, at, start, end)
    same = ranges.groupBy(start, end).agg(F.count("*").alias("_c"))
    cut = tree.cut(same, "_c")
    nodes = cut.groupBy("_level", "_node").agg(F.sum("_c").alias("_c"))
    days = points.select(F.col(at).alias("_day")).distinct()
    counts = tree.above(days, "_day", cut).join(nodes, ["_level", "_node"]).groupBy("_day").agg(F.sum("_c").alias("_held"))
    held = F.when(F.col(at).isNotNull(), F.coalesce("_held", F.lit(0)))
    return points.join(counts, F.col(at) == F.col("_day"), "left").withColumn(out, held).drop("_day", "_held")
