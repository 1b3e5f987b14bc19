"""As-of joins: the latest right row that a left row may know, by one time or by two."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import MEASURED, Crowds, Cut, Split, running, running_all
from tidemark.sources.scratch import forget, written


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False, split: Split = None) -> DataFrame:
    """left with `values` of the right row of the same keys that is latest at or before left_time (strict: before it).

    Both sides go through one exchange and one sort by key and time; a running last() carries the right row along. right
    has one row per key and time at most. Rows with a null key or time match nothing and take no part; unmatched rows have
    null values.

    split: for keys that hold a large share of all rows. MEASURED counts the keys first and cuts the crowded ones (see
    scan). A period ('month', 'year', ...) cuts every key without counting: windows are then a key and a period, and what
    a period starts with is carried over from a table of the last right row of each period, joined on the columns that
    the windows are dealt by.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    named = [F.col(k).alias(n) for n, k in zip(keys, by, strict=True)]
    whole = lambda df, time: df.filter(reduce(and_, (F.col(c).isNotNull() for c in [*by, time])))
    known = whole(right, right_time).select(*named, F.col(right_time).alias("_time"), F.lit(1 if strict else 0).alias("_tag"), F.struct(*values).alias("_right"))
    rows = whole(left, left_time).select(*named, F.col(left_time).alias("_time"), F.lit(0 if strict else 1).alias("_tag"), F.struct(*left.columns).alias("_left"))
    both = rows.unionByName(known, allowMissingColumns=True)
    if split in (None, MEASURED) or isinstance(split, Crowds):
        found = running(both, keys, ["_time", "_tag"], F.col("_right"), "_right", "last", split).filter("_left is not null")
    else:
        found = _last_by_period(both, keys, split)
    found = found.select("_left.*", *(F.col("_right")[v].alias(v) for v in values))
    rest = left.filter(reduce(or_, (F.col(c).isNull() for c in [*by, left_time])))
    kinds = {f.name: f.dataType for f in right.schema}
    return found.union(rest.select(*left.columns, *(F.lit(None).cast(kinds[v]).alias(v) for v in values)))


def _last_by_period(both: DataFrame, keys: list[str], period: str) -> DataFrame:
    both = both.withColumn("_period", F.date_trunc(period, F.col("_time")))
    order = Window.partitionBy(*keys, "_period").orderBy("_time", "_tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_right", F.last("_right", ignorenulls=True).over(order)).filter("_left is not null")
    ends = both.groupBy(*keys, "_period").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_time"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(F.col(n).alias(f"{n}_e") for n in (*keys, "_period")), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    found = found.join(ends, [F.col(n) == F.col(f"{n}_e") for n in (*keys, "_period")], "left")
    return found.withColumn("_right", F.coalesce("_right", "_carried"))


def state_as_known(days: DataFrame, events: DataFrame, by: list[str], at: str, effective: str, announced: str, values: list[str], known: str | None = None, ties: tuple[str, ...] = (), split: Split = None) -> DataFrame:
    """days with `values` of the event of the same keys that is in effect at `at`, as far as was announced by `known`.

    Of the events announced at or before `known` and effective at or before `at`, the one with the latest effective time;
    of those the last announced, then the largest `ties`. Events announced after they took effect count from their
    announcement on, and do not replace what took effect later but was announced before. known: None if both times of a
    row are `at`. Rows with a null key or time, and events without one of their times, match nothing.

    With one time, an event counts from the later of its two times, and a running maximum by effective time over those
    rows is the answer: one exchange. With two, see states_as_known.
    """
    if known is not None:
        found = states_as_known(days, events, by, at, effective, announced, values, {"_known": known}, ties, split)
        return found.select(*days.columns, *(F.col("_known")[v].alias(v) for v in values))
    keys = [f"_k{i}" for i in range(len(by))]
    named = [F.col(k).alias(n) for n, k in zip(keys, by, strict=True)]
    facts = _facts(events, by, effective, announced, values, ties)
    asked = days.select(*named, F.col(at).alias("_t0")).filter(reduce(and_, (F.col(c).isNotNull() for c in [*keys, "_t0"]))).distinct()
    rows = facts.select(*keys, F.greatest("_time", "_fact._announced").alias("_time"), F.lit(0).alias("_tag"), F.struct("_time", "_fact").alias("_fact"))
    both = rows.unionByName(asked.select(*keys, F.col("_t0").alias("_time"), F.lit(1).alias("_tag")), allowMissingColumns=True)
    found = running(both, keys, ["_time", "_tag"], F.col("_fact"), "_best", "max", split).filter("_tag = 1")
    found = found.select(*keys, F.col("_time").alias("_t0"), *(F.col("_best._fact._values")[v].alias(f"_{v}_known") for v in values))
    on = [F.col(c) == F.col(n) for c, n in zip([*by, at], [*keys, "_t0"], strict=True)]
    return days.join(found, on, "left").select(*(days[c] for c in days.columns), *(F.col(f"_{v}_known").alias(v) for v in values))


def _facts(events: DataFrame, by: list[str], effective: str, announced: str, values: list[str], ties: tuple[str, ...]) -> DataFrame:
    """(_k0, _k1, ..., _time, _fact): the events that have keys and both times; _fact orders those of one effective time."""
    usable = reduce(and_, (F.col(c).isNotNull() for c in [*by, effective, announced]))
    fact = F.struct(F.col(announced).alias("_announced"), F.struct(*ties).alias("_ties") if ties else F.lit(0).alias("_ties"), F.struct(*values).alias("_values"))
    return events.filter(usable).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.col(effective).alias("_time"), fact.alias("_fact"))


def states_as_known(days: DataFrame, events: DataFrame, by: list[str], at: str, effective: str, announced: str, values: list[str], known: dict[str, str], ties: tuple[str, ...] = (), split: Split = None) -> DataFrame:
    """days with a struct of `values` for each entry of known, {name: column of days}: what was known by several times.

    Each is that of state_as_known with this time; null where there is none. `at` may be one of the times.

    All times are answered by one scan: rows and events of a key go through one exchange and one sort by effective time,
    which numbers the events and gives each row the last one in effect. Where that was announced in time, it is the answer.
    Only for the other rows and times the nearest event before is looked for that was announced in time (_nearest).
    """
    keys = [f"_k{i}" for i in range(len(by))]
    facts = _facts(events, by, effective, announced, values, ties).withColumn("_tag", F.lit(0))
    named = [F.col(k).alias(n) for n, k in zip(keys, by, strict=True)]
    rows = days.filter(reduce(and_, (F.col(c).isNotNull() for c in [*by, at]))).select(*named, F.col(at).alias("_time"), F.lit(1).alias("_tag"), F.struct(*days.columns).alias("_row"))
    both = facts.unionByName(rows, allowMissingColumns=True)
    # places of events from 1, and for a row that of the last event in effect; for an event, _last is itself
    places = F.when(F.col("_tag") == 0, 1).otherwise(0).cast("long")
    cut = Cut(both, keys, ["_time", "_tag", "_fact"], split)
    scanned = running_all(cut, {"_place": (places, "sum"), "_last": (F.col("_fact"), "last")})
    scanned = written(scanned.select(*keys, "_tag", "_row", "_place", "_last"), "scanned", spread=True)
    cut.forget()

    asked, times = scanned.filter("_tag = 1"), [F.col("_row")[c] for c in known.values()]
    own = [F.when(F.col("_last._announced") <= t, F.col("_last._values")) for t in times]
    left = [F.coalesce((F.col("_place") > 1) & (F.col("_last._announced") > t), F.lit(False)) for t in times]
    some = reduce(or_, left)
    found = asked.filter(~some).select("_row.*", *(c.alias(n) for c, n in zip(own, known, strict=True)))
    late = F.array_compact(F.array(*(F.when(more, t) for more, t in zip(left, times, strict=True))))
    queries = written(asked.filter(some).select(*keys, "_place", F.explode(late).alias("_t1")).distinct(), "queries", spread=True)
    if not queries.isEmpty():
        nearest = _nearest(scanned.filter("_tag = 0").select(*keys, "_place", F.col("_last").alias("_fact")), queries, keys)
        more = asked.filter(some).select(*keys, "_place", "_row", *(c.alias(f"_own{i}") for i, c in enumerate(own)))
        for i, c in enumerate(known.values()):
            named = nearest.select(*(F.col(k).alias(f"_{k}_n") for k in [*keys, "_place"]), F.col("_t1").alias("_t1_n"), F.col("_best._values").alias(f"_near{i}"))
            same = [*(F.col(k) == F.col(f"_{k}_n") for k in [*keys, "_place"]), F.col("_row")[c] == F.col("_t1_n")]
            more = more.join(named, same, "left").drop("_t1_n", *(f"_{k}_n" for k in [*keys, "_place"]))
        found = found.union(more.select("_row.*", *(F.coalesce(f"_own{i}", f"_near{i}").alias(n) for i, n in enumerate(known))))
    forget(queries)
    rest = days.filter(reduce(or_, (F.col(c).isNull() for c in [*by, at])))
    return found.union(rest.select(*days.columns, *(F.lit(None).cast(found.schema[n].dataType).alias(n) for n in known)))


#: Events of a group, and groups of a group of the next level: 2 to the power of FAN.
FAN = 6


def _nearest(events: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _place, _t1, _best): of the events before _place, the last that was announced by _t1. Without one, maybe no row.

    Events are kept in groups of 64, groups in groups of 64 on the next level, and so on, each with the first announcement
    in it. Most queries end in the group they stand in; the others go up to the first level with an earlier group that has
    such an event, and down in it. Each step is an equi-join by key and group, so a crowded key is many groups; no event is
    copied, and nothing is repeated for days or for pairs.
    """
    group = lambda level: F.call_function("shiftright", F.col("_place") - 1, F.lit(FAN * level))
    last = lambda entries, *conditions: F.try_element_at(F.filter(entries, lambda e: reduce(and_, (c(e) for c in conditions))), F.lit(-1))
    announced = lambda e: e["_first"] <= F.col("_t1")
    told = lambda e: e["_fact"]["_announced"] <= F.col("_t1")
    query = [*keys, "_place", "_t1"]

    entries = events.select(*keys, group(1).alias("_group"), F.struct("_place", "_fact").alias("_entry"))
    leaves = written(entries.groupBy(*keys, "_group").agg(F.array_sort(F.collect_list("_entry")).alias("_entries")), "leaves", spread=True)
    own = last("_entries", told, lambda e: e["_place"] < F.col("_place"))
    near = written(queries.withColumn("_group", group(1)).join(leaves, [*keys, "_group"]).select(*query, own["_fact"].alias("_best")), "near", spread=True)

    largest, levels = leaves.agg(F.max("_group")).first()[0] or 0, 0
    while largest >> (FAN * levels):
        levels += 1
    if not levels:
        forget(leaves)
        return near
    # one entry for each group of the level below: its number and when the first of its events was announced
    below, floors = leaves.select(*keys, "_group", F.array_min(F.transform("_entries", lambda e: e["_fact"]["_announced"])).alias("_first")), []
    for level in range(1, levels + 1):
        above = below.groupBy(*keys, F.call_function("shiftright", F.col("_group"), F.lit(FAN)).alias("_group")).agg(F.array_sort(F.collect_list(F.struct(F.col("_group").alias("_place"), "_first"))).alias("_entries"))
        floors.append(above.withColumn("_level", F.lit(level)))
        below = above.select(*keys, "_group", F.array_min(F.transform("_entries", lambda e: e["_first"])).alias("_first"))
    floors = written(reduce(DataFrame.unionByName, floors), "floors")

    # up: the first level on which an earlier group has an event announced in time
    far = near.filter("_best is null").drop("_best").withColumn("_level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    shifted = lambda more: F.expr(f"shiftright(_place - 1, {FAN} * (_level + {more}))")
    far = far.withColumn("_group", shifted(1)).withColumn("_child", shifted(0)).join(floors, [*keys, "_level", "_group"])
    far = far.withColumn("_found", last("_entries", announced, lambda e: e["_place"] < F.col("_child"))["_place"]).filter("_found is not null")
    far = far.groupBy(*query).agg(F.min(F.struct("_level", "_found")).alias("_at")).select(*query, F.col("_at._level").alias("_level"), F.col("_at._found").alias("_group"))
    # and down again, in the last group of each level that has one
    for level in range(levels - 1, 0, -1):
        floor = floors.filter(F.col("_level") == level).select(*(F.col(k).alias(f"{k}_f") for k in keys), F.col("_group").alias("_group_f"), "_entries")
        same = [F.col(c) == F.col(f"{c}_f") for c in [*keys, "_group"]]
        far = far.join(floor, reduce(and_, [*same, F.col("_level") == level + 1]), "left")
        deeper = F.col("_entries").isNotNull()
        far = far.select(*query, F.when(deeper, level).otherwise(F.col("_level")).alias("_level"), F.when(deeper, last("_entries", announced)["_place"]).otherwise(F.col("_group")).alias("_group"))
    # as a table its size is known before the join, so that a small one does not deal all leaves once more
    far = written(far.select(*query, "_group"), "far", spread=True)
    deep = far.join(leaves, [*keys, "_group"]).select(*query, last("_entries", told)["_fact"].alias("_best"))
    found = written(near.filter("_best is not null").unionByName(deep), "nearest", spread=True)
    forget(leaves, near, floors, far)
    return found


def next_in_calendar(df: DataFrame, day: str, calendar: DataFrame, calendar_day: str, out: str, strict: bool) -> DataFrame:
    """df with the first calendar day after `day` (strict), or on or after it; null beyond the calendar's end.

    The calendar becomes a map of all days from its first to its last, some hundreds of rows for each year of history, so
    the join is an equi-join; adaptive execution broadcasts the map when its size allows.
    """
    days = calendar.select(F.col(calendar_day).cast("date").alias(out)).filter(F.col(calendar_day).isNotNull()).distinct()
    first = days.agg(F.min(out)).scalar()
    before = F.lag(out).over(Window.orderBy(out))
    spans = days.withColumn("_after", before).filter("_after is not null")
    low, high = (F.col("_after"), F.date_sub(out, 1)) if strict else (F.date_add("_after", 1), F.col(out))
    own = spans.select(out, F.explode(F.sequence(low, high)).alias("_day"))
    early = F.col(day) < first if strict else F.col(day) <= first
    joined = df.join(own, F.col(day) == F.col("_day"), "left").drop("_day")
    return joined.withColumn(out, F.when(early, first).otherwise(F.col(out)))
