"""Scans over crowded keys, two-time as-of joins, version chains, interval sets and tree joins against plain versions."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tidemark.operators import asof, interval_sets, intervals, panel, revisions, scan

START = date(2024, 1, 1)


def on(n):
    return None if n is None else START + timedelta(days=n)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def few(monkeypatch):
    """Keys of more than 40 rows are crowded, and cut into many blocks."""
    monkeypatch.setattr(scan, "FEW", 40)
    monkeypatch.setattr(scan, "PIECES", 8)


@pytest.fixture(scope="module")
def crowded(spark):
    rng = random.Random(4)
    data = [(k, rng.choice(["a", "a", "a", "b", "c", None]), on(rng.choice([None, *range(60)])), rng.choice([1, 1, 2, 3, None])) for k in range(600)]
    data += [(1000 + k, f"own{k}", on(k), k) for k in range(30)]
    return spark.createDataFrame(data, "id long, k string, t date, v int").cache()


def test_crowded_keys_are_cut_and_others_are_not(spark, crowded, few):
    cut = scan.Cut(crowded, ["k"], ["t", "id"], scan.MEASURED)
    assert cut.crowded
    blocks = {r["k"]: (r["n"], r["low"]) for r in cut.rows.groupBy("k").agg(F.count_distinct("_block").alias("n"), F.min("_block").alias("low")).collect()}
    assert blocks["a"][0] > 3 and blocks["own3"] == (1, 0)
    assert cut.rows.groupBy("k", "_block").count().filter("_block > 0").agg(F.max("count")).first()[0] < 200
    assert not scan.Cut(crowded.limit(30), ["k"], ["t", "id"], scan.MEASURED).crowded


def test_rows_beside_are_those_of_the_plain_window(crowded, few):
    by = Window.partitionBy("k").orderBy("t", "id")
    value = F.struct("v", "t")
    for ahead, function in ((False, F.lag), (True, F.lead)):
        got = scan.beside(crowded, ["k"], ["t", "id"], {"other": value}, ahead, scan.MEASURED, "none")
        want = crowded.withColumn("other", function(value).over(by)).withColumn("none", function(F.lit(1)).over(by).isNull())
        assert rows(got.select("id", "other", "none")) == rows(want.select("id", "other", "none"))


def test_running_values_are_those_of_the_plain_window(crowded, few):
    by = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for how, plain in (("sum", F.sum("v")), ("max", F.max("v")), ("last", F.last("v", ignorenulls=True))):
        got = scan.running(crowded, ["k"], ["t", "id"], F.col("v"), "x", how, scan.MEASURED)
        assert rows(got.select("id", "x")) == rows(crowded.select("id", plain.over(by).alias("x")))


def test_operators_with_split_are_those_without(crowded, few):
    order = ["t", "id"]
    for f in (
        lambda split: panel.diff_prev(crowded, ["k"], order, "v", "x", split),
        lambda split: panel.change_points(crowded, ["k"], order, "v", split),
        lambda split: intervals.events_to_intervals(crowded, ["k"], "t", ["id"], "e", split),
        lambda split: intervals.fold_runs(crowded, ["k"], order, "v", split),
        lambda split: intervals.check_overlap(crowded.withColumn("e", F.date_add("t", 2)), ["k"], "t", "e", ["id"], split),
        lambda split: asof.asof_join(crowded, crowded.filter("v = 2").groupBy("k", F.date_add("t", 1).alias("u")).agg(F.max("id").alias("w")), ["k"], "t", "u", ["w"], split=split),
    ):
        assert rows(f(None)) == rows(f(scan.MEASURED))


def test_a_wrong_split_is_refused(crowded):
    with pytest.raises(ValueError, match="measured"):
        scan.beside(crowded, ["k"], ["t"], {"x": F.col("v")}, split="month")


def plain_known(days, events):
    found = []
    for i, k, at, known in days:
        best = max(((e, a, tie, v) for key, e, a, tie, v in events if None not in (k, at, known, e, a) and key == k and e <= at and a <= known), default=None)
        found.append((i, best and best[3]))
    return sorted(found, key=repr)


@pytest.mark.parametrize(("split", "fan"), [(None, 6), (scan.MEASURED, 1), (scan.MEASURED, 3)])
def test_states_as_known_by_two_times(spark, few, monkeypatch, split, fan):
    """Also with groups so small that a search goes up and down through many levels."""
    monkeypatch.setattr(asof, "FAN", fan)
    rng = random.Random(9)
    keys = ["a", "a", "a", "b", None]
    events = [(rng.choice(keys), *((n := rng.randint(0, 80)), n + rng.choice([0, 0, -5, 3, 40])), tie, f"v{tie}") for tie in range(250)]
    events += [("a", None, 3, 900, "no"), ("a", 3, None, 901, "no"), ("c", 10, 20, 902, "one")]
    days = [(i, rng.choice([*keys, "c", "z"]), rng.choice([None, *range(-2, 90)]), rng.choice([None, *range(-2, 130)])) for i in range(300)]
    days += [days[0], days[0], (999, "c", 15, 19), (998, "c", 15, 20), (997, "c", 9, 99)]
    left = spark.createDataFrame([(i, k, on(a), on(b), 1) for i, k, a, b in days], "i long, k string, at date, known date, v int")
    right = spark.createDataFrame([(k, on(e), on(a), tie, v) for k, e, a, tie, v in events], "k string, e date, a date, tie int, value string")
    args = (["k"], "at", "e", "a", ["value"])
    two = asof.state_as_known(left, right, *args, known="known", ties=("tie",), split=split)
    assert rows(two.select("i", "value")) == plain_known(days, events)
    assert two.columns == ["i", "k", "at", "known", "v", "value"]
    one = asof.state_as_known(left, right, *args, ties=("tie",), split=split)
    assert rows(one.select("i", "value")) == plain_known([(i, k, a, a) for i, k, a, _ in days], events)


@pytest.mark.parametrize(("split", "fan"), [(None, 6), (scan.MEASURED, 1)])
def test_states_as_known_by_several_times_are_those_of_each(spark, few, monkeypatch, split, fan):
    monkeypatch.setattr(asof, "FAN", fan)
    rng = random.Random(12)
    keys = ["a", "a", "a", "b", None]
    events = [(rng.choice(keys), *((n := rng.randint(0, 80)), n + rng.choice([0, 0, -5, 3, 40])), tie, f"v{tie}") for tie in range(250)]
    events += [("a", None, 3, 900, "no"), ("a", 3, None, 901, "no"), ("a", 70, 500, 902, "after all"), ("c", 10, 20, 903, "one"), ("c", 12, 20, 904, None)]
    days = [(i, rng.choice([*keys, "c", "z"]), rng.choice([None, *range(-2, 90)]), rng.choice([None, *range(-2, 130)])) for i in range(300)]
    days += [days[0], days[0], (999, "c", 11, 19), (998, "c", 11, 20), (997, "c", 12, 20)]
    left = spark.createDataFrame([(i, k, on(a), on(b), on(400)) for i, k, a, b in days], "i long, k string, at date, known date, end date")
    right = spark.createDataFrame([(k, on(e), on(a), tie, v) for k, e, a, tie, v in events], "k string, e date, a date, tie int, value string")
    got = asof.states_as_known(left, right, ["k"], "at", "e", "a", ["value"], {"then": "at", "later": "known", "end_of_it": "end"}, ("tie",), split)
    assert got.columns == [*left.columns, "then", "later", "end_of_it"]
    for name, time in (("then", lambda a, b: a), ("later", lambda a, b: b), ("end_of_it", lambda a, b: 400)):
        assert rows(got.select("i", f"{name}.value")) == plain_known([(i, k, a, time(a, b)) for i, k, a, b in days], events)


def test_rows_asked_at_two_times_are_not_shuffled_again_and_again(spark, sf_dir):
    """Every row goes through the exchange of the scan; besides, keys are counted and groups of sales and late arrivals dealt."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    stages = lambda: store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    seen = {s.stageId() for s in map(stages().apply, range(stages().size()))}
    queries()["bitemporal_asof"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    moved = sum(s.shuffleWriteRecords() for s in map(stages().apply, range(stages().size())) if s.stageId() not in seen)
    read = sum(spark.read.parquet(f"{sf_dir}/{name}.parquet").count() for name in ("clicks", "sales"))
    assert read <= moved <= 2 * read


def test_a_late_announcement_does_not_replace_a_later_effect(spark):
    events = spark.createDataFrame([("x", on(10), on(30), "late"), ("x", on(20), on(20), "later effect")], "k string, e date, a date, v string")
    days = spark.createDataFrame([("x", on(n)) for n in (15, 25, 35)], "k string, at date")
    assert [r["v"] for r in sorted(asof.state_as_known(days, events, ["k"], "at", "e", "a", ["v"]).collect())] == [None, "later effect", "later effect"]


def test_no_events_and_no_days(spark):
    none = spark.createDataFrame([], "k string, e date, a date, v string")
    days = spark.createDataFrame([("x", on(1), on(1))], "k string, at date, b date")
    for known in (None, "b"):
        assert [r["v"] for r in asof.state_as_known(days, none, ["k"], "at", "e", "a", ["v"], known=known, split=scan.MEASURED).collect()] == [None]
        assert asof.state_as_known(days.limit(0), none, ["k"], "at", "e", "a", ["v"], known=known).count() == 0


def plain_chain(data):
    found = []
    for key in {r[0] for r in data}:
        latest = {}
        for _, t, tie, value, gone in sorted((r for r in data if r[0] == key and r[1] is not None), key=lambda r: (r[1], r[2])):
            latest[t] = (tie, value, gone)
        said, versions = None, []
        for t, (tie, value, gone) in sorted(latest.items()):
            if (value, gone) != said:
                versions.append([t, tie, value, gone])
                said = (value, gone)
        kept = [(*x, y[0] if y else None) for x, y in zip(versions, [*versions[1:], None], strict=True) if not x[3]]
        found += [(key, tie, value, n, on(t), on(until), n == 1, n == len(kept)) for n, (t, tie, value, _, until) in enumerate(kept, 1)]
    return sorted(found, key=repr)


@pytest.mark.parametrize("split", [None, scan.MEASURED])
def test_version_chains(spark, few, split):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(200)]), k, rng.choice(["x", "y", None]), rng.random() < 0.2) for k in range(300)]
    data += data[:5] + [("only", 5, 1, "x", True), ("back", 1, 1, "x", False), ("back", 2, 2, "x", True), ("back", 3, 3, "x", False)]
    df = spark.createDataFrame([(k, on(t), tie, v, g) for k, t, tie, v, g in data], "k string, t date, tie int, v string, gone boolean")
    chain = revisions.revision_chain(df, ["k"], "t", ["tie"], ["v"], F.col("gone"), split)
    assert rows(chain) == plain_chain(data)
    for n in (0, 17, 400):
        at = on(n)
        want = [r for r in plain_chain(data) if r[4] <= at and (r[5] is None or r[5] > at)]
        assert rows(revisions.as_of(chain, F.lit(at))) == want
    asked = spark.createDataFrame([("a", on(n)) for n in range(-3, 210, 7)] + [(None, on(3))], "k string, at date")
    want = [(k, d, r[3]) for k, d in map(tuple, asked.collect()) for r in plain_chain(data) if k is not None and r[0] == k and r[4] <= d and (r[5] is None or r[5] > d)]
    assert rows(revisions.known_at(asked, chain, ["k"], "at", ["version"], split)) == sorted(want, key=repr)


FAR = range(-3, 130)


def days_of(spans):
    return {(k, n) for k, s, e in spans for n in FAR if (s is None or n >= s) and (e is None or n < e)}


def some_spans(rng, count):
    found = []
    for _ in range(count):
        s = rng.choice([None, *range(100)]) if rng.random() < 0.1 else rng.randrange(100)
        e = None if rng.random() < 0.05 else (s or 0) + rng.choice([-2, 0, 1, 1, 3, 9])
        found.append((rng.choice(["a", "a", "a", "b", None]), s, e))
    return found


def spans_frame(spark, spans):
    return spark.createDataFrame([(k, on(s), on(e)) for k, s, e in spans], "k string, s date, e date")


@pytest.mark.parametrize("split", [None, scan.MEASURED])
def test_interval_sets_are_those_of_their_days(spark, few, split):
    rng = random.Random(8)
    a, b = some_spans(rng, 90), [*some_spans(rng, 60), ("only b", 3, 9), ("touch", 1, 2), ("touch", 2, 4)]
    x, y = days_of(a), days_of(b)
    left, right = spans_frame(spark, a), spans_frame(spark, b)
    for op, want in (("union", x | y), ("intersection", x & y), ("difference", x - y), ("symmetric", x ^ y)):
        got = [(k, s and (s - START).days, e and (e - START).days) for k, s, e in map(tuple, interval_sets.combined(left, right, ["k"], "s", "e", op, split).collect())]
        assert days_of(got) == want
        assert len(days_of(got)) == sum(len(days_of([span])) for span in got)
        ends = {(k, e) for k, _, e in got}
        assert not any((k, s) in ends for k, s, _ in got if s is not None)  # none touches the next
    first, until = F.lit(on(-3)), F.lit(on(130))
    got = rows(interval_sets.compared_days(left, right, ["k"], "s", "e", first, until, split))
    count = lambda days, k: sum(key == k for key, _ in days)
    assert got == sorted(((k, count(x & y, k), count(x - y, k), count(y - x, k)) for k in {k for k, _ in x | y}), key=repr)
    assert days_of([(k, s and (s - START).days, e and (e - START).days) for k, s, e in map(tuple, interval_sets.merged(left, ["k"], "s", "e").collect())]) == x


@pytest.mark.parametrize("split", [None, scan.MEASURED])
def test_operations_of_one_sweep_are_those_of_their_own(spark, few, split):
    rng = random.Random(9)
    a, b = spans_frame(spark, some_spans(rng, 90)), spans_frame(spark, some_spans(rng, 60))
    got = interval_sets.combined_all(a, b, ["k"], "s", "e", ["union", "difference"], split)
    for op in ("union", "difference"):
        assert rows(got.filter(F.col("op") == op).drop("op")) == rows(interval_sets.combined(a, b, ["k"], "s", "e", op, split))


def test_tree_joins_are_nested_loops(spark):
    rng = random.Random(2)
    spans = [(k, *span[1:]) for k, span in enumerate(some_spans(rng, 80))] + [(900, -4000, 3000), (901, None, None), (902, 5, 5), (903, None, -100), (904, 500, None)]
    points = [(i, rng.choice([None, *range(-3, 130)]), rng.choice(["a", "b", None])) for i in range(200)]
    left = spark.createDataFrame([(i, on(n), k, 7) for i, n, k in points], "i long, d date, k string, s int")
    right = spark.createDataFrame([(j, on(s), on(e), rng.choice(["a", "b"])) for j, s, e in spans], "j long, s date, e date, k string")
    holds = lambda n, s, e: n is not None and (s is None or n >= s) and (e is None or n < e) and not (s is not None and e is not None and s >= e)
    got = interval_sets.dyadic_join(left, right.drop("k"), "d", "s", "e")
    want = sorted(((i, j) for i, n, _ in points for j, s, e in spans if holds(n, s, e)))
    assert sorted(map(tuple, got.select("i", "j").collect())) == want
    assert got.columns == ["i", "d", "k", "s", "j", "s", "e"]
    keyed = {r["j"]: r["k"] for r in right.collect()}
    got = interval_sets.dyadic_join(left, right, "d", "s", "e", ["k"]).select("i", "j")
    assert sorted(map(tuple, got.collect())) == [(i, j) for i, j in want if points[i][2] is not None and points[i][2] == keyed[j]]
    counts = interval_sets.stabbing_counts(left.select("i", "d"), right, "d", "s", "e", "n")
    assert rows(counts.select("i", "n")) == sorted(((i, None if n is None else sum(holds(n, s, e) for _, s, e in spans)) for i, n, _ in points), key=repr)
    for width in (1, 4, 40):
        assert sorted(map(tuple, intervals.range_join(left.drop("s"), right.drop("k"), "d", "s", "e", width).select("i", "j").collect())) == want


def test_a_range_has_few_nodes_and_they_are_disjoint(spark):
    points = spark.createDataFrame([(on(0),), (on(3652),)], "d date")
    spans = [(1, 3650), (0, 3653), (7, 8), (100, 1000)]
    ranges = spark.createDataFrame([(k, on(s), on(e)) for k, (s, e) in enumerate(spans)], "j int, s date, e date")
    tree = interval_sets.Tree(points, "d", "s", "e")
    cut = tree.cut(ranges, F.col("j")).collect()
    for k, (s, e) in enumerate(spans):
        own = [(r["_level"], r["_node"]) for r in cut if r["j"] == k]
        assert len(own) <= 2 * 12
        assert sorted(n for level, node in own for n in range(node << level, node + 1 << level)) == list(range(s, e))


def test_tree_joins_without_rows(spark):
    points, ranges = spark.createDataFrame([], "i int, d date"), spark.createDataFrame([], "j int, s date, e date")
    some = spark.createDataFrame([(1, on(3))], "i int, d date")
    assert interval_sets.dyadic_join(points, ranges, "d", "s", "e").count() == 0
    assert interval_sets.dyadic_join(some, ranges, "d", "s", "e").columns == ["i", "d", "j", "s", "e"]
    assert [tuple(r) for r in interval_sets.stabbing_counts(some, ranges, "d", "s", "e", "n").select("i", "n").collect()] == [(1, 0)]
