"""Steps against announcements, expected members, daily refreshes, sized files, and staged views."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import alignment, combine, filters, scan
from tidemark.plans import composites
from tidemark.sources import tables
from tidemark.sources.scratch import shared_path

START = date(2024, 1, 1)  # a Monday


def on(n):
    return None if n is None else START + timedelta(days=n)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_alignment(steps, announced, trading, tolerance, window):
    place = lambda n: next((i for i, d in enumerate(trading) if d >= n), None) if n is not None and n >= trading[0] else None
    s = {(k, place(n)) for k, n in steps if k is not None and place(n) is not None}
    a = {(k, place(n)) for k, n in announced if k is not None and place(n) is not None}
    found, used_s, used_a = [], set(), set()
    for k, i in s:
        mine = [j for key, j in a if key == k]
        if not mine:
            continue
        j = min(mine, key=lambda j: (abs(i - j), j))
        back = min((x for key, x in s if key == k), key=lambda x: (abs(x - j), -x))
        if back == i and abs(i - j) <= window:
            lag = i - j
            found.append((k, on(trading[i]), on(trading[j]), lag, "matched" if 0 <= lag <= tolerance else "early" if lag < 0 else "late"))
            used_s.add((k, i))
            used_a.add((k, j))
    found += [(k, on(trading[i]), None, None, "unexplained") for k, i in s - used_s]
    found += [(k, None, on(trading[j]), None, "unanswered") for k, j in a - used_a]
    return sorted(found, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_steps_are_matched_one_to_one(spark, seed):
    rng = random.Random(seed)
    trading = [n for n in range(90) if n % 7 < 5 and n not in (30, 31)]
    keys = ["a", "a", "b", None]
    steps = [(rng.choice(keys), rng.choice([None, *range(-3, 95)])) for _ in range(60)] + [("only s", 4)]
    announced = [(rng.choice(keys), rng.choice([None, *range(-3, 95)])) for _ in range(60)] + [("only a", 5), ("sat", 5)]
    steps.append(("sat", 7))
    frame = lambda data, name: spark.createDataFrame([(k, on(n)) for k, n in data], f"k string, {name} date")
    index = alignment.calendar_index(spark.createDataFrame([(on(n),) for n in trading], "t date"), "t")
    got = rows(alignment.align_steps(frame(steps, "s"), frame(announced, "a"), ["k"], "s", "a", index, 1, 6))
    assert got == plain_alignment(steps, announced, trading, 1, 6)
    assert ("sat", on(7), on(7), 0, "matched") in got  # announced on a Saturday, seen on Monday


def test_expected_members_are_those_whose_spans_hold_the_day(spark, monkeypatch):
    monkeypatch.setattr(scan, "FEW", 20)
    rng = random.Random(5)
    spans = [(rng.choice("ab"), m, *((s := rng.randrange(40)), rng.choice([None, s, s + 5, s + 30]))) for m in range(30)] + [("a", 99, None, None), ("a", 98, None, 9)]
    seen = [(rng.choice("abc"), on(rng.randrange(-2, 60)), rng.randrange(30)) for _ in range(300)]
    dim = spark.createDataFrame([(g, m, on(s), on(e)) for g, m, s, e in spans], "g string, m int, f date, u date")
    got = rows(combine.completeness(spark.createDataFrame(seen, "g string, d date, m int"), dim, "g", ["d"], "m", "f", "u", scan.MEASURED))
    want = []
    for g, d in {(g, d) for g, d, _ in seen}:
        expected = sum(x == g and s is not None and on(s) <= d and (e is None or d < on(e)) for x, _, s, e in spans)
        n = len({m for x, y, m in seen if (x, y) == (g, d)})
        if expected:
            want.append((g, d, n, expected, int(n == expected)))
    assert got == sorted(want, key=repr)


def folders(spark, path):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return {r["path"] for r in files.select("path").collect()}


def test_refresh_writes_changed_days_only(spark):
    path = shared_path(spark, "refresh")
    frame = lambda data: spark.createDataFrame([(on(n), v) for n, v in data], "d date, v int")
    build = lambda df: df.groupBy("d").agg(F.sum("v").alias("v"))
    one = [(1, 5), (1, 6), (2, 7), (3, 1), (None, 9)]
    assert rows(tables.refresh_days(path, frame(one), "d", build)) == [(on(1),), (on(2),), (on(3),)]
    before = folders(spark, f"{path}/table")
    two = [(1, 6), (1, 5), (2, 7), (2, 0), (4, 4)]  # day 1 in another order, a late row of day 2, day 3 gone, day 4 new
    assert rows(tables.refresh_days(path, frame(two), "d", build)) == [(on(2),), (on(3),), (on(4),)]
    after = folders(spark, f"{path}/table")
    assert {f for f in before if "2024-01-02" in f} == {f for f in after if "2024-01-02" in f} != set()
    table = spark.read.schema("d date, v long").parquet(f"{path}/table")
    assert rows(table.select("d", "v")) == [(on(1), 11), (on(2), 7), (on(4), 4)]
    assert rows(tables.refresh_days(path, frame(two), "d", build)) == []
    assert folders(spark, f"{path}/table") == after


def test_files_are_sized_and_hold_disjoint_ranges(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot", f"c{rng.randrange(50)}"]), datetime(2020 + rng.randrange(3), 1 + rng.randrange(12), 5), k) for k in range(6000)]
    data += [("x", datetime(9999, 12, 31), -1), ("y", None, -2)]
    df = spark.createDataFrame(data, "code string, t timestamp_ntz, id long")
    path = shared_path(spark, "sized")
    tables.write_sorted_years(df, path, "t", ["code", "t", "id"], 20_000)
    back = spark.read.parquet(path).select("year", "code", "t", "id", "_metadata.file_path", "_metadata.file_size")
    assert sorted(map(tuple, back.select("code", "t", "id").collect()), key=repr) == sorted(data, key=repr)
    key = F.struct("code", "t", "id")
    files = back.groupBy("year", "file_path", "file_size").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    assert files.agg(F.max("file_size")).first()[0] <= 20_000
    per_year = {r["year"]: r["n"] for r in files.groupBy("year").agg(F.count("*").alias("n")).collect()}
    assert per_year[9999] == 1 and per_year[None] == 1 and 2 <= per_year[2021] < 8
    before = F.max("high").over(Window.partitionBy("year").orderBy("low").rowsBetween(Window.unboundedPreceding, -1))
    assert files.withColumn("b", before).filter("b >= low").count() == 0


def test_no_file_is_larger_than_asked_where_rows_differ_in_size(spark):
    rng = random.Random(2)
    data = [("a", on(1), k, "") for k in range(20_000)] + [("b", on(2), k, "".join(rng.choices("abcdefghijklmnop", k=400))) for k in range(400)]
    df = spark.createDataFrame(data, "code string, t date, id int, said string")
    path = shared_path(spark, "uneven")
    tables.write_sorted_years(df, path, "t", ["code", "id"], 40_000)
    back = spark.read.parquet(path).select("code", "t", "id", "said", "_metadata.file_path", "_metadata.file_size")
    assert sorted(map(tuple, back.select("code", "t", "id", "said").collect())) == sorted(data)
    files = back.groupBy("file_path", "file_size").agg(F.min(F.struct("code", "id")).alias("low"), F.max(F.struct("code", "id")).alias("high"))
    assert files.agg(F.max("file_size")).first()[0] <= 40_000
    before = F.max("high").over(Window.partitionBy().orderBy("low").rowsBetween(Window.unboundedPreceding, -1))
    assert files.withColumn("b", before).filter("b >= low").count() == 0


def test_no_task_sorts_more_than_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 300, raising=False)
    path = shared_path(spark, "short")
    tables.write_sorted_years(spark.range(1000).select("id", F.lit("2024-01-05").cast("date").alias("t")), path, "t", ["id"], 1 << 20)
    counts = [r["count"] for r in spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).count().collect()]
    assert sum(counts) == 1000 and max(counts) <= 300


def test_sized_files_of_nothing(spark):
    path = shared_path(spark, "none")
    tables.write_sorted_years(spark.createDataFrame([], "t date, v int"), path, "t", ["v"], 1000)
    assert folders(spark, path) == set()


def test_dividends_show_what_their_stages_had_made_known(spark):
    df = spark.createDataFrame([("x", on(1), on(10), on(20), on(25), 5.0, "done"), ("y", on(1), None, None, on(9), 6.0, "done"), ("z", on(30), on(31), on(32), on(33), 7.0, "done")], "code string, board_pub_date date, shareholder_pub_date date, implementation_pub_date date, ex_date date, cash_per_10 double, status string")
    view = lambda n: rows(filters.pit_view(df, "dividends", "board_pub_date", str(on(n))))
    assert view(5) == sorted([("x", on(1), None, None, None, None), ("y", on(1), None, None, None, None)], key=repr)
    assert ("x", on(1), on(10), None, None, None) in view(15)
    assert ("x", on(1), on(10), on(20), on(25), 5.0) in view(20)


def test_a_prospectus_is_no_first_disclosure(spark):
    line = lambda pub, source, profit: ("a", 2023, 1, on(pub), 1, source, 0, 100.0, 60.0, profit)
    kinds = "k string, y int, q int, pub_date date, source_id int, source string, report_type int"
    income = spark.createDataFrame([line(1, "prospectus", 1.0), line(9, composites.PERIODIC, 2.0), line(12, composites.PERIODIC, 3.0)], f"{kinds}, revenue double, cost double, profit double")
    balance = spark.createDataFrame([("a", 2023, 1, on(10), 1, composites.PERIODIC, 0, 50.0, 20.0, 30.0)], f"{kinds}, assets double, liability double, equity double")
    none = spark.createDataFrame([], "k string, y int, q int, eps int, ind_pub_date date")
    found = composites.build_financials_pit(income, balance, none, "k", "y", "q").collect()
    assert [(r["profit"], r["pub_date"]) for r in found] == [(2.0, on(10))]
