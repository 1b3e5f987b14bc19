"""Edges that the fixtures do not show, on small frames made by hand."""

import random
from datetime import date, datetime

import duckdb
import numpy
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar as S
from tidemark.operators import asof, combine, filters, intervals, panel, periods, quality
from tidemark.plans import composites
from tidemark.plans.registry import QUERIES, SQL


def d(text):
    return date.fromisoformat(text)


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(x is not None, x) for x in r])


def test_asof_takes_ties_only_if_not_strict_and_never_matches_null_keys(spark):
    left = spark.createDataFrame([(1, "a", d("2024-01-05")), (2, "a", d("2024-01-04")), (3, None, d("2024-01-09")), (4, "b", d("2024-01-09")), (5, "a", None)], "id int, k string, t date")
    right = spark.createDataFrame([("a", d("2024-01-05"), 50), ("a", d("2024-01-01"), 10), (None, d("2024-01-01"), 99)], "k string, u date, v int")
    assert rows(asof.asof_join(left, right, ["k"], "t", "u", ["v"]).select("id", "v")) == [(1, 50), (2, 10), (3, None), (4, None), (5, None)]
    assert rows(asof.asof_join(left, right, ["k"], "t", "u", ["v"], strict=True).select("id", "v")) == [(1, 10), (2, 10), (3, None), (4, None), (5, None)]


def test_asof_equals_its_interval_form(spark):
    left = spark.range(200).select(F.col("id"), (F.col("id") % 7).alias("k"), F.date_add(F.lit(d("2024-01-01")), (F.col("id") * 13 % 90).cast("int")).alias("t"))
    right = spark.range(60).select((F.col("id") % 7).alias("k"), F.date_add(F.lit(d("2024-01-01")), (F.col("id") * 5 % 90).cast("int")).alias("u"), F.col("id").alias("v")).dropDuplicates(["k", "u"])
    spans = intervals.events_to_intervals(right, ["k"], "u", ["v"])
    left = left.unionByName(spark.createDataFrame([(900, None, d("2024-02-01")), (901, 3, None)], "id long, k long, t date"))
    for strict in (False, True):
        plain, split = (rows(asof.asof_join(left, right, ["k"], "t", "u", ["v"], strict, split).select("id", "v")) for split in (None, "month"))
        assert plain == split
    by_interval = intervals.in_interval(left, spans, ["k"], "t", "u", "end_exclusive", "left").select("id", "v")
    assert rows(asof.asof_join(left, right, ["k"], "t", "u", ["v"]).select("id", "v")) == rows(by_interval)


def test_next_day_in_calendar(spark):
    days = spark.createDataFrame([(d("2024-01-05"),), (d("2024-01-06"),), (d("2024-01-08"),), (d("2023-01-01"),)], "day date")
    calendar = spark.createDataFrame([(d("2024-01-05"),), (d("2024-01-08"),), (None,)], "c date")
    same = asof.next_in_calendar(days, "day", calendar, "c", "n", strict=False)
    after = asof.next_in_calendar(days, "day", calendar, "c", "n", strict=True)
    assert rows(same) == [(d("2023-01-01"), d("2024-01-05")), (d("2024-01-05"), d("2024-01-05")), (d("2024-01-06"), d("2024-01-08")), (d("2024-01-08"), d("2024-01-08"))]
    assert [r[1] for r in rows(after)] == [d("2024-01-05"), d("2024-01-08"), d("2024-01-08"), None]


def test_runs_bridge_days_without_trading_and_restore_the_flags(spark):
    flagged = [d("2024-01-05"), d("2024-01-08"), d("2024-01-10")]
    days = [d("2024-01-04"), *flagged[:2], d("2024-01-09"), d("2024-01-10")]
    df = spark.createDataFrame([("x", day, day in flagged) for day in days] + [("x", flagged[0], True)], "k string, day date, flag boolean")
    calendar = intervals.calendar_of(df, "day")
    runs = intervals.flags_to_runs(df, ["k"], "day", F.col("flag"), calendar)
    assert rows(runs) == [("x", d("2024-01-05"), d("2024-01-08"), d("2024-01-09"), 2, False), ("x", d("2024-01-10"), d("2024-01-10"), None, 1, True)]
    back = intervals.in_interval(calendar.withColumn("k", F.lit("x")), runs, ["k"], "day", "start_day", "end_exclusive").select("day")
    assert [r[0] for r in rows(back)] == flagged


def test_fold_runs_keeps_nulls_as_a_value(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(["x", "x", None, None, "x"])], "k string, t int, v string")
    assert rows(intervals.fold_runs(df, ["k"], ["t"], "v")) == [("a", None, 2, 3, 2, 4), ("a", "x", 0, 1, 2, 2), ("a", "x", 4, 4, 1, None)]


def test_range_join_equals_nested_loop(spark):
    points = spark.range(100).select("id", F.date_add(F.lit(d("2024-01-01")), (F.col("id") * 7 % 50).cast("int")).alias("day"))
    spans = spark.range(30).select(F.col("id").alias("s"), F.date_add(F.lit(d("2024-01-01")), (F.col("id") * 3).cast("int")).alias("a")).withColumn("b", F.date_add("a", (F.col("s") % 9).cast("int")))
    loop = points.join(spans, (F.col("day") >= F.col("a")) & (F.col("day") < F.col("b"))).select("id", "s")
    for width in (1, 4, 30):
        assert rows(intervals.range_join(points, spans, "day", "a", "b", width).select("id", "s")) == rows(loop)


def test_pairs_of_a_range_join_come_day_by_day(spark):
    day_of = lambda c: F.date_add(F.lit(d("2024-01-01")), c.cast("int"))
    points = spark.range(200).select("id", day_of(F.col("id") % 20).alias("day"))
    spans = spark.range(200).select(F.col("id").alias("s"), day_of(F.col("id") * 31 % 20).alias("a")).withColumn("b", F.date_add("a", 1))
    got = intervals.range_join(points, spans, "day", "a", "b", 4).select("id", "day").collect()
    assert len(got) == 2000
    assert sum(x["day"] != y["day"] for x, y in zip(got, got[1:])) == 19
    assert sum(x["id"] != y["id"] for x, y in zip(got, got[1:])) == 199


def one_day(spark, n, m):
    """n points and m ranges of one day, which is no literal for the optimizer."""
    day = F.date_add(F.lit(d("2024-01-01")), (F.col("id") % 1).cast("int"))
    return spark.range(n).select("id", day.alias("day")), spark.range(m).select(F.col("id").alias("s"), day.alias("a")).withColumn("b", F.date_add("a", 1))


def test_a_range_join_hands_on_the_pairs_of_one_point_at_a_time(spark):
    points, spans = one_day(spark, 1000, 1000)
    first = intervals.range_join(points, spans, "day", "a", "b", 4, ["s"]).limit(1)
    assert len(first.collect()) == 1
    node = first._jdf.queryExecution().executedPlan().executedPlan().plan()
    while node.nodeName() != "Generate":
        node = node.children().head()
    assert node.metrics().apply("numOutputRows").value() <= 1000


def test_a_crowded_day_of_a_range_join_is_several_tasks(spark):
    points, spans = one_day(spark, 6000, 5000)
    pairs = intervals.range_join(points, spans, "day", "a", "b", 4, ["s"])
    tasks = pairs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(t["n"] for t in tasks) == 6000 * 5000
    assert max(t["n"] for t in tasks) < 20_000_000


@pytest.mark.parametrize("keep", [["v"], ["s", "v"], None])
def test_a_range_join_keeps_nulls_and_repeated_rows_over_lists_and_slices(spark, monkeypatch, keep):
    monkeypatch.setattr(intervals, "LIST", 4)
    monkeypatch.setattr(intervals, "PAIRS", 64)
    day_of = lambda c: F.date_add(F.lit(d("2024-01-01")), c.cast("int"))
    points = spark.range(300).select(F.when(F.col("id") % 7 > 0, F.col("id") % 90).alias("id"), F.when(F.col("id") % 11 > 0, day_of(F.col("id") % 3)).alias("day"))
    spans = spark.range(60).select((F.col("id") % 40).alias("s"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("v"), day_of(F.col("id") % 4 - 1).alias("a")).withColumn("b", F.date_add("a", (F.col("s") % 5).cast("int")))
    wanted = ["id", "day", *(spans.columns if keep is None else keep)]
    loop = points.join(spans, (F.col("day") >= F.col("a")) & (F.col("day") < F.col("b"))).select(*wanted)
    got = intervals.range_join(points, spans, "day", "a", "b", 4, keep)
    assert got.columns == wanted
    assert rows(got) == rows(loop)


def test_parts_without_key_or_size_have_no_range(spark, tmp_path):
    spark.createDataFrame([(1, datetime(1995, 2, 7)), (None, datetime(1995, 2, 7)), (2, None)], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1), (None, 1), (1, None), (None, None)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(SQL["range_join_bucketed"]).fetchall()
    assert len(want) == 2
    assert rows(QUERIES["range_join_bucketed"](spark, str(tmp_path))) == sorted(want, key=lambda r: [(x is not None, x) for x in r])


def test_overlap_finds_open_and_empty_intervals(spark):
    df = spark.createDataFrame([("a", d("2024-01-01"), None), ("a", d("2024-02-01"), d("2024-03-01")), ("b", d("2024-01-01"), d("2024-01-01")), ("c", d("2024-01-01"), d("2024-02-01")), ("c", d("2024-02-01"), None)], "k string, s date, e date")
    assert [r[0] for r in rows(intervals.check_overlap(df, ["k"], "s", "e", []))] == ["a", "b"]


@pytest.fixture
def quarters(spark):
    data = [("a", 2022, q, float(10 * q), d(f"2022-{3 * q:02d}-28")) for q in (1, 2, 3, 4)] + [("a", 2023, 1, 14.0, d("2023-03-28")), ("a", 2023, 3, 33.0, d("2023-09-28")), ("b", 2022, 1, -5.0, d("2022-03-01")), ("b", 2023, 1, 5.0, d("2023-03-01"))]
    return spark.createDataFrame(data, "k string, y int, q int, cum double, pub date")


def test_ttm_needs_all_parts_and_knows_when_they_were_known(quarters):
    got = {r[:3]: r[3:] for r in rows(periods.ttm(quarters, ["k"], "y", "q", "cum", "pub").select("k", "y", "q", "ttm", "ttm_available"))}
    assert got["a", 2022, 4] == (40.0, d("2022-12-28"))
    assert got["a", 2023, 1] == (14.0 + 40 - 10, d("2023-03-28"))
    assert got["a", 2022, 1] == got["b", 2023, 1] == (None, None)


def test_yoy_is_null_on_bases_that_are_not_positive(quarters):
    got = {r[:3]: r[3] for r in rows(periods.yoy(quarters, ["k"], "y", "q", "cum").select("k", "y", "q", "yoy"))}
    assert got["a", 2023, 1] == pytest.approx(0.4) and got["b", 2023, 1] is None and got["a", 2022, 2] is None


def test_growth_is_known_once_both_values_were(quarters):
    late = quarters.withColumn("pub", F.when(F.col("y") == 2022, F.lit(d("2023-06-30"))).otherwise(F.col("pub")))
    got = {r[:3]: r[3] for r in rows(periods.yoy(late, ["k"], "y", "q", "cum", "pub").select("k", "y", "q", "yoy_available"))}
    assert got["a", 2023, 1] == d("2023-06-30") and got["a", 2023, 3] == d("2023-09-28") and got["b", 2023, 1] is None


def test_quarter_values_stop_at_a_gap_and_sum_up_again(quarters):
    own = periods.ytd_to_quarter(quarters, ["k"], "y", "q", "cum", "own")
    got = {r[:3]: r[3] for r in rows(own.select("k", "y", "q", "own"))}
    assert got["a", 2022, 3] == 10.0 and got["a", 2023, 3] is None
    again = periods.ytd(own.filter("y = 2022 and k = 'a'"), ["k"], "y", "q", "own", "again")
    assert again.filter("again <> cum").count() == 0


def test_top_is_one_row_a_group_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 5, 2), ("a", 5, 1), ("a", None, 0), ("b", None, 3)], "k string, v int, t int")
    assert rows(panel.top_n_by(df, ["k"], [F.col("v").desc_nulls_last(), F.col("t")])) == [("a", 5, 1), ("b", None, 3)]


def test_filters_and_null_logic(spark):
    df = spark.createDataFrame([(1, "x", None, d("2018-01-01")), (2, None, None, None), (3, "y", d("2017-01-01"), None)], "id int, c string, a date, b date")
    assert [r.id for r in filters.exclude(df, "c", ["x"]).orderBy("id").collect()] == [2, 3]
    assert [r.id for r in df.filter(S.any_date_on_or_after(["a", "b"], "2018-01-01")).collect()] == [1]
    assert [r.id for r in filters.known_by(df, "a", "2017-06-01").collect()] == [3]
    assert [r.id for r in filters.within_horizon(df, "b", F.lit(d("2017-12-01")), 90).collect()] == [1]


def test_views_do_not_look_ahead(spark):
    df = spark.createDataFrame([("a", d("2024-01-01"), d("2024-02-01"))], "code string, suspend_start_date date, resume_date date")
    view = filters.pit_view(df, "suspensions", "suspend_start_date", "2024-01-15")
    assert view.columns == ["code", "suspend_start_date"] and view.count() == 1


def test_scalars(spark):
    df = spark.createDataFrame([(d("2022-07-04"), "IM2610", "000001.XSHE", 1.0, 0), (d("2024-05-31"), "IM2613", "x", 1.0, 5)], "day date, c string, code string, pct double, n int")
    got = df.select(S.third_friday("day"), S.contract_month("c"), S.contract_product("c"), S.code_suffix("code"), S.annualize("pct", "n")).collect()
    assert got[0][0] == d("2022-07-15") and got[1][0] == d("2024-05-17")
    assert got[0][1] == d("2026-10-01") and got[1][1] is None and got[0][2] == "IM"
    assert got[0][3] == "XSHE" and got[1][3] == "" and got[0][4] is None and got[1][4] == pytest.approx(73.0)
    nothing = spark.range(1).select(S.ratio_or_null(F.lit(1.0), F.lit(0.0)), S.ex_price(F.lit(10.0), F.lit(None), F.lit(-10.0)), S.clip(F.lit(None).cast("double"), 0, 1)).first()
    assert tuple(nothing) == (None, None, None)


def test_combining_needs_every_member(spark):
    df = spark.createDataFrame([(1, "sh", 2.0), (1, "sz", 3.0), (2, "sh", 4.0)], "day int, ex string, v double")
    assert rows(combine.combine_members(df, ["day"], "ex", ["sh", "sz"], {"v": F.col("v")})) == [(1, 5.0, 2.0, 3.0)]
    assert len(rows(combine.combine_members(df, ["day"], "ex", ["sh", "sz"], {"v": F.col("v")}, require_all=False))) == 2


def test_completeness_counts_members_from_their_start(spark):
    seen = spark.createDataFrame([(d("2024-01-01"), "f", "a"), (d("2024-01-02"), "f", "a")], "day date, fam string, m string")
    dim = spark.createDataFrame([("f", "a", d("2020-01-01")), ("f", "b", d("2024-01-02"))], "fam string, m string, since date")
    got = combine.completeness(seen, dim, "fam", ["day"], "m", "since").orderBy("day").select("n", "n_expected", "complete").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (1, 2, 0)]


def test_precedence_and_reconciliation(spark):
    a, b = spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), spark.createDataFrame([(1, None), (2, "y"), (3, "z")], "k int, v string")
    assert rows(quality.reconcile(a, b, ["k"], ["v"])) == [(1, "equal"), (2, "different"), (3, "only_b")]
    assert rows(combine.union_precedence(a, b, ["k"], [F.col("v")])) == [(1, None), (2, "x"), (3, "z")]


def test_quality_checks(spark):
    df = spark.createDataFrame([(d("2024-01-02"), d("2024-01-01"), 1.0, 10.0), (None, d("2024-01-01"), None, 1.0)], "a date, b date, x double, y double")
    valid, bad = quality.check_order(df, "a", "b")
    assert valid.count() == 1 and bad.count() == 1
    assert tuple(quality.check_identity(df, F.col("x") * 10, F.col("y"), 1e-9).first()) == (1, 0)
    assert quality.check_schema(df, T.StructType([T.StructField("a", T.DateType()), T.StructField("z", T.LongType()), T.StructField("x", T.LongType())])) == ["missing z", "unexpected b", "unexpected y", "x: double for bigint"]
    empty = quality.confusion(df.filter("false").select("a"), df.filter("false").select("a"), ["a"]).first()
    assert tuple(empty) == (0, 0, 0, None, None)


def test_open_ends_are_capped(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("a", d("2024-01-01"))], "k string, e date")
    caps = spark.createDataFrame([("a", d("2024-06-30"))], "k string, delisted date")
    assert rows(intervals.cap_open_ends(df, caps, ["k"], "e", "delisted")) == [("a", d("2024-01-01")), ("a", d("2024-06-30")), ("b", None)]


@pytest.mark.parametrize("n", [1, 2, 7, 3000])
def test_percentiles_are_exact(spark, n):
    rng = random.Random(n)
    values = {"a": [rng.gauss(0, 100) for _ in range(n)], "b": [float(rng.randrange(4)) for _ in range(n)], None: [1.0] * n}
    df = spark.createDataFrame([(k, x) for k, own in values.items() for x in own] + [("a", None), ("c", None)], "k string, x double").repartition(3)
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {r[0]: r[1:] for r in rows(panel.exact_percentiles(df, ["k"], "x", shares))}
    assert set(got) == set(values)
    for k, own in values.items():
        assert got[k] == pytest.approx(tuple(float(numpy.quantile(own, s)) for s in shares))
    clipped = panel.winsorize(df, ["k"], "x", 0.01, "y")
    assert clipped.count() == 3 * n + 2 and clipped.filter("x is null and y is not null or x is not null and y is null").count() == 0
    low = float(numpy.quantile(values["a"], 0.01))
    assert clipped.filter("k = 'a'").agg(F.min("y")).first()[0] == pytest.approx(low)


def test_rank_bounds_hold_in_a_large_group(spark):
    df = spark.range(300_000).select(F.lit("a").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("x"))
    exact = df.groupBy("k").agg(F.percentile("x", 0.01), F.percentile("x", 0.37), F.percentile("x", 0.99)).first()
    assert tuple(panel.exact_percentiles(df, ["k"], "x", [0.01, 0.37, 0.99]).first()) == pytest.approx(tuple(exact))


def test_states_equal_intervals_that_do_not_overlap(spark):
    starts = spark.range(80).select((F.col("id") % 5).alias("k"), F.date_add(F.lit(d("2024-01-01")), (F.col("id") * 11 % 200).cast("int")).alias("s"), F.col("id").alias("v"))
    spans = intervals.events_to_intervals(starts, ["k"], "s", ["v"], "e").withColumn("e", F.when(F.col("v") % 4 == 0, F.date_add("s", 3)).otherwise(F.col("e")))
    points = spark.range(300).select("id", (F.col("id") % 6).alias("k"), F.date_add(F.lit(d("2023-12-20")), (F.col("id") * 7 % 230).cast("int")).alias("day"))
    points = points.unionByName(spark.createDataFrame([(900, None, d("2024-02-01")), (901, 1, None)], "id long, k long, day date"))
    want = rows(intervals.in_interval(points, spans, ["k"], "day", "s", "e").select("id", "v"))
    for split in (None, "month"):
        assert rows(intervals.in_state(points, spans, ["k"], "day", "s", "e", ["v"], split).select("id", "v")) == want


def test_indicators_are_not_seen_before_they_are_out(spark):
    statement = [("a", 2023, q, d(f"2023-{3 * q + 1:02d}-20"), 1, 0, 100.0 * q, 60.0 * q, 8.0 * q) for q in (1, 2, 3)]
    income = spark.createDataFrame(statement, "k string, y int, q int, pub_date date, source_id int, report_type int, revenue double, cost double, profit double")
    balance = spark.createDataFrame([(*r[:6], 50.0, 20.0, e) for r, e in zip(statement, (40.0, -1.0, 0.0), strict=True)], "k string, y int, q int, pub_date date, source_id int, report_type int, assets double, liability double, equity double")
    indicator = spark.createDataFrame([("a", 2023, 1, 5, d("2023-05-30")), ("a", 2023, 2, 6, d("2023-07-20"))], "k string, y int, q int, eps int, ind_pub_date date")
    table = composites.build_financials_pit(income, balance, indicator, "k", "y", "q")
    assert [r.roe for r in table.orderBy("q").collect()] == [0.2, None, None]
    seen = lambda day: rows(composites.financials_as_of(table, day).select("q", "eps"))
    assert seen("2023-05-01") == [(1, None)] and seen("2023-05-30") == [(1, 5)] and seen("2023-12-31") == [(1, 5), (2, 6), (3, None)]


def test_members_of_a_family_are_counted_without_a_distinct(spark):
    from types import SimpleNamespace

    lines = spark.createDataFrame([(1, datetime(2024, 1, 1), 2.0, 10.0), (1, datetime(2024, 1, 2), 3.0, 20.0), (2, datetime(2024, 1, 2), 5.0, 1.0)], "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double, l_extendedprice double")
    suppliers = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (1, 8)], "s_suppkey long, s_nationkey int")
    plan = composites.family_share_daily(SimpleNamespace(lineitem=lines, supplier=suppliers))
    assert "distinct" not in plan._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["family"], r["date"].day, r["shares"], r["shares_chg"], r["size"], r["n"]) for r in plan.collect())
    assert got == [(7, 1, 4.0, None, 40.0, 1), (7, 2, 11.0, 2.0, 125.0, 2), (8, 1, 2.0, None, 20.0, 1), (8, 2, 3.0, 1.0, 60.0, 1)]
