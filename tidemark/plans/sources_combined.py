"""Completeness, precedence, reconciliation and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import combine, quality
from tidemark.plans.base import Tables, query
from tidemark.plans.basic import day

HOURS = "SELECT date_trunc('hour', ts) AS h, event_type, value::DECIMAL(28,4) AS v FROM events WHERE event_type IN ('click', 'view')"


def hours(t: Tables, require_all: bool) -> DataFrame:
    rows = t.events.select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"), "event_type", F.col("value").cast("decimal(28,4)").alias("v"))
    rows = combine.combine_members(rows, ["h"], "event_type", ["click", "view"], {"total": F.col("v")}, require_all)
    return rows.select(F.unix_micros("h").alias("hour_us"), *(F.col(c).cast("double").alias(c) for c in ("total", "total_click", "total_view")))


PIVOT = f"SELECT epoch_us(h)::BIGINT AS hour_us, sum(v)::DOUBLE AS total, (sum(v) FILTER (WHERE event_type = 'click'))::DOUBLE AS total_click, (sum(v) FILTER (WHERE event_type = 'view'))::DOUBLE AS total_view FROM ({HOURS}) GROUP BY h"


@query(PIVOT + " HAVING count(DISTINCT event_type) = 2")
def combine_two_sources(t: Tables) -> DataFrame:
    return hours(t, True)


@query(PIVOT)
def pivot_two_members(t: Tables) -> DataFrame:
    return hours(t, False)


FAMILIES = """WITH s AS (SELECT DISTINCT n_regionkey AS region, date_trunc('month', o_orderdate)::DATE AS m, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT region, m, count(*)::BIGINT AS n FROM s GROUP BY 1, 2), e AS (SELECT n_regionkey AS region, count(*)::BIGINT AS n_expected FROM nation GROUP BY 1)
SELECT region, m, n, n_expected, (n = n_expected)::INT AS complete FROM a JOIN e USING (region)"""


def families(t: Tables) -> DataFrame:
    dim = t.nation.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("member"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.trunc("o_orderdate", "MM").alias("m"), F.col("c_nationkey").alias("member"))
    return combine.completeness(rows.join(dim, "member"), dim, "region", ["m"], "member")


@query(FAMILIES)
def family_completeness(t: Tables) -> DataFrame:
    return families(t)


@query(f"SELECT region, m, n FROM ({FAMILIES}) WHERE complete = 1")
def family_complete_only(t: Tables) -> DataFrame:
    return combine.complete_only(families(t)).select("region", "m", "n")


@query("""WITH x AS (SELECT date_trunc('month', l_shipdate)::DATE AS m, sum(l_extendedprice::DECIMAL(28,2)) AS w, sum(l_extendedprice::DECIMAL(28,2)) FILTER (WHERE l_returnflag = 'A') AS p FROM lineitem GROUP BY 1)
SELECT m, w::DOUBLE AS whole, p::DOUBLE AS part, round(p::DOUBLE / w::DOUBLE, 12) AS coverage FROM x""")
def coverage_ratio(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("m", F.trunc("l_shipdate", "MM"))
    total = lambda df: df.groupBy("m").agg(S.exact_sum("l_extendedprice").alias("amount"))
    return combine.coverage(total(rows.filter("l_returnflag = 'A'")), total(rows), ["m"], "amount").withColumn("coverage", F.round("coverage", 12))


A = "SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderdate < DATE '1999-01-01'"
B = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderdate >= DATE '1997-01-01'"


def slices(t: Tables) -> tuple[DataFrame, DataFrame]:
    a = t.orders.filter(day("o_orderdate") < F.lit("1999-01-01").cast("date")).select("o_orderkey", F.col("o_orderstatus").alias("s"))
    changed = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    return a, t.orders.filter(day("o_orderdate") >= F.lit("1997-01-01").cast("date")).select("o_orderkey", changed.alias("s"))


@query(f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'only_a' WHEN a.o_orderkey IS NULL THEN 'only_b' WHEN a.s IS NOT DISTINCT FROM b.s THEN 'equal' ELSE 'different' END AS state
FROM ({A}) a FULL JOIN ({B}) b ON a.o_orderkey = b.o_orderkey""")
def reconcile_full_outer(t: Tables) -> DataFrame:
    return quality.reconcile(*slices(t), ["o_orderkey"], ["s"])


@query(f"SELECT * FROM ({A}) UNION ALL SELECT * FROM ({B}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({A}))")
def union_precedence(t: Tables) -> DataFrame:
    return combine.union_precedence(*slices(t), ["o_orderkey"], [F.col("s")])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_missing(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_except(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("k")).subtract(t.lineitem.select("l_orderkey"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersect(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'F'").select("o_custkey").intersect(t.orders.filter("o_orderstatus = 'O'").select("o_custkey"))
