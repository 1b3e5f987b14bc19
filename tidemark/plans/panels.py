"""Panels and periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import panel, periods, quality
from tidemark.plans.base import Tables, query
from tidemark.plans.basic import day


@query("""SELECT o_custkey, y, q, o_orderkey FROM (SELECT *, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q FROM orders)
QUALIFY row_number() OVER (PARTITION BY o_custkey, y, q ORDER BY o_orderdate, o_orderkey) = 1""")
def pit_first_disclosure(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("y", F.year("o_orderdate")).withColumn("q", F.quarter("o_orderdate"))
    return panel.first_disclosure(rows, ["o_custkey", "y", "q"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "y", "q", "o_orderkey")


ALL = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
MONTHS = "SELECT *, date_trunc('month', l_shipdate)::DATE AS m FROM lineitem"


def months(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("m", F.trunc("l_shipdate", "MM"))


def ties() -> list:
    return [F.col(c.strip()) for c in ALL.split(",")]


@query(f"""SELECT l_suppkey, m, l_orderkey, l_linenumber, l_partkey, l_quantity FROM ({MONTHS}) QUALIFY row_number() OVER (PARTITION BY l_suppkey, m ORDER BY l_quantity DESC, {ALL}) = 1""")
def top_by_group(t: Tables) -> DataFrame:
    return panel.top_n_by(months(t), ["l_suppkey", "m"], [F.col("l_quantity").desc(), *ties()]).select("l_suppkey", "m", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(f"""WITH f AS (SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey, m ORDER BY l_quantity DESC, {ALL}) = 1)::INT AS a,
(row_number() OVER (PARTITION BY l_suppkey, m ORDER BY l_extendedprice DESC, {ALL}) = 1)::INT AS b FROM ({MONTHS}))
SELECT l_suppkey, count(*)::BIGINT AS n, (count(*) FILTER (WHERE a = b))::BIGINT AS n_equal FROM f WHERE a = 1 GROUP BY 1""")
def pairwise_agreement(t: Tables) -> DataFrame:
    rows = panel.flag_top(months(t), ["l_suppkey", "m"], [F.col("l_quantity").desc(), *ties()], "a")
    rows = panel.flag_top(rows, ["l_suppkey", "m"], [F.col("l_extendedprice").desc(), *ties()], "b").filter("a = 1")
    return quality.agreement(rows, ["l_suppkey"], "a", "b")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate)::INT AS expiry_rank FROM lineitem")
def rank_within_group(t: Tables) -> DataFrame:
    return panel.rank_within(t.lineitem, ["l_orderkey"], [F.col("l_shipdate")], "expiry_rank", "dense_rank").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "expiry_rank")


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 9) AS value_chg FROM events")
def lag_diff(t: Tables) -> DataFrame:
    return panel.diff_prev(t.events, ["user_id"], ["ts", "event_id"], "value", "value_chg").select("event_id", F.round("value_chg", 9).alias("value_chg"))


QUARTERS = """SELECT c_nationkey AS code, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, sum(o_totalprice::DECIMAL(28,2) - 250000)::DOUBLE AS v, max(o_orderdate)::DATE AS pub
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
CUMULATIVE = f"SELECT *, round(sum(v) OVER (PARTITION BY code, y ORDER BY q ROWS UNBOUNDED PRECEDING), 2) AS cum FROM ({QUARTERS})"


def quarters(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    amount = F.sum(F.col("o_totalprice").cast("decimal(28,2)") - 250000).cast("double")
    return rows.groupBy(F.col("c_nationkey").alias("code"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(amount.alias("v"), F.max(day("o_orderdate")).alias("pub"))


def cumulative(t: Tables) -> DataFrame:
    return periods.ytd(quarters(t), ["code"], "y", "q", "v", "cum").withColumn("cum", F.round("cum", 2))


@query(f"SELECT code, y, q, cum FROM ({CUMULATIVE})")
def ytd_cumulative(t: Tables) -> DataFrame:
    return cumulative(t).select("code", "y", "q", "cum")


@query(f"""SELECT code, y, q, round(CASE WHEN q = 1 THEN cum WHEN lag(q) OVER w = q - 1 THEN cum - lag(cum) OVER w END, 2) AS own FROM ({CUMULATIVE}) WINDOW w AS (PARTITION BY code, y ORDER BY q)""")
def ytd_to_quarter(t: Tables) -> DataFrame:
    return periods.ytd_to_quarter(cumulative(t), ["code"], "y", "q", "cum", "own").select("code", "y", "q", F.round("own", 2).alias("own"))


@query(f"""WITH c AS ({CUMULATIVE})
SELECT c.code, c.y, c.q, round(CASE WHEN c.q = 4 THEN c.cum ELSE c.cum + a.cum - b.cum END, 2) AS ttm,
CASE WHEN c.q = 4 THEN c.pub WHEN a.cum IS NOT NULL AND b.cum IS NOT NULL THEN greatest(c.pub, a.pub, b.pub) END AS ttm_available
FROM c LEFT JOIN c a ON a.code = c.code AND a.y = c.y - 1 AND a.q = 4 LEFT JOIN c b ON b.code = c.code AND b.y = c.y - 1 AND b.q = c.q""")
def ttm(t: Tables) -> DataFrame:
    return periods.ttm(cumulative(t), ["code"], "y", "q", "cum", "pub").select("code", "y", "q", F.round("ttm", 2).alias("ttm"), "ttm_available")


@query(f"""WITH c AS ({CUMULATIVE}) SELECT c.code, c.y, c.q, round(CASE WHEN b.cum > 0 THEN c.cum / b.cum - 1 END, 9) AS yoy, CASE WHEN b.cum > 0 THEN greatest(c.pub, b.pub) END AS yoy_available
FROM c LEFT JOIN c b ON b.code = c.code AND b.y = c.y - 1 AND b.q = c.q""")
def yoy(t: Tables) -> DataFrame:
    return periods.yoy(cumulative(t), ["code"], "y", "q", "cum", "pub").select("code", "y", "q", F.round("yoy", 9).alias("yoy"), "yoy_available")


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return quality.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""SELECT (l_shipdate >= o_orderdate) AS valid, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def check_date_order(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    valid, quarantine = quality.check_order(rows, "o_orderdate", "l_shipdate")
    return valid.select(F.lit(True).alias("valid")).unionByName(quarantine.select(F.lit(False).alias("valid"))).groupBy("valid").agg(F.count("*").alias("n"))


@query("""SELECT (count(*) FILTER (WHERE l_tax > 0))::BIGINT AS n_compared, (count(*) FILTER (WHERE l_tax > 0 AND abs(round(l_extendedprice / 10, 2) * 10 - l_extendedprice) > 0.0201))::BIGINT AS n_mismatch FROM lineitem""")
def check_unit_identity(t: Tables) -> DataFrame:
    per_unit = F.when(F.col("l_tax") > 0, F.round(F.col("l_extendedprice") / 10, 2))
    return quality.check_identity(t.lineitem, per_unit * 10, F.col("l_extendedprice"), 0.0201)


@query("""SELECT p_partkey, coalesce(abs(p_retailprice - (900 + (p_partkey % 1000) / 10.0::DOUBLE + p_size)) <= 60, false) AS matches FROM part""")
def tolerance_match(t: Tables) -> DataFrame:
    derived = t.part.select("p_partkey", (900 + (F.col("p_partkey") % 1000) / F.lit(10.0) + F.col("p_size")).alias("derived"))
    return quality.tolerance_match(t.part.select("p_partkey", "p_retailprice"), derived, ["p_partkey"], "p_retailprice", "derived", 60.0).select("p_partkey", "matches")


@query("SELECT c_custkey, CASE WHEN c_acctbal IS NOT NULL THEN least(greatest(c_acctbal, 0), 5000) END AS clipped, c_acctbal / 2 - 1 AS debt FROM customer")
def clip_values(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.clip("c_acctbal", 0.0, 5000.0).alias("clipped"), (S.debt_ratio("c_acctbal", F.lit(2.0)) - 1).alias("debt"))
