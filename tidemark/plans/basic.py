"""Scans, projections, filters, plain joins, aggregations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import combine, filters, panel, quality
from tidemark.plans.base import Tables, query


def day(c: str):
    return F.col(c).cast("date")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def scan_projection(t: Tables) -> DataFrame:
    return t.orders.filter("o_totalprice > 300000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_equality(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A'")
def filter_conjunct(t: Tables) -> DataFrame:
    return filters.periodic_first(t.lineitem, "l_linenumber", 1, "l_returnflag", "A").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IS NULL OR p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13')")
def filter_not_in(t: Tables) -> DataFrame:
    return filters.exclude(t.part, "p_brand", ["Brand#11", "Brand#12", "Brand#13"]).select("p_partkey", "p_brand")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE coalesce(nullif(l_returnflag, 'R') IS NOT NULL AND l_shipdate >= DATE '1999-06-01', false) OR coalesce(o_orderdate >= DATE '1999-06-01', false)""")
def filter_any_date(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("shipped", F.when(F.col("l_returnflag") != "R", day("l_shipdate")))
    return rows.filter(S.any_date_on_or_after(["shipped", day("o_orderdate")], "1999-06-01")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderdate::DATE AS d FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-03-01' AND DATE '1997-03-01' + 90")
def filter_horizon(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", day("o_orderdate").alias("d"))
    return filters.within_horizon(rows, "d", F.to_date(F.lit("1997-03-01")), 90)


@query("SELECT o_orderkey, o_orderdate::DATE AS d FROM orders WHERE o_orderdate::DATE <= DATE '1998-12-31'")
def known_by_cutoff(t: Tables) -> DataFrame:
    return filters.known_by(t.orders.select("o_orderkey", day("o_orderdate").alias("d")), "d", "1998-12-31")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice / l_quantity AS unit_price, l_extendedprice / l_quantity / 10 AS per_tenth FROM lineitem WHERE l_quantity > 0")
def project_unit_convert(t: Tables) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return t.lineitem.filter("l_quantity > 0").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", unit.alias("unit_price"), (unit / 10).alias("per_tenth"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(nullif(l_tax, 0), 0) + coalesce(l_discount, 0) AS total FROM lineitem")
def project_null_safe_sum(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", S.null_safe_sum(F.nullif("l_tax", F.lit(0.0)), "l_discount").alias("total"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1000 / c_acctbal END AS ratio FROM customer")
def ratio_guarded(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.ratio_or_null(F.lit(1000.0), "c_acctbal").alias("ratio"))


@query("""WITH b AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders GROUP BY 1)
SELECT o_orderkey, round(least(greatest(o_totalprice, lo), hi), 4) AS clipped FROM orders JOIN b USING (o_orderpriority)""")
def winsorize_by_group(t: Tables) -> DataFrame:
    return panel.winsorize(t.orders, ["o_orderpriority"], "o_totalprice", 0.01, "clipped").select("o_orderkey", F.round("clipped", 4).alias("clipped"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, o_custkey, o_orderstatus FROM lineitem
JOIN orders ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus""")
def join_inner_composite(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_linestatus"), "o_custkey", "o_orderstatus")
    return t.lineitem.join(o, ["l_orderkey", "l_linestatus"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "o_custkey", "o_orderstatus")


@query("""SELECT c_custkey, c_name, coalesce(n, 0)::BIGINT AS n_urgent, (n IS NOT NULL)::INT AS has_urgent FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON c_custkey = o_custkey""")
def join_left_flag(t: Tables) -> DataFrame:
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.join(urgent, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_urgent"), F.col("n").isNotNull().cast("int").alias("has_urgent"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_broadcast_dim(t: Tables) -> DataFrame:
    # 25 nations, 5 regions: fixed dimensions, whatever the size of the facts
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT o_custkey, sum(o_totalprice::DECIMAL(28,2))::DOUBLE AS total FROM orders GROUP BY 1")
def agg_sum(t: Tables) -> DataFrame:
    return combine.aggregate(t.orders, ["o_custkey"], {"total": S.exact_sum("o_totalprice")})


@query("SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, (count(*) FILTER (WHERE o_totalprice > 250000))::BIGINT AS n_large FROM orders GROUP BY 1, 2")
def agg_count_by_category(t: Tables) -> DataFrame:
    return combine.aggregate(t.orders, ["o_orderstatus", "o_orderpriority"], {"n": F.count("*"), "n_large": F.count_if(F.col("o_totalprice") > 250000)})


@query("SELECT l_returnflag, count(DISTINCT l_suppkey)::BIGINT AS n_suppliers, count(DISTINCT l_partkey)::BIGINT AS n_parts FROM lineitem GROUP BY 1")
def agg_count_distinct(t: Tables) -> DataFrame:
    return combine.aggregate(t.lineitem, ["l_returnflag"], {"n_suppliers": F.count_distinct("l_suppkey"), "n_parts": F.count_distinct("l_partkey")})


@query("SELECT c_nationkey, round(avg(CASE WHEN c_acctbal < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 12) AS share_negative FROM customer GROUP BY 1")
def agg_share(t: Tables) -> DataFrame:
    return combine.aggregate(t.customer, ["c_nationkey"], {"share_negative": F.round(F.avg(F.when(F.col("c_acctbal") < 0, 1.0).otherwise(0.0)), 12)})


@query("""SELECT 'o_orderdate' AS column_name, min(o_orderdate)::DATE AS min_day, max(o_orderdate)::DATE AS max_day, (count(*) FILTER (WHERE o_orderdate IS NULL))::BIGINT AS missing,
(count(*) FILTER (WHERE o_orderdate::DATE <= DATE '1998-12-31'))::BIGINT AS through_cutoff, count(DISTINCT o_custkey)::BIGINT AS distinct_keys, count(*)::BIGINT AS n_rows FROM orders
UNION ALL SELECT 'shipped', min(s)::DATE, max(s)::DATE, (count(*) FILTER (WHERE s IS NULL))::BIGINT, (count(*) FILTER (WHERE s::DATE <= DATE '1998-12-31'))::BIGINT, count(DISTINCT o_custkey)::BIGINT, count(*)::BIGINT
FROM (SELECT *, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 7 DAY END AS s FROM orders)""")
def profile_dates(t: Tables) -> DataFrame:
    shipped = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 7 DAY"))
    return quality.profile(t.orders.withColumn("shipped", shipped), ["o_orderdate", "shipped"], "o_custkey", "1998-12-31")


@query("""SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month,
(date_trunc('month', o_orderdate)::DATE + ((5 - isodow(date_trunc('month', o_orderdate)) + 7) % 7)::INT + 14)::DATE AS friday FROM orders""")
def third_friday(t: Tables) -> DataFrame:
    return t.orders.select(F.trunc("o_orderdate", "MM").alias("month")).distinct().select("month", S.third_friday("month").alias("friday"))


@query("SELECT p_partkey, split_part(p_brand, '#', 1) AS prefix, split_part(p_brand, '#', 2) AS suffix FROM part")
def code_split(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.code_prefix("p_brand", "#").alias("prefix"), S.code_suffix("p_brand", "#").alias("suffix"))


@query("""SELECT DISTINCT o_orderdate::DATE AS d, year(o_orderdate)::VARCHAR || 'q' || quarter(o_orderdate)::VARCHAR AS label,
(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS quarter_end FROM orders""")
def fiscal_quarters(t: Tables) -> DataFrame:
    d = t.orders.select(day("o_orderdate").alias("d")).distinct()
    return d.select("d", S.quarter_label("d").alias("label"), S.quarter_end(F.year("d"), F.quarter("d")).alias("quarter_end"))


@query("""SELECT p_partkey, 'IM' || (20 + p_partkey % 9)::VARCHAR || lpad((p_size % 14)::VARCHAR, 2, '0') AS contract, 'IM' AS product,
CASE WHEN p_size % 14 BETWEEN 1 AND 12 THEN make_date(2020 + (p_partkey % 9)::INT, (p_size % 14)::INT, 1) END AS delivery FROM part""")
def contract_parse(t: Tables) -> DataFrame:
    code = F.concat(F.lit("IM"), (20 + F.col("p_partkey") % 9).cast("string"), F.lpad((F.col("p_size") % 14).cast("string"), 2, "0"))
    return t.part.select("p_partkey", code.alias("contract")).withColumn("product", S.contract_product("contract")).withColumn("delivery", S.contract_month("contract"))


@query("SELECT c_custkey, sha256(c_name) AS digest FROM customer")
def hash_sha256(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.sha2("c_name", 256).alias("digest"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(l_shipdate, o_orderdate)::DATE AS available, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INT AS lag_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def availability_date(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", S.available_on("l_shipdate", "o_orderdate").cast("date").alias("available"), S.days_between(day("l_shipdate"), day("o_orderdate")).alias("lag_days"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
round((l_extendedprice - l_discount * 10) / (1 + l_quantity / 10), 6) AS ex_price FROM lineitem""")
def ex_price_projection(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(S.ex_price("l_extendedprice", F.col("l_discount") * 10, "l_quantity"), 6).alias("ex_price"))


@query("SELECT c_custkey, try_cast('1998-' || lpad((c_custkey % 14)::VARCHAR, 2, '0') || '-30' AS DATE) AS d FROM customer")
def string_to_date(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.expr("try_cast('1998-' || lpad(cast(c_custkey % 14 AS string), 2, '0') || '-30' AS DATE)").alias("d"))
