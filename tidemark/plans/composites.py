"""Published tables as compositions of the operators, on frames of their shape made from the fixtures."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import combine, filters, intervals, panel, periods
from tidemark.plans.base import Tables, query
from tidemark.plans.basic import day
from tidemark.sources.scratch import written


#: The source of a first disclosure that counts.
PERIODIC = "periodic"


def build_financials_pit(income: DataFrame, balance: DataFrame, indicator: DataFrame, key: str, year: str, quarter: str, cashflow: DataFrame | None = None) -> DataFrame:
    """First disclosures of the statements in periodic reports, aligned by period, with indicators, ratios, growth and trailing values.

    income: (key, year, quarter, pub_date, source_id, source, report_type, revenue, cost, profit), balance: (..., assets,
    liability, equity), cashflow: (..., ocf), all cumulative; indicator: (key, year, quarter, eps, ind_pub_date), of the
    quarter alone. A prospectus that has the period earlier does not count; statements without a column `source` are all
    periodic. Without cashflow there is no ocf_ttm. pub_date of a row is the latest of its statements. Indicators are published on a day of their own, ind_pub_date, and trailing values and growth are known from
    theirs: see financials_as_of.
    """
    keys = [key, year, quarter]

    def first(df: DataFrame) -> DataFrame:
        named = df if "source" in df.columns else df.withColumn("source", F.lit(PERIODIC))
        rows = filters.periodic_first(named, "report_type", 0, "source", PERIODIC)
        return panel.first_disclosure(rows, keys, ["pub_date", "source_id"]).drop("report_type", "source_id", "source")

    rows = first(income)
    for other in (balance, cashflow):
        if other is not None:
            rows = rows.join(first(other).withColumnRenamed("pub_date", "other_pub"), keys).withColumn("pub_date", F.greatest("pub_date", "other_pub")).drop("other_pub")
    rows = rows.join(indicator, keys, "left")
    rows = rows.withColumns({"gross_margin": S.gross_margin("revenue", "cost"), "roe": S.roe("profit", "equity"), "debt_ratio": S.debt_ratio("liability", "assets")})
    # a row a key and period, read three times by the joins to prior periods
    rows = written(rows, "periods")
    trailing = {f"{c}_ttm": c for c in ("profit", "revenue", "ocf") if c in rows.columns}
    return periods.against_prior(rows, [key], year, quarter, trailing, {"profit_yoy": "profit", "revenue_yoy": "revenue"}, "pub_date")


LATER = ("profit_ttm", "revenue_ttm", "ocf_ttm", "profit_yoy", "revenue_yoy")


def financials_as_of(rows: DataFrame, cutoff: str) -> DataFrame:
    """The rows known by a day, in which values that came out later are null."""
    day_ = F.to_date(F.lit(cutoff))
    seen = {"eps": "ind_pub_date"} | {c: f"{c}_available" for c in LATER if c in rows.columns}
    return filters.known_by(rows, "pub_date", cutoff).withColumns({c: F.when(F.col(known) <= day_, F.col(c)) for c, known in seen.items()})


#: What a prospectus says comes forty days before the periodic report.
STATEMENTS = """SELECT s_nationkey AS code, year(l_shipdate)::INT AS y, quarter(l_shipdate)::INT AS q, l_linenumber % 3 AS report_type, CASE WHEN l_returnflag = 'R' THEN 'prospectus' ELSE 'periodic' END AS source,
(l_shipdate::DATE + 30 + (l_linenumber * 7)::INT - CASE WHEN l_returnflag = 'R' THEN 40 ELSE 0 END)::DATE AS pub_date,
min(l_orderkey) AS source_id, sum(l_extendedprice::DECIMAL(12,2)) AS revenue, sum(l_extendedprice::DECIMAL(12,2) * 0.75::DECIMAL(3,2)) AS cost, sum((l_tax::DECIMAL(4,2) - 0.04::DECIMAL(4,2)) * l_extendedprice::DECIMAL(12,2)) AS profit,
sum(l_quantity::DECIMAL(12,2)) AS assets, sum(l_quantity::DECIMAL(12,2) * l_discount::DECIMAL(4,2)) AS liability, sum(l_quantity::DECIMAL(12,2) * (0.05::DECIMAL(4,2) - l_discount::DECIMAL(4,2))) AS equity,
sum(l_quantity::DECIMAL(12,2) * l_tax::DECIMAL(4,2)) AS ocf FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""

_TTM = ", ".join(f"round(CASE WHEN f.q = 4 THEN f.{c} ELSE f.{c} + a.{c} - b.{c} END::DOUBLE, 4) AS {c}_ttm, CASE WHEN f.q = 4 THEN f.pub_date WHEN a.code IS NOT NULL AND b.code IS NOT NULL THEN greatest(f.pub_date, a.pub_date, b.pub_date) END AS {c}_ttm_available" for c in ("profit", "revenue", "ocf"))
_YOY = ", ".join(f"round(CASE WHEN b.{c} > 0 THEN f.{c}::DOUBLE / b.{c}::DOUBLE - 1 END, 9) AS {c}_yoy, CASE WHEN b.{c} > 0 THEN greatest(f.pub_date, b.pub_date) END AS {c}_yoy_available" for c in ("profit", "revenue"))

FINANCIALS = f"""WITH s AS ({STATEMENTS}),
f AS (SELECT * FROM s WHERE report_type = 0 AND source = 'periodic' QUALIFY row_number() OVER (PARTITION BY code, y, q ORDER BY pub_date, source_id) = 1),
e AS (SELECT c_nationkey AS code, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, count(*)::BIGINT AS eps, max(o_orderdate)::DATE + 60 AS ind_pub_date FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT f.code, f.y, f.q, f.pub_date, f.profit::DOUBLE AS profit, e.eps, e.ind_pub_date, round((f.revenue::DOUBLE - f.cost::DOUBLE) / nullif(f.revenue::DOUBLE, 0), 9) AS gross_margin,
round(CASE WHEN f.equity > 0 THEN f.profit::DOUBLE / f.equity::DOUBLE END, 9) AS roe, round(f.liability::DOUBLE / nullif(f.assets::DOUBLE, 0), 9) AS debt_ratio,
{_TTM}, {_YOY}
FROM f LEFT JOIN f a ON a.code = f.code AND a.y = f.y - 1 AND a.q = 4 LEFT JOIN f b ON b.code = f.code AND b.y = f.y - 1 AND b.q = f.q
LEFT JOIN e ON e.code = f.code AND e.y = f.y AND e.q = f.q"""


def financials(t: Tables) -> DataFrame:
    exact = lambda c, digits=12: F.col(c).cast(f"decimal({digits},2)")
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    prospectus = F.col("l_returnflag") == "R"
    pub = F.date_add(day("l_shipdate"), 30 + F.col("l_linenumber") * 7 - F.when(prospectus, 40).otherwise(0)).alias("pub_date")
    price, owed = exact("l_extendedprice"), exact("l_discount", 4)
    named = F.when(prospectus, "prospectus").otherwise(PERIODIC).alias("source")
    rows = rows.groupBy(F.col("s_nationkey").alias("code"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"), (F.col("l_linenumber") % 3).alias("report_type"), named, pub).agg(
        F.min("l_orderkey").alias("source_id"), F.sum(price).alias("revenue"), F.sum(price * F.lit(Decimal("0.75"))).alias("cost"), F.sum((exact("l_tax", 4) - F.lit(Decimal("0.04"))) * price).alias("profit"),
        F.sum(exact("l_quantity")).alias("assets"), F.sum(exact("l_quantity") * owed).alias("liability"), F.sum(exact("l_quantity") * (F.lit(Decimal("0.05")) - owed)).alias("equity"), F.sum(exact("l_quantity") * exact("l_tax", 4)).alias("ocf"),
    )
    figures = {"income": ("revenue", "cost", "profit"), "balance": ("assets", "liability", "equity"), "cashflow": ("ocf",)}
    rows = rows.withColumns({c: F.col(c).cast("double") for own in figures.values() for c in own})
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    eps = orders.groupBy(F.col("c_nationkey").alias("code"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.count("*").alias("eps"), F.date_add(F.max(day("o_orderdate")), 60).alias("ind_pub_date"))
    statement = lambda name: rows.select("code", "y", "q", "pub_date", "source_id", "source", "report_type", *figures[name])
    return build_financials_pit(statement("income"), statement("balance"), eps, "code", "y", "q", statement("cashflow"))


def financial_columns(df: DataFrame) -> DataFrame:
    rounded = {"gross_margin": 9, "roe": 9, "debt_ratio": 9, "profit_ttm": 4, "revenue_ttm": 4, "ocf_ttm": 4, "profit_yoy": 9, "revenue_yoy": 9}
    return df.select("code", "y", "q", "pub_date", "profit", "eps", "ind_pub_date", *(f"{c}_available" for c in LATER), *(F.round(c, n).alias(c) for c, n in rounded.items()))


@query(FINANCIALS)
def financials_pit(t: Tables) -> DataFrame:
    return financial_columns(financials(t))


_SEEN = ", ".join(f"CASE WHEN {c}_available <= DATE '1998-05-15' THEN {c} END AS {c}" for c in LATER)


@query(f"SELECT * REPLACE (CASE WHEN ind_pub_date <= DATE '1998-05-15' THEN eps END AS eps, {_SEEN}) FROM ({FINANCIALS}) WHERE pub_date <= DATE '1998-05-15'")
def financials_known_by(t: Tables) -> DataFrame:
    return financial_columns(financials_as_of(financials(t), "1998-05-15"))


def build_dividends(plans: DataFrame, dates: list[str], since: str) -> DataFrame:
    """Plans with any date from `since` on, with per-share cash and shares added; nulls count as no shares."""
    kept = plans.filter(S.any_date_on_or_after(dates, since))
    return kept.withColumn("cash_per_share", F.col("cash_per_10") / 10).withColumn("added_per_10", S.null_safe_sum("bonus_per_10", "transfer_per_10"))


@query("""WITH p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS cash_per_10, nullif(l_discount, 0) * 100 AS bonus_per_10, nullif(l_tax, 0) * 100 AS transfer_per_10,
CASE WHEN l_returnflag <> 'N' THEN l_shipdate::DATE END AS ex_date, CASE WHEN l_linestatus = 'O' THEN l_shipdate::DATE + 20 END AS board_date FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, cash_per_10 / 10 AS cash_per_share, round(coalesce(bonus_per_10, 0) + coalesce(transfer_per_10, 0), 6) AS added_per_10
FROM p WHERE coalesce(ex_date >= DATE '1998-01-01', false) OR coalesce(board_date >= DATE '1998-01-01', false)""")
def dividend_plan_projection(t: Tables) -> DataFrame:
    shipped = day("l_shipdate")
    percent = lambda c: F.nullif(c, F.lit(0.0)) * 100
    plans = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").alias("cash_per_10"), percent("l_discount").alias("bonus_per_10"), percent("l_tax").alias("transfer_per_10"),
        F.when(F.col("l_returnflag") != "N", shipped).alias("ex_date"), F.when(F.col("l_linestatus") == "O", F.date_add(shipped, 20)).alias("board_date"),
    )
    out = build_dividends(plans, ["ex_date", "board_date"], "1998-01-01")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cash_per_share", F.round("added_per_10", 6).alias("added_per_10"))


KNOWN_DAY = "1998-06-01"


@query(f"""WITH p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate::DATE - 60 AS board_pub_date, l_shipdate::DATE - 20 AS shareholder_pub_date, CASE WHEN l_returnflag <> 'N' THEN l_shipdate::DATE END AS implementation_pub_date,
l_shipdate::DATE + 10 AS ex_date, l_extendedprice AS cash_per_10 FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, board_pub_date, CASE WHEN shareholder_pub_date <= DATE '{KNOWN_DAY}' THEN shareholder_pub_date END AS shareholder_pub_date, CASE WHEN implementation_pub_date <= DATE '{KNOWN_DAY}' THEN implementation_pub_date END AS implementation_pub_date,
CASE WHEN implementation_pub_date <= DATE '{KNOWN_DAY}' THEN ex_date END AS ex_date, CASE WHEN implementation_pub_date <= DATE '{KNOWN_DAY}' THEN cash_per_10 END AS cash_per_10 FROM p WHERE board_pub_date <= DATE '{KNOWN_DAY}'""")
def dividends_known_by(t: Tables) -> DataFrame:
    """Plans that the board has announced; their amounts and dates are there once they are implemented."""
    shipped = day("l_shipdate")
    plans = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_sub(shipped, 60).alias("board_pub_date"), F.date_sub(shipped, 20).alias("shareholder_pub_date"),
        F.when(F.col("l_returnflag") != "N", shipped).alias("implementation_pub_date"), F.date_add(shipped, 10).alias("ex_date"), F.col("l_extendedprice").alias("cash_per_10"), F.lit("implemented").alias("status"),
    )
    return filters.pit_view(plans, "dividends", "board_pub_date", KNOWN_DAY)


def build_basis(contracts: DataFrame, daily: DataFrame, spot: DataFrame, dominant: DataFrame, products: DataFrame) -> DataFrame:
    """One row a (date, product, unexpired contract) with its basis, rank and flags.

    contracts: (contract, product, delivery, expire_date or null), daily: (contract, date, close, open_interest), spot:
    (index_code, date, index_close), dominant: (product, date, dominant_contract), products: (product, index_code).
    A missing expiry is estimated as the third Friday of the delivery month. products is a fixed map of few rows.
    """
    known = contracts.withColumn("expire_estimated", F.col("expire_date").isNull().cast("int")).withColumn("expire_date", F.coalesce("expire_date", S.third_friday("delivery")))
    rows = daily.join(known, "contract").filter(F.col("date") <= F.col("expire_date"))
    rows = rows.join(F.broadcast(products), "product").join(spot, ["index_code", "date"]).join(dominant, ["product", "date"], "left")
    rows = rows.withColumns({
        "days_to_expiry": S.days_between("expire_date", "date"),
        "basis_pts": S.basis_points("close", "index_close"),
        "basis_pct": S.basis_pct("close", "index_close"),
        "is_dominant": F.coalesce((F.col("contract") == F.col("dominant_contract")).cast("int"), F.lit(0)),
    })
    rows = rows.withColumn("basis_annualized_pct", S.annualize("basis_pct", "days_to_expiry"))
    rows = panel.rank_within(rows, ["date", "product"], [F.col("expire_date"), F.col("contract")], "expiry_rank")
    return panel.flag_top(rows, ["date", "product"], [F.col("open_interest").desc_nulls_last(), F.col("contract")], "is_oi_top")


BASIS = """WITH con AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'IF' ELSE 'IC' END AS product, product || p_partkey::VARCHAR AS contract, p_partkey, DATE '1995-01-01' + (p_partkey * 37 % 2500)::INT AS delivery,
  CASE WHEN p_partkey % 3 = 0 THEN DATE '1995-01-01' + (p_partkey * 41 % 2500)::INT END AS given FROM part),
k AS (SELECT *, coalesce(given, (date_trunc('month', delivery)::DATE + ((5 - isodow(date_trunc('month', delivery)) + 7) % 7)::INT + 14)::DATE) AS expire_date, (given IS NULL)::INT AS expire_estimated FROM con),
t AS (SELECT contract, product, l_shipdate::DATE AS date, max(l_extendedprice) AS close, sum(l_quantity::DECIMAL(28,2)) AS oi FROM lineitem JOIN con ON l_partkey = p_partkey GROUP BY ALL),
i AS (SELECT product, date, max(close) AS ix, arg_max(contract, (oi, contract)) AS dominant FROM t GROUP BY ALL),
d AS (SELECT t.*, ix, dominant, expire_date, expire_estimated, date_diff('day', date, expire_date)::INT AS days_to_expiry FROM t JOIN (SELECT contract, expire_date, expire_estimated FROM k) USING (contract) JOIN i USING (product, date) WHERE date <= expire_date)
SELECT date, product, contract, expire_date, expire_estimated, days_to_expiry, round(close - ix, 6) AS basis_pts, round((close / ix - 1) * 100, 9) AS basis_pct,
round(CASE WHEN days_to_expiry > 0 THEN (close / ix - 1) * 100 * 365 / days_to_expiry END, 9) AS basis_annualized_pct,
row_number() OVER (PARTITION BY date, product ORDER BY expire_date, contract)::INT AS expiry_rank,
(row_number() OVER (PARTITION BY date, product ORDER BY oi DESC, contract) = 1)::INT AS is_oi_top, (day(date) % 2 = 0 AND contract = dominant)::INT AS is_dominant FROM d"""


def basis(t: Tables) -> DataFrame:
    """Parts stand in for contracts of two products; their trading days, prices and open interest are those of their lines.

    The index of a product is its highest price of the day, and the vendor names a dominant contract on even days.
    """
    products = t.spark.createDataFrame([("IC", "A"), ("IF", "B")], "product string, index_code string")
    product = F.when(F.col("p_partkey") % 2 == 0, "IF").otherwise("IC")
    from_day = lambda n: F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("p_partkey") * n % 2500).cast("int"))
    parts = t.part.select("p_partkey", product.alias("product"), F.concat(product, F.col("p_partkey").cast("string")).alias("contract"))
    contracts = parts.select("contract", "product", from_day(37).alias("delivery"), F.when(F.col("p_partkey") % 3 == 0, from_day(41)).alias("expire_date"))
    traded = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("contract", "product", day("l_shipdate").alias("date")).agg(F.max("l_extendedprice").alias("close"), F.sum(F.col("l_quantity").cast("decimal(28,2)")).alias("open_interest"))
    spots = traded.groupBy("product", "date").agg(F.max("close").alias("index_close"), F.max_by("contract", F.struct("open_interest", "contract")).alias("dominant_contract"))
    # two products, whatever the size of the data
    indexes = spots.join(F.broadcast(products), "product").select("index_code", "date", "index_close")
    dominant = spots.filter(F.dayofmonth("date") % 2 == 0).select("product", "date", "dominant_contract")
    return build_basis(contracts, traded.drop("product"), indexes, dominant, products)


def basis_columns(df: DataFrame) -> DataFrame:
    return df.select("date", "product", "contract", "expire_date", "expire_estimated", "days_to_expiry", F.round("basis_pts", 6).alias("basis_pts"), F.round("basis_pct", 9).alias("basis_pct"), F.round("basis_annualized_pct", 9).alias("basis_annualized_pct"), "expiry_rank", "is_oi_top", "is_dominant")


@query(BASIS)
def basis_by_contract(t: Tables) -> DataFrame:
    return basis_columns(basis(t))


@query(f"SELECT * FROM ({BASIS}) WHERE is_oi_top = 1 AND days_to_expiry > 5")
def basis_oi_top(t: Tables) -> DataFrame:
    return basis_columns(basis(t)).filter("is_oi_top = 1 AND days_to_expiry > 5")


@query(f"SELECT * FROM ({BASIS}) WHERE is_dominant = 1")
def basis_dominant(t: Tables) -> DataFrame:
    return basis_columns(basis(t)).filter("is_dominant = 1")


@query("""WITH s AS (SELECT user_id, date_trunc('week', ts)::DATE AS period, event_type, ts, event_id FROM events),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, period ORDER BY ts DESC, event_id DESC) = 1),
a AS (SELECT *, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY period), true)::INT AS ch FROM l),
b AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY period ROWS UNBOUNDED PRECEDING) AS g FROM a),
c AS (SELECT user_id, g, any_value(event_type) AS event_type, min(period) AS effective_from, max(period) AS last_observed, count(*)::BIGINT AS n FROM b GROUP BY user_id, g)
SELECT user_id, event_type, effective_from, last_observed, n, lead(effective_from) OVER (PARTITION BY user_id ORDER BY g) AS effective_to_exclusive FROM c""")
def industry_intervals(t: Tables) -> DataFrame:
    sampled = panel.period_end_sample(t.events, ["user_id"], "ts", "week", None, [F.col("event_id").desc()])
    return intervals.fold_runs(sampled.select("user_id", "period", "event_type"), ["user_id"], ["period"], "event_type")


@query("""WITH x AS (SELECT user_id, event_id, ts, event_type AS state FROM events WHERE event_type NOT IN ('view', 'click'))
SELECT user_id, event_id, state, epoch_us(ts)::BIGINT AS start_us, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS end_us FROM x""")
def status_intervals(t: Tables) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = filters.exclude(t.events, "event_type", ["view", "click"]).select("user_id", "event_id", "ts", F.col("event_type").alias("state"))
    rows = intervals.events_to_intervals(rows, ["user_id"], "ts", ["event_id"], "end_ts")
    return rows.select("user_id", "event_id", "state", us("ts").alias("start_us"), us("end_ts").alias("end_us"))


@query("""WITH d AS (SELECT l_suppkey AS etf, l_shipdate::DATE AS date, sum(l_quantity::DECIMAL(28,2))::DOUBLE AS shares, max(l_extendedprice) AS close FROM lineitem GROUP BY ALL),
x AS (SELECT *, shares - lag(shares) OVER (PARTITION BY etf ORDER BY date) AS shares_chg, shares * close AS size FROM d)
SELECT s_nationkey AS family, date, round(sum(shares), 4) AS shares, round(sum(shares_chg), 4) AS shares_chg, round(sum(size), 2) AS size, count(DISTINCT etf)::BIGINT AS n FROM x JOIN supplier ON etf = s_suppkey GROUP BY ALL""")
def family_share_daily(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("etf"), day("l_shipdate").alias("date")).agg(S.exact_sum("l_quantity").alias("shares"), F.max("l_extendedprice").alias("close"))
    rows = panel.diff_prev(rows, ["etf"], ["date"], "shares", "shares_chg").withColumn("size", F.col("shares") * F.col("close"))
    # a member is one row a family here, with the number of its rows, so that members of a day are counted without a distinct
    members = t.supplier.groupBy(F.col("s_suppkey").alias("etf"), F.col("s_nationkey").alias("family")).agg(F.count("*").alias("times"))
    rows = rows.join(members, "etf")
    summed = {c: F.round(F.sum(F.col(c) * F.col("times")), scale) for c, scale in (("shares", 4), ("shares_chg", 4), ("size", 2))}
    return combine.aggregate(rows, ["family", "date"], {**summed, "n": F.count("etf")})
