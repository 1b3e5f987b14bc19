"""Files: year-split tables, gzip CSV, twins in two formats, yearly sinks, manifests, schemas, published columns.

Each query writes to the shared folder and reads back what it has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import filters, quality
from tidemark.plans.base import Tables, query
from tidemark.plans.basic import day
from tidemark.plans.history import RUNS, error_runs
from tidemark.sources import tables
from tidemark.sources.scratch import shared_path


def orders_by_year(t: Tables) -> str:
    """A folder with orders_<year>.parquet, by key and day."""
    folder = shared_path(t.spark, "orders")
    tables.write_years(t.orders.select("o_orderkey", day("o_orderdate").alias("d")), folder, "orders", "d", ["o_orderkey"], 64 << 20)
    return folder


ORDERS_BY_DAY = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("d", T.DateType())])


@query("SELECT o_orderkey, o_orderdate::DATE AS d, year(o_orderdate)::INT AS y FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2001")
def year_split_union(t: Tables) -> DataFrame:
    found = tables.read_years(t.spark, orders_by_year(t), "orders", 1995, 2001, ORDERS_BY_DAY)
    return found.withColumn("y", F.year("d"))


@query("""SELECT o_orderkey, o_orderdate::DATE AS d, year(o_orderdate)::INT AS file_year FROM orders
WHERE o_orderdate::DATE BETWEEN DATE '1995-11-15' AND DATE '1996-02-10' OR (month(o_orderdate) = 12 AND year(o_orderdate) >= 2000)""")
def years_by_predicate(t: Tables) -> DataFrame:
    """Rows of a date predicate across year ends, from the files of the years that it can hold in, with the file each is from."""
    d = F.col("d")
    predicate = d.between(F.lit("1995-11-15").cast("date"), F.lit("1996-02-10").cast("date")) | ((F.month(d) == 12) & (F.year(d) >= 2000))
    found = tables.read_where(t.spark, orders_by_year(t), "orders", "d", predicate, ORDERS_BY_DAY)
    return found.withColumn("file_year", F.regexp_extract(F.col("_metadata.file_path"), r"orders_(\d+)\.parquet", 1).cast("int"))


@query("SELECT c_custkey, c_name, c_acctbal, (DATE '1995-01-01' + (c_custkey % 900)::INT)::DATE AS since FROM customer")
def csv_gz_scan(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "customers.csv.gz")
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal", F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("c_custkey") % 900).cast("int")).alias("since"))
    rows.write.csv(path, header=True, dateFormat="yyyy-MM-dd", compression="gzip")
    return tables.read_csv_gz(t.spark, path, rows.schema)


@query("SELECT fmt, s_suppkey, s_name, s_acctbal FROM supplier, (VALUES ('csv'), ('parquet')) f(fmt)")
def dual_export(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    a, b = (shared_path(t.spark, f"suppliers.{x}") for x in ("csv", "parquet"))
    tables.write_table(rows, a, "csv")
    tables.write_table(rows, b, "parquet")
    twins = tables.read_csv_gz(t.spark, a, rows.schema), t.spark.read.schema(rows.schema).parquet(b)
    return twins[0].withColumn("fmt", F.lit("csv")).unionByName(twins[1].withColumn("fmt", F.lit("parquet")))


@query("SELECT year(o_orderdate)::INT AS y, count(*)::BIGINT AS n, 3::BIGINT AS n_files, 0::BIGINT AS n_unsorted FROM orders GROUP BY 1")
def yearly_sink(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "orders")
    tables.write_by_year(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), path, "o_orderdate", ["o_custkey", "o_orderdate", "o_orderkey"], 3)
    rows = t.spark.read.parquet(path).select(F.col("year").alias("y"), "o_custkey", "o_orderdate", "o_orderkey", "_metadata.file_path", F.col("_metadata.row_index").alias("at"))
    key = F.struct("o_custkey", "o_orderdate", "o_orderkey")
    before = F.lag(key).over(Window.partitionBy("file_path").orderBy("at"))
    return rows.withColumn("unsorted", F.coalesce(before > key, F.lit(False))).groupBy("y").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("n_files"), F.count_if("unsorted").alias("n_unsorted"))


@query("""SELECT DISTINCT year(o_orderdate)::INT AS y, CASE year(o_orderdate) WHEN 1997 THEN 'changed' WHEN 1998 THEN 'unlisted' ELSE 'ok' END AS state FROM orders
UNION ALL SELECT 1900, 'missing'""")
def manifest_verify(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "orders")
    tables.write_by_year(t.orders.select("o_orderkey", "o_orderdate"), path, "o_orderdate", ["o_orderkey"])
    digests = tables.file_digests(t.spark, path, "*.parquet")
    year = F.regexp_extract("path", r"year=(\d+)/", 1).cast("int")
    listed = digests.filter(year != 1998).withColumn("sha256", F.when(year == 1997, F.reverse("sha256")).otherwise(F.col("sha256")))
    gone = t.spark.createDataFrame([("year=1900/part.parquet", 1, "0")], digests.schema)
    return tables.verify_manifest(listed.unionByName(gone), digests).select(year.alias("y"), "state")


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part")
def publish_columns(t: Tables) -> DataFrame:
    return tables.drop_cols(t.part, "p_size", "p_retailprice", "never_there")


@query(f"SELECT user_id AS code, start_day AS suspend_start_date FROM ({RUNS}) WHERE start_day <= (SELECT min(ts)::DATE + 20 FROM events)")
def pit_view(t: Tables) -> DataFrame:
    runs = error_runs(t).select(F.col("user_id").alias("code"), F.col("start_day").alias("suspend_start_date"), F.col("last_day").alias("last_suspended_date"), F.col("end_exclusive").alias("resume_date"), F.col("n_days").alias("suspended_trading_days"), F.col("is_open").alias("still_suspended_at_data_end"))
    cutoff = t.events.agg(F.date_add(F.min(day("ts")), 20)).scalar()
    return filters.pit_view(runs, "suspensions", "suspend_start_date", cutoff)


STATES_OF = {
    "sales": ("sale_id long, client_id int, status string, total double, sold_at timestamp_ntz, note string", {"client_id": "bigint for int", "arrived_at": "unexpected", "priority": "unexpected", "note": "missing"}),
    "orders": ("o_orderkey long, o_custkey int, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_comment string", {"o_custkey": "bigint for int", "o_orderpriority": "unexpected", "o_comment": "missing"}),
}
_COLUMNS = {name: list(dict.fromkeys([*(x.split()[0] for x in ddl.split(", ")), *odd])) for name, (ddl, odd) in STATES_OF.items()}


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{c}' AS column_name, '{STATES_OF[name][1].get(c, 'ok')}' AS state, count(*)::BIGINT AS n_rows, {'NULL' if STATES_OF[name][1].get(c) == 'missing' else f'(count(*) FILTER (WHERE {c} IS NULL))'}::BIGINT AS n_null FROM {name}"
    for name, columns in _COLUMNS.items() for c in columns
))
def schema_check(t: Tables) -> DataFrame:
    """Two tables against what is expected of them: each column's state, with the rows and nulls that its table has."""
    one = lambda name: quality.schema_profile(getattr(t, name), T.StructType.fromDDL(STATES_OF[name][0])).withColumn("table_name", F.lit(name))
    return one("sales").unionByName(one("orders"))


LATE = "2024-03-15"


@query(f"""WITH s AS (SELECT sold_at::DATE AS d, status, total, arrived_at FROM sales WHERE sold_at IS NOT NULL)
SELECT d, sum(total::DECIMAL(12,2))::DOUBLE AS total, sum(total::DECIMAL(12,2)) FILTER (WHERE status = 'open')::DOUBLE AS total_open, count(DISTINCT status)::BIGINT AS n_status, bool_or(arrived_at > TIMESTAMP '{LATE}') AS refreshed FROM s GROUP BY d""")
def late_days_refreshed(t: Tables) -> DataFrame:
    """Daily totals, first of what has arrived by a day, then brought up to date with what came later; which days that wrote.

    A third run with the same sales writes no day.
    """
    sales = t.sales.filter("sold_at is not null").select(day("sold_at").alias("d"), "sale_id", "status", "total", "arrived_at")
    money = F.col("total").cast("decimal(12,2)")
    totals = lambda df: df.groupBy("d").agg(F.sum(money).cast("double").alias("total"), F.sum(F.when(F.col("status") == "open", money)).cast("double").alias("total_open"), F.count_distinct("status").alias("n_status"))
    path = shared_path(t.spark, "daily")
    tables.refresh_days(path, sales.filter(F.col("arrived_at") <= F.lit(f"{LATE} 00:00:00").cast("timestamp_ntz")), "d", totals)
    fresh = tables.refresh_days(path, sales, "d", totals)
    again = tables.refresh_days(path, sales, "d", totals)
    rows = t.spark.read.schema(totals(sales).schema).parquet(f"{path}/table")
    written_ = fresh.unionByName(again).groupBy("d").agg(F.lit(True).alias("refreshed"))
    return rows.join(written_, "d", "left").withColumn("refreshed", F.coalesce("refreshed", F.lit(False)))


@query("SELECT year(sold_at)::INT AS y, count(*)::BIGINT AS n, true AS under_bound, true AS disjoint FROM (SELECT sold_at FROM sales UNION ALL SELECT TIMESTAMP '9999-12-31 10:00:00') GROUP BY 1")
def sized_yearly_sink(t: Tables) -> DataFrame:
    """Files of a year by size and range: whether all are under the bound and hold disjoint ranges of clients and times.

    One stray date is added; it is one file.
    """
    path, most = shared_path(t.spark, "sales"), 1 << 20
    stray = t.spark.range(1).select(F.lit(-1).cast("long").alias("client_id"), F.lit("9999-12-31 10:00:00").cast("timestamp_ntz").alias("sold_at"), F.lit(-1).cast("long").alias("sale_id"))
    tables.write_sorted_years(t.sales.select("client_id", "sold_at", "sale_id").unionByName(stray), path, "sold_at", ["client_id", "sold_at", "sale_id"], most)
    key = F.struct("client_id", "sold_at", "sale_id")
    files = t.spark.read.parquet(path).groupBy(F.col("year").alias("y"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    before = F.max("high").over(Window.partitionBy("y").orderBy("low", "file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("apart", F.coalesce(before < F.col("low"), F.lit(True)))
    return files.groupBy("y").agg(F.sum("n").alias("n"), (F.max("size") <= most).alias("under_bound"), F.every("apart").alias("disjoint"))
