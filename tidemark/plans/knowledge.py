"""What was known when: two times, versions, sets of intervals, open ranges, and scans over crowded keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import alignment, asof, combine, interval_sets, intervals, panel, revisions, scan
from tidemark.plans.base import Tables, query
from tidemark.plans.basic import day


def us(c: str) -> Column:
    """Microseconds since 1970 of a time without a zone, as it is written."""
    whole = F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
    return whole + F.hour(c) * 3_600_000_000 + F.minute(c) * 60_000_000 + (F.extract(F.lit("SECOND"), F.col(c)) * 1_000_000).cast("long")


SALES_KNOWN = """SELECT c.click_id, max_by(s.sale_id, (s.sold_at, s.arrived_at, s.sale_id)) AS sale_id FROM (SELECT DISTINCT click_id, client_id, ts, arrived_at FROM clicks) c
JOIN sales s ON s.client_id = c.client_id AND s.sold_at <= c.ts AND s.arrived_at <= {} GROUP BY ALL"""


@query(f"""SELECT c.click_id, a.sale_id AS known_then, b.sale_id AS known_later, l.sale_id AS in_effect FROM clicks c
LEFT JOIN ({SALES_KNOWN.format("c.ts")}) a ON a.click_id = c.click_id LEFT JOIN ({SALES_KNOWN.format("c.arrived_at + INTERVAL 6 HOUR")}) b ON b.click_id = c.click_id
LEFT JOIN ({SALES_KNOWN.format("TIMESTAMP '2999-01-01'")}) l ON l.click_id = c.click_id""")
def bitemporal_asof(t: Tables) -> DataFrame:
    """The latest sale of a click's client, as known when it was made, as known six hours after it arrived, and with hindsight.

    Sales take effect when sold and are known when they arrive, hours or days later for some.
    """
    sales = t.sales.select("client_id", "sold_at", "arrived_at", "sale_id")
    hindsight = F.lit("2999-01-01 00:00:00").cast("timestamp_ntz")
    rows = t.clicks.select("click_id", "client_id", "ts", (F.col("arrived_at") + F.expr("INTERVAL 6 HOURS")).alias("later"), hindsight.alias("hindsight"))
    times = {"known_then": "ts", "known_later": "later", "in_effect": "hindsight"}
    found = asof.states_as_known(rows, sales, ["client_id"], "ts", "sold_at", "arrived_at", ["sale_id"], times, ties=("sale_id",), split=scan.MEASURED)
    return found.select("click_id", *(F.col(n)["sale_id"].alias(n) for n in times))


CHAIN = """WITH r AS (SELECT client_id, valid_at, seq, change_id, op = 'D' AS gone, (segment, city, balance, op = 'D')::VARCHAR AS said FROM client_changes WHERE valid_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY client_id, valid_at ORDER BY seq DESC, change_id DESC, gone DESC, segment DESC, city DESC, balance DESC) = 1),
c AS (SELECT * FROM r QUALIFY said IS DISTINCT FROM lag(said) OVER (PARTITION BY client_id ORDER BY valid_at)),
n AS (SELECT *, lead(valid_at) OVER w AS known_to, (sum((NOT gone)::INT) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS version FROM c WINDOW w AS (PARTITION BY client_id ORDER BY valid_at))
SELECT client_id, change_id, version, valid_at AS known_from, known_to, version = 1 AS is_first, version = max(version) OVER (PARTITION BY client_id) AS is_last FROM n WHERE NOT gone"""


def chain(t: Tables) -> DataFrame:
    found = revisions.revision_chain(t.client_changes, ["client_id"], "valid_at", ["seq", "change_id"], ["segment", "city", "balance"], F.col("op") == "D", scan.MEASURED)
    return found.select("client_id", "change_id", "version", "known_from", "known_to", "is_first", "is_last")


@query(f"SELECT client_id, change_id, version, epoch_us(known_from) AS known_from_us, epoch_us(known_to) AS known_to_us, is_first, is_last, coalesce(known_from <= TIMESTAMP '2024-03-01' AND coalesce(known_to > TIMESTAMP '2024-03-01', true), false) AS as_of_march FROM ({CHAIN})")
def revision_versions(t: Tables) -> DataFrame:
    rows = chain(t)
    march = revisions.as_of(rows, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).select(F.col("client_id").alias("_client"), F.col("version").alias("_version"), F.lit(True).alias("as_of_march"))
    marked = rows.join(march, F.col("client_id").eqNullSafe(F.col("_client")) & (F.col("version") == F.col("_version")), "left")
    return marked.select("client_id", "change_id", "version", us("known_from").alias("known_from_us"), us("known_to").alias("known_to_us"), "is_first", "is_last", F.coalesce("as_of_march", F.lit(False)).alias("as_of_march"))


@query(f"SELECT s.sale_id, c.change_id, c.version, c.is_last FROM sales s JOIN ({CHAIN}) c ON s.client_id = c.client_id AND s.sold_at >= c.known_from AND (c.known_to IS NULL OR s.sold_at < c.known_to)")
def revision_known_at(t: Tables) -> DataFrame:
    return revisions.known_at(t.sales.select("sale_id", "client_id", "sold_at"), chain(t), ["client_id"], "sold_at", ["change_id", "version", "is_last"]).drop("client_id", "sold_at")


FIRST, UNTIL = "2024-01-01", "2024-07-01"
#: Open sales hold until further notice; what a client did not click for three days after a click is no visit.
HELD = "SELECT client_id, sold_at::DATE AS s, CASE WHEN status <> 'open' THEN sold_at::DATE + priority * 2 END AS e FROM sales WHERE sold_at IS NOT NULL AND priority IS NOT NULL"
VISITS = "SELECT client_id, ts::DATE AS s, (ts::DATE + 3)::DATE AS e FROM clicks WHERE ts IS NOT NULL"
DAYS_OF = f"SELECT DISTINCT client_id, unnest(generate_series(s, coalesce(e, DATE '{UNTIL}') - 1, INTERVAL 1 DAY))::DATE AS d FROM ({{}}) WHERE s < coalesce(e, DATE '{UNTIL}')"
ISLANDS = f"""SELECT client_id, op, min(d) AS start_day, nullif((max(d) + 1)::DATE, DATE '{UNTIL}') AS end_day FROM (
SELECT client_id, op, d, d - (row_number() OVER (PARTITION BY client_id, op ORDER BY d))::INT AS g FROM x) GROUP BY client_id, op, g"""
BOTH_DAYS = f"""j AS (SELECT coalesce(a.client_id, b.client_id) AS client_id, coalesce(a.d, b.d) AS d, a.d IS NOT NULL AS in_a, b.d IS NOT NULL AS in_b
FROM ({DAYS_OF.format(HELD)}) a FULL JOIN ({DAYS_OF.format(VISITS)}) b ON a.client_id IS NOT DISTINCT FROM b.client_id AND a.d = b.d)"""


def held_and_visits(t: Tables) -> tuple[DataFrame, DataFrame]:
    sales = t.sales.filter("sold_at is not null and priority is not null")
    held = sales.select("client_id", day("sold_at").alias("start_day"), F.when(F.col("status") != "open", F.date_add(day("sold_at"), F.col("priority") * 2)).alias("end_day"))
    visits = t.clicks.filter("ts is not null").select("client_id", day("ts").alias("start_day"), F.date_add(day("ts"), 3).alias("end_day"))
    return held, visits


@query(f"""WITH {BOTH_DAYS}, x AS (SELECT client_id, 'union' AS op, d FROM j UNION ALL SELECT client_id, 'intersection', d FROM j WHERE in_a AND in_b UNION ALL SELECT client_id, 'difference', d FROM j WHERE in_a AND NOT in_b) {ISLANDS}""")
def interval_algebra(t: Tables) -> DataFrame:
    """Union, intersection and difference of the days in which clients have goods and in which they visit."""
    held, visits = held_and_visits(t)
    return interval_sets.combined_all(held, visits, ["client_id"], "start_day", "end_day", ["union", "intersection", "difference"], scan.MEASURED)


@query(f"""WITH {BOTH_DAYS} SELECT client_id, (count(*) FILTER (WHERE in_a AND in_b))::BIGINT AS covered, (count(*) FILTER (WHERE in_a AND NOT in_b))::BIGINT AS missed, (count(*) FILTER (WHERE in_b AND NOT in_a))::BIGINT AS spurious FROM j GROUP BY 1""")
def interval_days_compared(t: Tables) -> DataFrame:
    held, visits = held_and_visits(t)
    bound = lambda x: F.lit(x).cast("date")
    return interval_sets.compared_days(held, visits, ["client_id"], "start_day", "end_day", bound(FIRST), bound(UNTIL), scan.MEASURED)


POLICIES = """SELECT n_nationkey AS policy, CASE WHEN n_nationkey % 7 <> 0 THEN DATE '2023-06-01' + (n_nationkey * 11)::INT END AS s, CASE WHEN n_nationkey % 5 <> 0 THEN DATE '2023-06-01' + (n_nationkey * 48)::INT END AS e FROM nation"""


@query(f"SELECT c.client_id, p.policy FROM clients c JOIN ({POLICIES}) p ON (p.s IS NULL OR c.updated_at::DATE >= p.s) AND (p.e IS NULL OR c.updated_at::DATE < p.e) AND (p.s IS NULL OR p.e IS NULL OR p.s < p.e) WHERE c.updated_at IS NOT NULL")
def range_join_open(t: Tables) -> DataFrame:
    """The policies, a fixed set of up to years of length and open ends, that held when each client was changed."""
    from_june = lambda n: F.date_add(F.lit("2023-06-01").cast("date"), F.col("n_nationkey").cast("int") * n)
    policies = t.nation.select(F.col("n_nationkey").alias("policy"), F.when(F.col("n_nationkey") % 7 != 0, from_june(11)).alias("s"), F.when(F.col("n_nationkey") % 5 != 0, from_june(48)).alias("e"))
    return interval_sets.dyadic_join(t.clients.select("client_id", day("updated_at").alias("d")), policies, "d", "s", "e").select("client_id", "policy")


TRANSIT = "SELECT sold_at::DATE AS s, shipped_at::DATE AS e, l.sale_id IS NOT NULL AS was FROM sales o JOIN sale_lines l USING (sale_id) WHERE sold_at IS NOT NULL"


@query(f"""WITH b AS (SELECT s, e, count(*) AS c FROM ({TRANSIT}) GROUP BY ALL), d AS (SELECT DISTINCT sold_at::DATE AS d FROM sales WHERE sold_at IS NOT NULL),
n AS (SELECT d, sum(c)::BIGINT AS n FROM d JOIN b ON d >= s AND (e IS NULL OR d < e) GROUP BY d)
SELECT sale_id, coalesce(n, 0)::BIGINT AS in_transit FROM sales LEFT JOIN n ON n.d = sold_at::DATE WHERE sold_at IS NOT NULL""")
def stabbing_counts(t: Tables) -> DataFrame:
    """How many sale lines were sold but not yet shipped on the day of each sale."""
    sold = t.sales.select("sale_id", "sold_at")
    lines = t.sale_lines.select("sale_id", "shipped_at").join(sold, "sale_id").filter("sold_at is not null").select(day("sold_at").alias("s"), day("shipped_at").alias("e"))
    return interval_sets.stabbing_counts(sold.filter("sold_at is not null").select("sale_id", day("sold_at").alias("d")), lines, "d", "s", "e", "in_transit").select("sale_id", "in_transit")


CHANGES = "SELECT DISTINCT change_id, client_id, valid_at, seq, segment, balance FROM client_changes"
ORDERED = "WINDOW w AS (PARTITION BY client_id ORDER BY valid_at NULLS FIRST, seq, change_id)"


def changes(t: Tables) -> DataFrame:
    return t.client_changes.select("change_id", "client_id", "valid_at", "seq", "segment", "balance").distinct()


@query(f"SELECT change_id, round(balance - lag(balance) OVER w, 6) AS balance_change, epoch_us(lead(valid_at) OVER w) AS until_us, (row_number() OVER w = 1 OR segment IS DISTINCT FROM lag(segment) OVER w) AS changed FROM ({CHANGES}) {ORDERED}")
def crowded_scans(t: Tables) -> DataFrame:
    """Differences, ends and change points of the changes of clients, one of which may have a third of them."""
    keys, order = ["client_id"], ["valid_at", "seq", "change_id"]
    rows = changes(t)
    crowd = scan.crowds(rows, keys, "valid_at", scan.MEASURED)
    found = panel.diff_prev(rows, keys, order, "balance", "balance_change", crowd)
    found = intervals.events_to_intervals(found, keys, "valid_at", ["seq", "change_id"], "until", crowd)
    points = panel.change_points(rows, keys, order, "segment", crowd).select("change_id", F.lit(True).alias("changed"))
    return found.join(points, "change_id", "left").select("change_id", F.round("balance_change", 6).alias("balance_change"), us("until").alias("until_us"), F.coalesce("changed", F.lit(False)).alias("changed"))


@query(f"""WITH r AS (SELECT *, (row_number() OVER w = 1 OR segment IS DISTINCT FROM lag(segment) OVER w)::INT AS ch FROM ({CHANGES}) {ORDERED}),
g AS (SELECT *, sum(ch) OVER w AS run FROM r {ORDERED}),
f AS (SELECT client_id, run, any_value(segment) AS segment, min(valid_at) AS f, max(valid_at) AS l, count(*)::BIGINT AS n FROM g GROUP BY ALL)
SELECT client_id, segment, n, epoch_us(f) AS from_us, epoch_us(l) AS last_us, epoch_us(lead(f) OVER (PARTITION BY client_id ORDER BY run)) AS to_us FROM f""")
def crowded_runs(t: Tables) -> DataFrame:
    runs = intervals.fold_runs(changes(t), ["client_id"], ["valid_at", "seq", "change_id"], "segment", scan.MEASURED)
    return runs.select("client_id", "segment", "n", us("effective_from").alias("from_us"), us("last_observed").alias("last_us"), us("effective_to_exclusive").alias("to_us"))


WEEKDAYS = "SELECT DISTINCT sold_at::DATE AS d FROM sales WHERE sold_at IS NOT NULL AND isodow(sold_at) < 6"
STEP_DAYS = "SELECT DISTINCT client_id, valid_at::DATE AS d FROM client_changes WHERE valid_at IS NOT NULL AND op = 'U' AND segment IN ('retail', 'public')"
SOLD_DAYS = "SELECT DISTINCT client_id, sold_at::DATE AS d FROM sales WHERE sold_at IS NOT NULL AND client_id IS NOT NULL"


@query(f"""WITH c AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM ({WEEKDAYS})),
m AS (SELECT x.d, min(c.i) AS i FROM (SELECT d FROM ({STEP_DAYS}) UNION SELECT d FROM ({SOLD_DAYS})) x JOIN c ON c.d >= x.d WHERE x.d >= (SELECT min(d) FROM c) GROUP BY x.d),
s AS (SELECT DISTINCT client_id, i FROM ({STEP_DAYS}) JOIN m USING (d)), a AS (SELECT DISTINCT client_id, i FROM ({SOLD_DAYS}) JOIN m USING (d)),
p AS (SELECT s.client_id, s.i AS s, a.i AS a FROM s JOIN a USING (client_id)),
sn AS (SELECT client_id, s, arg_min(a, (abs(s - a), a)) AS a FROM p GROUP BY ALL), an AS (SELECT client_id, a, arg_min(s, (abs(s - a), -s)) AS s FROM p GROUP BY ALL),
k AS (SELECT sn.* FROM sn JOIN an USING (client_id, s, a) WHERE abs(s - a) <= 5),
r AS (SELECT client_id, s, a FROM k UNION ALL SELECT client_id, i, NULL FROM s WHERE NOT EXISTS (FROM k WHERE k.client_id = s.client_id AND k.s = s.i) UNION ALL SELECT client_id, NULL, i FROM a WHERE NOT EXISTS (FROM k WHERE k.client_id = a.client_id AND k.a = a.i))
SELECT client_id, x.d AS step_day, y.d AS announced_day, (s - a)::INT AS lag, CASE WHEN s IS NULL THEN 'unanswered' WHEN a IS NULL THEN 'unexplained' WHEN s < a THEN 'early' WHEN s - a > 1 THEN 'late' ELSE 'matched' END AS state
FROM r LEFT JOIN c x ON x.i = s LEFT JOIN c y ON y.i = a""")
def step_alignment(t: Tables) -> DataFrame:
    """Changes of clients against their purchases, one to one, in weekdays."""
    sold = t.sales.filter("sold_at is not null").select("client_id", day("sold_at").alias("announced_day"))
    # Monday is 0
    index = alignment.calendar_index(sold.filter(F.weekday("announced_day") < 5), "announced_day")
    steps = t.client_changes.filter(F.col("op").eqNullSafe("U") & F.col("segment").isin("retail", "public")).select("client_id", day("valid_at").alias("step_day"))
    return alignment.align_steps(steps, sold, ["client_id"], "step_day", "announced_day", index, 1, 5, scan.MEASURED)


@query("""WITH v AS (SELECT nation_id, vendor_id, DATE '2024-01-01' + (vendor_id % 70)::INT AS f, CASE WHEN vendor_id % 3 = 0 THEN DATE '2024-01-01' + (vendor_id % 70 + 40)::INT END AS u FROM vendors),
s AS (SELECT nation_id, shipped_at::DATE AS d, count(DISTINCT vendor_id)::BIGINT AS n FROM sale_lines JOIN vendors USING (vendor_id) WHERE shipped_at IS NOT NULL GROUP BY ALL),
x AS (SELECT s.nation_id, d, n, count(DISTINCT vendor_id)::BIGINT AS n_expected FROM s JOIN v ON v.nation_id IS NOT DISTINCT FROM s.nation_id AND f <= d AND (u IS NULL OR d < u) GROUP BY ALL)
SELECT *, (n = n_expected)::INT AS complete FROM x""")
def completeness_dated(t: Tables) -> DataFrame:
    """Vendors of a nation that ship on a day against those that are expected then."""
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vendor_id") % 70).cast("int"))
    dim = t.vendors.select("nation_id", "vendor_id", start.alias("f"), F.when(F.col("vendor_id") % 3 == 0, F.date_add(start, 40)).alias("u"))
    lines = t.sale_lines.filter("shipped_at is not null").select("vendor_id", day("shipped_at").alias("d")).distinct().join(t.vendors.select("vendor_id", "nation_id"), "vendor_id")
    return combine.completeness(lines, dim, "nation_id", ["d"], "vendor_id", "f", "u", scan.MEASURED)
