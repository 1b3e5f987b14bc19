"""As-of joins, intervals, runs and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof, intervals, panel, quality, scan
from tidemark.plans.base import Tables, query
from tidemark.plans.basic import day

KNOWN = "SELECT o_custkey, o_orderdate::DATE AS d, min(o_orderkey) AS k FROM orders GROUP BY 1, 2"
LINES = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, o_custkey, l_shipdate::DATE AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def known_and_lines(t: Tables) -> tuple[DataFrame, DataFrame]:
    known = t.orders.groupBy("o_custkey", day("o_orderdate").alias("known_day")).agg(F.min("o_orderkey").alias("known_order"))
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "o_custkey", day("l_shipdate").alias("shipped"))
    return known, lines


@query(f"SELECT l.*, k.k AS known_order, k.d AS known_day FROM ({LINES}) l ASOF LEFT JOIN ({KNOWN}) k ON l.o_custkey = k.o_custkey AND l.shipped >= k.d")
def asof_pub_date(t: Tables) -> DataFrame:
    known, lines = known_and_lines(t)
    return asof.asof_join(lines, known, ["o_custkey"], "shipped", "known_day", ["known_order", "known_day"], split=scan.MEASURED)


@query(f"SELECT l.*, k.k AS known_order, k.d AS known_day FROM ({LINES}) l ASOF LEFT JOIN ({KNOWN}) k ON l.o_custkey = k.o_custkey AND l.shipped > k.d")
def asof_strict(t: Tables) -> DataFrame:
    known, lines = known_and_lines(t)
    return asof.asof_join(lines, known, ["o_custkey"], "shipped", "known_day", ["known_order", "known_day"], strict=True, split=scan.MEASURED)


STATES = "SELECT user_id, event_id, event_type AS state, ts AS start_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_ts FROM events WHERE event_type IN ('signup', 'error')"


def states(t: Tables) -> DataFrame:
    rows = t.events.filter(F.col("event_type").isin("signup", "error")).select("user_id", "event_id", F.col("event_type").alias("state"), F.col("ts").alias("start_ts"))
    return intervals.events_to_intervals(rows, ["user_id"], "start_ts", ["event_id"], "end_ts")


@query(f"SELECT user_id, event_id, state, epoch_us(start_ts)::BIGINT AS start_us, epoch_us(end_ts)::BIGINT AS end_us FROM ({STATES})")
def event_to_interval(t: Tables) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return states(t).select("user_id", "event_id", "state", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"))


@query(f"""SELECT s.event_id, epoch_us(coalesce(s.end_ts, c.cap))::BIGINT AS end_us FROM ({STATES}) s
LEFT JOIN (SELECT user_id, max(ts) AS cap FROM events WHERE event_type <> 'view' GROUP BY 1 HAVING count(*) > 5) c ON s.user_id = c.user_id""")
def interval_capped(t: Tables) -> DataFrame:
    caps = t.events.filter("event_type <> 'view'").groupBy("user_id").agg(F.max("ts").alias("cap"), F.count("*").alias("n")).filter("n > 5")
    return intervals.cap_open_ends(states(t), caps, ["user_id"], "end_ts", "cap").select("event_id", F.unix_micros(F.col("end_ts").cast("timestamp")).alias("end_us"))


@query(f"""SELECT e.event_id, e.user_id, s.event_id AS other_event, s.state FROM events e JOIN ({STATES}) s
ON e.user_id = s.user_id AND e.event_type = 'click' AND e.ts >= s.start_ts AND e.ts < s.start_ts + INTERVAL 2 DAY""")
def interval_overlapping(t: Tables) -> DataFrame:
    spans = states(t).select(F.col("user_id").alias("user"), F.col("event_id").alias("other_event"), "state", "start_ts", (F.col("start_ts") + F.expr("INTERVAL 2 DAY")).alias("until")).withColumnRenamed("user", "user_id")
    clicks = t.events.filter("event_type = 'click'").select("user_id", "event_id", "ts")
    return intervals.in_interval(clicks, spans, ["user_id"], "ts", "start_ts", "until").select("event_id", "user_id", "other_event", "state")


@query(f"""SELECT e.event_id, s.event_id AS state_event, s.state FROM events e JOIN ({STATES}) s
ON e.user_id = s.user_id AND e.ts >= s.start_ts AND (s.end_ts IS NULL OR e.ts < s.end_ts)""")
def interval_membership(t: Tables) -> DataFrame:
    s = states(t).withColumnRenamed("event_id", "state_event")
    return intervals.in_state(t.events.select("user_id", "event_id", "ts"), s, ["user_id"], "ts", "start_ts", "end_ts", ["state_event", "state"]).drop("user_id", "ts")


RUNS = """WITH cal AS (SELECT d, row_number() OVER (ORDER BY d) AS i, lead(d) OVER (ORDER BY d) AS nxt FROM (SELECT DISTINCT ts::DATE AS d FROM events)),
f AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'error'),
p AS (SELECT user_id, cal.d, i, nxt, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM f JOIN cal USING (d)),
r AS (SELECT user_id, min(d) AS start_day, max(d) AS last_day, arg_max(coalesce(nxt, DATE '9999-01-01'), i) AS e, count(*)::BIGINT AS n_days FROM p GROUP BY user_id, g)
SELECT user_id, start_day, last_day, nullif(e, DATE '9999-01-01') AS end_exclusive, n_days, e = DATE '9999-01-01' AS is_open FROM r"""


def error_runs(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", day("ts").alias("d"), "event_type")
    return intervals.flags_to_runs(rows, ["user_id"], "d", F.col("event_type") == "error", intervals.calendar_of(rows, "d"))


@query(RUNS)
def flag_runs(t: Tables) -> DataFrame:
    return error_runs(t)


@query(f"SELECT user_id, start_day, n_days FROM ({RUNS}) WHERE is_open")
def flag_runs_open(t: Tables) -> DataFrame:
    return error_runs(t).filter("is_open").select("user_id", "start_day", "n_days")


@query("""WITH a AS (SELECT *, coalesce(event_type <> lag(event_type) OVER w, true)::INT AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM a),
c AS (SELECT user_id, g, any_value(event_type) AS event_type, min(ts) AS f, max(ts) AS l, count(*)::BIGINT AS n FROM b GROUP BY user_id, g)
SELECT user_id, event_type, n, epoch_us(f)::BIGINT AS from_us, epoch_us(l)::BIGINT AS last_us, epoch_us(lead(f) OVER (PARTITION BY user_id ORDER BY g))::BIGINT AS to_us FROM c""")
def fold_equal_runs(t: Tables) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    runs = intervals.fold_runs(t.events.select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.select("user_id", "event_type", "n", us("effective_from").alias("from_us"), us("last_observed").alias("last_us"), us("effective_to_exclusive").alias("to_us"))


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS ch FROM events) WHERE ch""")
def change_points(t: Tables) -> DataFrame:
    return panel.change_points(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("""WITH x AS (SELECT *, date_trunc('week', ts)::DATE AS period FROM events WHERE ts::DATE <= DATE '2030-01-01')
SELECT user_id, period, event_id FROM x QUALIFY row_number() OVER (PARTITION BY user_id, period ORDER BY ts DESC, event_id DESC) = 1""")
def period_end_sample(t: Tables) -> DataFrame:
    rows = panel.period_end_sample(t.events, ["user_id"], "ts", "week", F.lit("2030-01-01").cast("timestamp_ntz"), [F.col("event_id").desc()])
    return rows.select("user_id", "period", "event_id")


CALENDAR = "SELECT DISTINCT o_orderdate::DATE AS c FROM orders"


@query(f"""SELECT d, (SELECT min(c) FROM ({CALENDAR}) WHERE c >= d) AS on_or_after, (SELECT min(c) FROM ({CALENDAR}) WHERE c > d) AS after
FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY))::DATE AS d)""")
def next_trading_day(t: Tables) -> DataFrame:
    days = t.orders.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit("1995-01-01")), F.to_date(F.lit("2002-01-01")))).alias("d"))
    calendar = t.orders.select(day("o_orderdate").alias("c"))
    rows = asof.next_in_calendar(days, "d", calendar, "c", "on_or_after", strict=False)
    return asof.next_in_calendar(rows, "d", calendar, "c", "after", strict=True)


SPANS = "SELECT p_partkey, DATE '1995-01-01' + (p_partkey * 37 % 2400)::INT AS s, DATE '1995-01-01' + (p_partkey * 37 % 2400)::INT + (p_size % 5)::INT + 1 AS e FROM part"


@query(f"SELECT o_orderkey, p_partkey FROM orders JOIN ({SPANS}) ON o_orderdate::DATE >= s AND o_orderdate::DATE < e")
def range_join_bucketed(t: Tables) -> DataFrame:
    start = F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("p_partkey") * 37 % 2400).cast("int"))
    spans = t.part.select("p_partkey", start.alias("s"), F.date_add(start, F.col("p_size") % 5 + 1).alias("e")).filter("s is not null and e is not null")
    return intervals.range_join(t.orders.select("o_orderkey", day("o_orderdate").alias("d")), spans, "d", "s", "e", 4, ["p_partkey"]).select("o_orderkey", "p_partkey")


@query("""WITH s AS (SELECT user_id, event_id, ts AS s, ts + INTERVAL 1 DAY AS e FROM events WHERE event_type = 'signup')
SELECT user_id, event_id FROM (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM s) WHERE n < e""")
def check_interval_overlap(t: Tables) -> DataFrame:
    spans = t.events.filter("event_type = 'signup'").select("user_id", "event_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("e"))
    return intervals.check_overlap(spans, ["user_id"], "s", "e", ["event_id"]).select("user_id", "event_id")


MEMBER_DAYS = f"SELECT DISTINCT e.user_id, e.ts::DATE AS d FROM events e JOIN ({STATES}) s ON e.user_id = s.user_id AND e.ts >= s.start_ts AND (s.end_ts IS NULL OR e.ts < s.end_ts) WHERE s.state = 'error'"
ERROR_DAYS = "SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'error'"


def error_days(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'error'").select("user_id", day("ts").alias("d")).distinct()


def member_days(t: Tables) -> DataFrame:
    s = states(t).filter("state = 'error'").drop("event_id")
    return intervals.in_state(t.events.select("user_id", "ts"), s, ["user_id"], "ts", "start_ts", "end_ts", ["state"]).select("user_id", day("ts").alias("d")).distinct()


@query(f"""WITH t AS ({ERROR_DAYS}), p AS ({MEMBER_DAYS}),
j AS (SELECT t.user_id IS NOT NULL AS a, p.user_id IS NOT NULL AS b FROM t FULL JOIN p ON t.user_id = p.user_id AND t.d = p.d),
c AS (SELECT (count(*) FILTER (WHERE a AND b))::BIGINT AS tp, (count(*) FILTER (WHERE NOT a AND b))::BIGINT AS fp, (count(*) FILTER (WHERE a AND NOT b))::BIGINT AS fn FROM j)
SELECT *, tp::DOUBLE / nullif(tp + fn, 0) AS recall, tp::DOUBLE / nullif(tp + fp, 0) AS precision FROM c""")
def recall_precision(t: Tables) -> DataFrame:
    return quality.confusion(error_days(t), member_days(t), ["user_id", "d"])


@query(f"SELECT t.user_id, t.d FROM ({ERROR_DAYS}) t WHERE EXISTS (SELECT 1 FROM ({MEMBER_DAYS}) p WHERE p.user_id = t.user_id AND p.d = t.d)")
def semi_covered(t: Tables) -> DataFrame:
    return error_days(t).join(member_days(t), ["user_id", "d"], "left_semi")
