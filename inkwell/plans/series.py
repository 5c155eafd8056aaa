"""Series queries: momentum, daily index, smoothing, health, ledgers, cards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.casualties import classify_facts
from ..operators.series import MOMENTUM, coverage_status, day_index, displayed, event_score, gap_filled, halved_counters, health, independent_reports, macd, smoothed
from ..registry import query
from ..sources.tables import table

THROUGH = 1704067200 + 10 * 86_400
HORIZON = 48 * 3600
E = "e AS (SELECT event_id, user_id, event_type, value, floor(epoch(ts))::BIGINT AS sec, ts::DATE AS day FROM events)"


def _reports(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event"), F.col("user_id").alias("origin"), "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))


def _macd_sql() -> str:
    m, start = MOMENTUM, THROUGH - HORIZON
    n = -(-HORIZON // m["bucket"])
    a = {k: repr(1 - 2 ** (-m["bucket"] / m[k])) for k in ("short", "long", "signal")}
    return f"""WITH RECURSIVE {E}, r AS (SELECT event_type AS event, user_id AS origin, sec FROM e WHERE sec BETWEEN {start} AND {THROUGH}),
c AS (SELECT event, least((sec - {start}) // {m["bucket"]}, {n - 1}) AS b, count(*) AS n FROM r GROUP BY 1, 2),
f AS (SELECT k.event, g.b, coalesce(c.n, 0)::DOUBLE AS n FROM (SELECT DISTINCT event FROM r) k CROSS JOIN (SELECT unnest(range({n})) AS b) g LEFT JOIN c ON c.event = k.event AND c.b = g.b),
w AS (SELECT event, -1::BIGINT AS b, 0::DOUBLE AS s, 0::DOUBLE AS l, 0::DOUBLE AS g, 0::DOUBLE AS prev, 0::DOUBLE AS h FROM (SELECT DISTINCT event FROM r)
  UNION ALL SELECT event, b, s, l, g + {a["signal"]} * (s - l - g), h, s - l - (g + {a["signal"]} * (s - l - g)) FROM (
    SELECT w.event, f.b, w.s + {a["short"]} * (f.n - w.s) AS s, w.l + {a["long"]} * (f.n - w.l) AS l, w.g, w.h FROM w JOIN f ON f.event = w.event AND f.b = w.b + 1)),
t AS (SELECT event, count(*) AS reports, count(DISTINCT origin) AS origins FROM r WHERE sec > {THROUGH - m["window"]} GROUP BY 1)
SELECT w.event, round(s - l, 6) AS macd, round(g, 6) AS signal, round(h, 6) AS histogram, coalesce(reports, 0)::BIGINT AS reports, coalesce(origins, 0)::BIGINT AS origins,
  CASE WHEN prev > 0 AND h < 0 THEN 'decelerating' WHEN h > 0 AND coalesce(reports, 0) >= {m["reports"]} AND coalesce(origins, 0) >= {m["origins"]} THEN 'accelerating' ELSE 'quiet' END AS state
FROM w LEFT JOIN t ON t.event = w.event WHERE b = {n - 1}"""


@query(_macd_sql())
def momentum_macd(spark, sf_dir):
    """G1: momentum and state of each event."""
    m = macd(_reports(spark, sf_dir), HORIZON, THROUGH)
    return m.select("event", *(F.round(c, 6).alias(c) for c in ("macd", "signal", "histogram")), "reports", "origins", "state")


@query(f"""WITH {E} SELECT event_type AS event, (count(*) FILTER (WHERE sec > {THROUGH} - 21600))::BIGINT AS last6, (count(*) FILTER (WHERE sec > {THROUGH} - 43200 AND sec <= {THROUGH} - 21600))::BIGINT AS before6,
CASE WHEN count(*) FILTER (WHERE sec > {THROUGH} - 7200) >= 3 OR count(*) FILTER (WHERE sec > {THROUGH} - 21600) > count(*) FILTER (WHERE sec > {THROUGH} - 43200 AND sec <= {THROUGH} - 21600) THEN 'rising'
WHEN count(*) FILTER (WHERE sec > {THROUGH} - 21600) = 0 THEN 'fading' ELSE 'steady' END AS trend FROM e WHERE sec <= {THROUGH} GROUP BY 1""")
def momentum_simple_6h(spark, sf_dir):
    """Six hours against the six before, with a two-hour burst."""
    r = _reports(spark, sf_dir).where(F.col("at") <= THROUGH)
    n = lambda a, b: F.count_if((F.col("at") > THROUGH - a) & (F.col("at") <= THROUGH - b))
    g = r.groupBy("event").agg(n(21600, 0).alias("last6"), n(43200, 21600).alias("before6"), n(7200, 0).alias("burst"))
    trend = F.when((F.col("burst") >= 3) | (F.col("last6") > F.col("before6")), "rising").when(F.col("last6") == 0, "fading").otherwise("steady")
    return g.select("event", "last6", "before6", trend.alias("trend"))


@query("""SELECT l_orderkey AS event, l_suppkey AS wire, epoch(min(l_shipdate))::BIGINT AS at_, arg_min(l_partkey, (l_shipdate, l_partkey)) AS origin, count(DISTINCT l_partkey)::BIGINT AS n_origins FROM lineitem GROUP BY 1, 2""")
def independent_timeline(spark, sf_dir):
    """The earliest report of each wire, and how many origins it names."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("wire"), F.col("l_partkey").alias("origin"), F.unix_timestamp("l_shipdate").alias("published"))
    return independent_reports(li).withColumnRenamed("at", "at_")


@query(f"""WITH {E} SELECT count(*)::BIGINT AS raw, (count(*) FILTER (WHERE value < 5))::BIGINT AS unknown, (count(*) FILTER (WHERE sec > {THROUGH}))::BIGINT AS future, (count(*) FILTER (WHERE sec <= {THROUGH} AND value > 90))::BIGINT AS late FROM e""")
def replay_diagnostics(spark, sf_dir):
    """G4 ST3: what a replay leaves out and what came late."""
    at, v = F.col("at"), F.col("value")
    return _reports(spark, sf_dir).agg(F.count("*").alias("raw"), F.count_if(v < 5).alias("unknown"), F.count_if(at > THROUGH).alias("future"), F.count_if((at <= THROUGH) & (v > 90)).alias("late"))


@query(f"""WITH {E} SELECT user_id AS event, count(*) >= 2 AND max(sec) >= {THROUGH} - 3600 AND max(sec) <= {THROUGH} + 300 AS developing FROM e WHERE sec <= {THROUGH} GROUP BY 1""")
def developing_events(spark, sf_dir):
    """Two reports or more, the latest within an hour."""
    r = _reports(spark, sf_dir).where(F.col("at") <= THROUGH).groupBy(F.col("origin").alias("event")).agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return r.select("event", ((F.col("n") >= 2) & F.col("last").between(THROUGH - 3600, THROUGH + 300)).alias("developing"))


@query("""WITH s AS (SELECT user_id AS feed, event_type <> 'error' AS ok, value AS latency, CASE event_type WHEN 'view' THEN 'full' WHEN 'click' THEN 'teaser' WHEN 'error' THEN 'blocked' WHEN 'signup' THEN 'paywall' END AS class FROM events),
c AS (SELECT feed, class, count(*) AS n, CASE class WHEN 'full' THEN 0 WHEN 'teaser' THEN 1 WHEN 'blocked' THEN 2 ELSE 3 END AS place FROM s WHERE class IS NOT NULL GROUP BY 1, 2),
b AS (SELECT feed, sum(n) AS assessed, arg_max(class, (n, -place)) AS best FROM c GROUP BY 1)
SELECT s.feed, round(avg(ok::INT), 6) AS success_rate, round(avg(latency) FILTER (WHERE ok), 6) AS latency, any_value(CASE WHEN assessed >= 3 THEN best END) AS class FROM s LEFT JOIN b ON b.feed = s.feed GROUP BY 1""")
def feed_health(spark, sf_dir):
    """Success rate, latency and class by plurality."""
    kind = F.col("event_type")
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("feed"), (kind != "error").alias("ok"), F.col("value").alias("latency"), F.when(kind == "view", "full").when(kind == "click", "teaser").when(kind == "error", "blocked").when(kind == "signup", "paywall").alias("class"))
    h = health(s)
    return h.select("feed", F.round("success_rate", 6).alias("success_rate"), F.round("latency", 6).alias("latency"), "class")


@query("""WITH RECURSIVE s AS (SELECT event_type AS feed, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, CASE WHEN value > 20 THEN 1 ELSE 0 END::DOUBLE AS ok, value AS l FROM events),
w AS (SELECT DISTINCT feed, 0::BIGINT AS k, 0::DOUBLE AS attempts, 0::DOUBLE AS successes, 0::DOUBLE AS latency FROM s
  UNION ALL SELECT w.feed, s.k, w.attempts * h + 1, w.successes * h + s.ok, w.latency * h + s.ok * s.l FROM (SELECT *, CASE WHEN attempts >= 200 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS h FROM w) w JOIN s ON s.feed = w.feed AND s.k = w.k + 1)
SELECT feed, round(arg_max(attempts, k), 6) AS attempts, round(arg_max(successes, k), 6) AS successes, round(arg_max(latency, k), 4) AS latency FROM w GROUP BY 1""")
def feed_sample_decay(spark, sf_dir):
    """Counters halved at two hundred attempts."""
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("feed"), "event_id", (F.col("value") > 20).alias("ok"), F.col("value").alias("l"))
    h = halved_counters(s, ["feed"], "event_id", "ok", "l")
    return h.select("feed", F.round("attempts", 6).alias("attempts"), F.round("successes", 6).alias("successes"), F.round("latency", 4).alias("latency"))


@query(f"""WITH {E} SELECT (count(*) FILTER (WHERE sec > {THROUGH} - 3600))::BIGINT AS hour, (count(*) FILTER (WHERE sec > {THROUGH} - 1800))::BIGINT AS half_hour, (count(*) FILTER (WHERE sec > {THROUGH} - 86400))::BIGINT AS day FROM e WHERE sec <= {THROUGH} AND event_type = 'click'""")
def rate_limit_ledger(spark, sf_dir):
    """Deliveries of the trailing hour, half hour and day."""
    r = _reports(spark, sf_dir).where((F.col("at") <= THROUGH) & (F.col("event") == "click"))
    return r.agg(*(F.count_if(F.col("at") > THROUGH - s).alias(n) for n, s in (("hour", 3600), ("half_hour", 1800), ("day", 86400))))


@query("""WITH d AS (SELECT l_suppkey AS entity, l_shipdate::DATE AS day, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-01-31' GROUP BY 1, 2),
k AS (SELECT DISTINCT entity FROM d), g AS (SELECT entity, unnest(generate_series(DATE '1998-01-01', DATE '1998-01-30', INTERVAL 1 DAY))::DATE AS day FROM k)
SELECT g.entity, g.day::VARCHAR AS day, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN d ON d.entity = g.entity AND d.day = g.day""")
def entity_coverage_30d(spark, sf_dir):
    """Thirty days of coverage with gaps filled."""
    li = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp'1998-01-01' AND l_shipdate < timestamp'1998-01-31'")
    d = li.groupBy(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("day")).agg(F.count_distinct("l_orderkey").alias("n"))
    g = gap_filled(d, ["entity"], "day", F.lit("1998-01-01").cast("date"), F.lit("1998-01-30").cast("date"), "n")
    return g.select("entity", F.col("day").cast("string").alias("day"), "n")


# Orders as events of a day: priority picks the type, quantity the deaths, line count the affected, status the escalation.
KINDS = ["armedConflict", "terrorism", "civilUnrest", "coercion", "disaster"]
DAYS = """ev AS (SELECT o_orderkey AS event, o_orderdate::DATE AS day, CASE left(o_orderpriority, 1) WHEN '1' THEN 10.0::DOUBLE WHEN '2' THEN 8.0 WHEN '3' THEN 4.0 WHEN '4' THEN 4.0 ELSE 6.0 END AS weight,
 CASE o_orderstatus WHEN 'F' THEN 0.7::DOUBLE WHEN 'O' THEN 1.3 ELSE 1.0 END AS esc, max(l_quantity) AS deaths, sum(l_quantity) AS affected, count(DISTINCT n_regionkey) AS regions, list(DISTINCT l_suppkey) AS feeds, list(DISTINCT n_regionkey) AS rs
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3, 4),
sc AS (SELECT day, feeds, rs, weight * esc * greatest(CASE WHEN deaths < 1 THEN 1.0::DOUBLE WHEN deaths < 10 THEN 1.2 WHEN deaths < 100 THEN 1.5 WHEN deaths < 1000 THEN 2.0 ELSE 2.5 END, CASE WHEN affected < 1 THEN 1.0::DOUBLE WHEN affected < 10 THEN 1.1 WHEN affected < 100 THEN 1.25 WHEN affected < 1000 THEN 1.5 ELSE 2.0 END)
 * CASE WHEN regions <= 1 THEN 0.85::DOUBLE WHEN regions = 2 THEN 1.0 WHEN regions = 3 THEN 1.15 ELSE 1.30 END AS score FROM ev),
dd AS (SELECT day, sum(score) AS raw, len(list_distinct(flatten(list(feeds)))) AS n_feeds, len(list_distinct(flatten(list(rs)))) AS n_regions FROM sc GROUP BY 1),
dx AS (SELECT day, raw, n_feeds, n_regions, CASE WHEN n_feeds = 0 THEN 'noData' WHEN n_feeds >= 7 AND n_regions >= 4 THEN 'sufficient' ELSE 'insufficient' END AS status FROM dd),
di AS (SELECT *, CASE WHEN status = 'sufficient' THEN least(100.0, greatest(0.0, 100 * (1 - exp(-raw / 25)))) END AS idx FROM dx)"""


def tension_days(spark, sf_dir):
    """(day, raw, n_feeds, n_regions, status, idx)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority", "o_orderstatus")
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    per = li.groupBy("l_orderkey").agg(F.max("l_quantity").alias("deaths"), F.sum("l_quantity").alias("affected"), F.count_distinct("n_regionkey").alias("regions"))
    ev = o.join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.left("o_orderpriority", F.lit(1)).cast("int"))
    esc = F.when(F.col("o_orderstatus") == "F", "deescalating").when(F.col("o_orderstatus") == "O", "escalating").otherwise("noSignal")
    scored = ev.select("day", event_score(kind, F.col("deaths"), F.col("affected"), esc, F.col("regions")).alias("score")).groupBy("day").agg(F.sum("score").alias("raw"))
    # A day's feeds are distinct (day, feed, region) rows first: no list of a day is gathered.
    seen = o.select("o_orderkey", "day").join(li.select("l_orderkey", "l_suppkey", "n_regionkey"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("day", "l_suppkey", "n_regionkey").agg(F.lit(1).alias("met"))
    d = scored.join(seen.groupBy("day").agg(F.count_distinct("l_suppkey").alias("n_feeds"), F.count_distinct("n_regionkey").alias("n_regions")), "day")
    d = d.withColumn("status", coverage_status(F.col("n_feeds"), F.col("n_regions")))
    return d.withColumn("idx", day_index(F.col("raw"), F.col("status")))


@query(f"WITH {DAYS} SELECT day::VARCHAR AS day, n_feeds::BIGINT AS n_feeds, n_regions::BIGINT AS n_regions, status FROM dx")
def coverage_gate(spark, sf_dir):
    """Feeds and regions of a day, and whether they suffice."""
    return tension_days(spark, sf_dir).select(F.col("day").cast("string").alias("day"), "n_feeds", "n_regions", "status")


@query(f"WITH {DAYS} SELECT day::VARCHAR AS day, round(raw, 4) AS raw, round(idx, 4) AS idx FROM di")
def tension_daily(spark, sf_dir):
    """Sum of event scores and the index of each day."""
    return tension_days(spark, sf_dir).select(F.col("day").cast("string").alias("day"), F.round("raw", 4).alias("raw"), F.round("idx", 4).alias("idx"))


@query(f"""WITH RECURSIVE {DAYS}, n AS MATERIALIZED (SELECT day, idx, row_number() OVER (ORDER BY day) AS k FROM di),
w AS (SELECT 0::BIGINT AS k, NULL::DATE AS day, NULL::DOUBLE AS idx, NULL::DOUBLE AS last UNION ALL SELECT n.k, n.day, n.idx, CASE WHEN n.idx IS NULL THEN w.last WHEN w.last IS NULL THEN n.idx ELSE w.last + 0.25 * (n.idx - w.last) END FROM w JOIN n ON n.k = w.k + 1)
SELECT day::VARCHAR AS day, round(CASE WHEN idx IS NOT NULL THEN last END, 4) AS smoothed FROM w WHERE k > 0""")
def tension_smoothed(spark, sf_dir):
    """Exponential mean that carries across gaps."""
    d = tension_days(spark, sf_dir).withColumn("series", F.lit("world"))
    return smoothed(d.select("series", "day", "idx"), ["series"], "day", "idx").select(F.col("day").cast("string").alias("day"), F.round("smoothed", 4).alias("smoothed"))


@query(f"""WITH {DAYS}, s AS (SELECT day, round(idx) AS v FROM di WHERE idx IS NOT NULL),
p AS (SELECT a.day, b.day AS d, b.v, row_number() OVER (PARTITION BY a.day ORDER BY b.day) AS k, row_number() OVER (PARTITION BY a.day ORDER BY b.day DESC) AS r, lag(b.v) OVER (PARTITION BY a.day ORDER BY b.day) AS bv, lag(b.day) OVER (PARTITION BY a.day ORDER BY b.day) AS bd FROM s a JOIN s b ON b.day <= a.day AND b.day > a.day - INTERVAL 7 DAY),
m AS (SELECT day, sum(v * CASE WHEN k = 1 THEN pow(0.75, r - 1) ELSE 0.25 * pow(0.75, r - 1) END) AS mean, min(r) FILTER (WHERE bv IS NULL OR NOT (date_diff('day', bd, d) <= 1 AND v > bv)) - 1 AS run FROM p GROUP BY 1),
b AS (SELECT day, least(100, greatest(0, floor(mean + 0.5) + least(9, 3 * run))) AS x FROM m)
SELECT day::VARCHAR AS day, x::BIGINT AS shown, CASE WHEN x < 20 THEN 'calm' WHEN x < 40 THEN 'low' WHEN x < 60 THEN 'elevated' WHEN x < 80 THEN 'high' ELSE 'severe' END AS level FROM b""")
def tension_display(spark, sf_dir):
    """The mean of seven calendar days that carries on from the first, plus three a rise up to nine, in bands of twenty."""
    d = tension_days(spark, sf_dir).select("day", F.lit("world").alias("series"), F.round("idx").alias("score"))
    shown, x = displayed(d, ["series"], "day", "score"), F.col("shown")
    level = F.when(x < 20, "calm").when(x < 40, "low").when(x < 60, "elevated").when(x < 80, "high").otherwise("severe")
    return shown.select(F.col("day").cast("string").alias("day"), "shown", level.alias("level"))


@query(f"WITH {DAYS} SELECT day::VARCHAR AS day, round(idx - avg(idx) OVER (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 4) AS change FROM di WHERE idx IS NOT NULL")
def tension_change(spark, sf_dir):
    """The index against the mean of thirty days before."""
    d = tension_days(spark, sf_dir).where("idx IS NOT NULL").withColumn("series", F.lit("world"))
    before = Window.partitionBy("series").orderBy("day").rowsBetween(-30, -1)
    return d.select(F.col("day").cast("string").alias("day"), F.round(F.col("idx") - F.avg("idx").over(before), 4).alias("change"))


@query("""SELECT n_name AS place, round(sum(l_extendedprice), 2) AS weight, round(100 * sum(l_extendedprice) / max(sum(l_extendedprice)) OVER (), 4) AS scaled FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def hotspots(spark, sf_dir):
    """Weight by place, and scaled to the largest; aggregated by supplier before names are joined."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("w"))
    s, n = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    g = per.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("place")).agg(F.sum("w").alias("w"))
    return g.select("place", F.round("w", 2).alias("weight"), F.round(100 * F.col("w") / F.max("w").over(Window.partitionBy()), 4).alias("scaled"))


@query("""SELECT o_orderpriority AS driver, count(*)::BIGINT AS n, round(count(*)::DOUBLE / max(count(*)) OVER (), 6) AS severity FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def driver_rows(spark, sf_dir):
    """Drivers by type against the largest."""
    g = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_orderpriority").alias("driver")).agg(F.count("*").alias("n"))
    return g.select("driver", "n", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 6).alias("severity"))


@query("""SELECT r_name AS region, count(DISTINCT l_orderkey)::BIGINT AS stories, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END)::BIGINT AS saved FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def region_rows(spark, sf_dir):
    """E16."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("r_name").alias("region")).agg(F.count_distinct("l_orderkey").alias("stories"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("saved"))


@query("""SELECT l_suppkey AS publisher, count(DISTINCT l_orderkey)::BIGINT AS stories, bool_and(l_returnflag <> 'R') AS all_original FROM lineitem GROUP BY 1""")
def source_footprint(spark, sf_dir):
    """Originals against copies by publisher."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("publisher")).agg(F.count_distinct("l_orderkey").alias("stories"), F.bool_and(F.col("l_returnflag") != "R").alias("all_original"))


@query("""WITH t AS (SELECT DISTINCT o_custkey AS story, o_orderdate::DATE AS day, o_orderpriority AS summary FROM orders) SELECT story, day::VARCHAR AS day, summary FROM (SELECT *, row_number() OVER (PARTITION BY story, summary ORDER BY day) AS rn FROM t) WHERE rn = 1""")
def merged_timeline(spark, sf_dir):
    """Timelines of a story's events, each summary once, at its first day."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("story"), F.col("o_orderpriority").alias("summary")).agg(F.to_date(F.min("o_orderdate")).cast("string").alias("day"))


@query("""SELECT l_orderkey AS event, CASE WHEN max(l_quantity) >= 45 THEN 'severe' END AS severity, CASE WHEN count(*) >= 2 THEN 'repeated' END AS repeat FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) <= 2 AND (max(l_quantity) >= 45 OR count(*) >= 2)""")
def weak_signals(spark, sf_dir):
    """Two publishers at most, and a reason."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(F.count_distinct("l_suppkey").alias("p"), F.max("l_quantity").alias("q"), F.count("*").alias("n"))
    g = g.where("p <= 2").select("event", F.when(F.col("q") >= 45, "severe").alias("severity"), F.when(F.col("n") >= 2, "repeated").alias("repeat"))
    return g.where("severity IS NOT NULL OR repeat IS NOT NULL")


@query("""WITH s AS (SELECT l_orderkey AS story, count(DISTINCT l_suppkey) AS p FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-01-08' GROUP BY 1) SELECT story, p::BIGINT AS publishers, (CASE WHEN p >= 5 THEN 12 WHEN p >= 3 THEN 9 WHEN p = 2 THEN 6 ELSE 3 END)::INT AS degrees FROM s""")
def near_you(spark, sf_dir):
    """Degrees of a week's stories by publishers."""
    li = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp'1998-01-01' AND l_shipdate < timestamp'1998-01-08'")
    g = li.groupBy(F.col("l_orderkey").alias("story")).agg(F.count_distinct("l_suppkey").alias("publishers"))
    p = F.col("publishers")
    return g.select("story", "publishers", F.when(p >= 5, 12).when(p >= 3, 9).when(p == 2, 6).otherwise(3).alias("degrees"))


@query()
def fact_classification(spark, sf_dir):
    """Type, escalation and figures of passages, by cues and patterns."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("event"), F.col("text").alias("quote"))
    return classify_facts(t)
