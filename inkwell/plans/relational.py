"""Joins, aggregates, windows, ordering, set operations and merges over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.merging import edition_changes, forwarded, insert_or_ignore, insert_or_replace, prune, revisions, upsert, without_tombstones
from ..operators.windows import first_rows, islands, rises, top_quartile, trailing, trailing_distinct
from ..registry import query
from ..sources.tables import table


@query("""SELECT o_orderkey, c_name, n_name, coalesce(r.n, 0)::BIGINT AS n_returns FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'""")
def article_view(spark, sf_dir):
    """Inner joins to dimensions and a left join to an aggregate made before the join."""
    returns = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(returns, o.o_orderkey == returns.l_orderkey, "left")
    return joined.select("o_orderkey", "c_name", "n_name", F.coalesce("n", F.lit(0)).alias("n_returns"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def semi_join_active(spark, sf_dir):
    """J3."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join_quiet(spark, sf_dir):
    """J4."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""SELECT a.l_partkey AS part, count(DISTINCT coalesce(b.l_partkey, a.l_partkey))::BIGINT AS peers FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber
WHERE a.l_quantity >= 49 GROUP BY 1""")
def event_peers(spark, sf_dir):
    """A candidate's peers in its event; itself where it has none."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    a, b = li.where("l_quantity >= 49").alias("a"), li.alias("b")
    joined = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") != F.col("b.l_linenumber")), "left")
    return joined.groupBy(F.col("a.l_partkey").alias("part")).agg(F.count_distinct(F.coalesce("b.l_partkey", "a.l_partkey")).alias("peers"))


@query("""SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(DISTINCT a.l_orderkey)::BIGINT AS shared FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_suppkey > a.l_suppkey GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 2""")
def canonical_pairs(spark, sf_dir):
    """Pairs in one order, smaller first; members are made distinct before the join."""
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    a, b = m.alias("a"), m.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.l_suppkey") > F.col("a.l_suppkey")))
    return pairs.groupBy(F.col("a.l_suppkey").alias("a"), F.col("b.l_suppkey").alias("b")).agg(F.count("*").alias("shared")).where("shared >= 2")


@query("""WITH p AS (SELECT l_partkey AS x, l_suppkey AS y, l_orderkey AS id FROM lineitem WHERE l_quantity > 45), m AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT k, (count(*))::BIGINT AS n, sum(CASE WHEN p.x = k THEN p.y ELSE p.x END)::BIGINT AS ends FROM m JOIN p ON p.x = k OR p.y = k GROUP BY 1""")
def either_side_join(spark, sf_dir):
    """A match on either end, as two equi joins; a pair with equal ends counts once."""
    p = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
    m = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"))
    one = m.join(p, F.col("k") == F.col("x")).select("k", F.col("y").alias("other"))
    two = m.join(p.where("x <> y"), F.col("k") == F.col("y")).select("k", F.col("x").alias("other"))
    return one.unionAll(two).groupBy("k").agg(F.count("*").alias("n"), F.sum("other").alias("ends"))


@query("""SELECT c_mktsegment AS story, round(avg(l_discount), 6) AS confidence FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' OR l_linestatus = 'O' GROUP BY 1""")
def story_confidence(spark, sf_dir):
    """Average pair score per story through a chain of joins with an OR residual."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' OR l_linestatus = 'O'").groupBy("l_orderkey").agg(F.sum("l_discount").alias("s"), F.count("l_discount").alias("n"))
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("story")).agg(F.round(F.sum("s") / F.sum("n"), 6).alias("confidence"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS sec FROM events)
SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND a.event_type = 'click' AND b.sec BETWEEN a.sec - 43200 AND a.sec + 43200""")
def band_join_12h(spark, sf_dir):
    """Pairs of one key within twelve hours; the key is joined with the neighbouring half-day buckets, so a hot key spreads over time."""
    width = 43_200
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")).withColumn("bucket", F.expr(f"at div {width}"))
    a = e.where("event_type = 'click'").select(F.col("event_id").alias("a"), "user_id", F.col("at").alias("a_at"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("b"), "user_id", F.col("at").alias("b_at"), "bucket")
    return a.join(b, ["user_id", "bucket"]).where(f"b_at BETWEEN a_at - {width} AND a_at + {width}").select("a", "b")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_row(spark, sf_dir):
    """The newest row of each key, without a window."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("""WITH b AS (SELECT l_orderkey AS e, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1), c AS (SELECT l_orderkey AS e, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1)
SELECT coalesce(b.e, c.e) AS event, CASE WHEN b.e IS NULL THEN 'new' WHEN c.n > b.n THEN 'more' ELSE 'same' END AS change FROM b FULL JOIN c ON b.e = c.e""")
def snapshot_diff(spark, sf_dir):
    """Two snapshots by full outer join."""
    li = table(spark, sf_dir, "lineitem")
    b = li.where("l_shipdate < timestamp'1998-01-01'").groupBy(F.col("l_orderkey").alias("be")).agg(F.count("*").alias("bn"))
    c = li.where("l_shipdate < timestamp'1999-01-01'").groupBy(F.col("l_orderkey").alias("ce")).agg(F.count("*").alias("cn"))
    change = F.when(F.col("be").isNull(), "new").when(F.col("cn") > F.col("bn"), "more").otherwise("same")
    return b.join(c, F.col("be") == F.col("ce"), "full_outer").select(F.coalesce("be", "ce").alias("event"), change.alias("change"))


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, v.event_id AS before FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.ts""")
def asof_snapshot(spark, sf_dir):
    """The newest view strictly before each purchase, by one window over both kinds."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'view')").select("event_id", "user_id", "event_type", "ts")
    before = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    view = F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))
    return e.withColumn("v", F.max(view).over(before)).where("event_type = 'purchase'").select("event_id", F.col("v.event_id").alias("before"))


@query("SELECT l_orderkey AS event, count(DISTINCT l_suppkey)::BIGINT AS publishers FROM lineitem GROUP BY 1")
def publisher_count_distinct(spark, sf_dir):
    """A4."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(F.count_distinct("l_suppkey").alias("publishers"))


@query("""WITH images AS (SELECT l_partkey AS image, l_orderkey AS doc FROM lineitem UNION SELECT l_suppkey, l_orderkey FROM lineitem WHERE l_quantity > 40)
SELECT image, count(DISTINCT doc)::BIGINT AS docs FROM images GROUP BY 1 HAVING count(DISTINCT doc) >= 3 ORDER BY docs DESC, image LIMIT 64""")
def repeated_image_having(spark, sf_dir):
    """Pictures on three or more documents, the 64 most frequent."""
    li = table(spark, sf_dir, "lineitem")
    images = li.select(F.col("l_partkey").alias("image"), F.col("l_orderkey").alias("doc")).union(li.where("l_quantity > 40").select("l_suppkey", "l_orderkey")).distinct()
    return images.groupBy("image").agg(F.count("*").alias("docs")).where("docs >= 3").orderBy(F.desc("docs"), "image").limit(64)


@query("""WITH lengths AS (SELECT source, length(text) AS len, count(*) AS n FROM documents GROUP BY 1, 2), caps AS (SELECT source, max(len) AS cap FROM lengths GROUP BY 1)
SELECT c.source, cap::BIGINT AS cap, n::BIGINT AS n FROM caps c JOIN lengths l ON l.source = c.source AND l.len = c.cap WHERE n >= 1""")
def capped_description(spark, sf_dir):
    """How often each source's longest length occurs, in one pass over the lengths."""
    lengths = table(spark, sf_dir, "documents").groupBy("source", F.length("text").alias("len")).agg(F.count("*").alias("n"))
    return lengths.groupBy("source").agg(F.max("len").cast("long").alias("cap"), F.max_by("n", "len").alias("n"))


@query("""WITH best AS (SELECT l_partkey AS p, l_suppkey AS s, max(l_extendedprice) AS w FROM lineitem GROUP BY 1, 2) SELECT p AS part, round(sum(w), 2) AS weight, count(*)::BIGINT AS evidence FROM best GROUP BY 1 HAVING count(*) >= 2""")
def two_phase_aggregate(spark, sf_dir):
    """The largest per pair and publisher, then their sum."""
    best = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("w"))
    return best.groupBy(F.col("l_partkey").alias("part")).agg(F.round(F.sum("w"), 2).alias("weight"), F.count("*").alias("evidence")).where("evidence >= 2")


@query("SELECT l_partkey AS entity, count(DISTINCT l_orderkey)::BIGINT AS story_count, epoch(min(l_shipdate))::BIGINT AS first_seen, epoch(max(l_shipdate))::BIGINT AS last_seen FROM lineitem GROUP BY 1")
def entity_statistics(spark, sf_dir):
    """A9."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(F.count_distinct("l_orderkey").alias("story_count"), F.unix_timestamp(F.min("l_shipdate")).alias("first_seen"), F.unix_timestamp(F.max("l_shipdate")).alias("last_seen"))


@query("SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN 1 END)::BIGINT AS interest FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1")
def weighted_histogram(spark, sf_dir):
    """Saved counts three, read one."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'view')")
    return e.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "purchase", 3).otherwise(1)).alias("interest"))


@query("""SELECT l_suppkey AS feed, (count(*) FILTER (WHERE l_quantity >= 40))::BIGINT AS full_text, (count(*) FILTER (WHERE l_quantity >= 20 AND l_quantity < 40))::BIGINT AS teaser, (count(*) FILTER (WHERE l_quantity < 20))::BIGINT AS blocked FROM lineitem GROUP BY 1""")
def class_counts(spark, sf_dir):
    """A13."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("feed")).agg(F.count_if(q >= 40).alias("full_text"), F.count_if((q >= 20) & (q < 40)).alias("teaser"), F.count_if(q < 20).alias("blocked"))


@query("SELECT l_orderkey AS event, array_to_string(list_sort(list(DISTINCT r_name)), ',') AS regions FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def region_sets(spark, sf_dir):
    """The set of regions of each event."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey").alias("event")).agg(F.array_join(F.sort_array(F.collect_set("r_name")), ",").alias("regions"))


@query("SELECT l_orderkey AS event, arg_min(p_name, (l_shipdate, l_linenumber)) AS title FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def event_lead_title(spark, sf_dir):
    """The title of the first report whose part has one; days and numbers that are missing come last, and of equal ones the first in the table counts."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_linenumber", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title")).where("title IS NOT NULL")
    known = lambda c: F.struct(F.col(c).isNull().alias("missing"), F.col(c).alias("value"))
    order = F.struct(known("l_shipdate").alias("at"), known("l_linenumber").alias("number"), "file", "row")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("event")).agg(F.min_by("title", order).alias("title"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentiles(spark, sf_dir):
    """A17."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("""WITH a AS (SELECT event_type AS k, avg(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS k, avg(value) AS v FROM events WHERE user_id % 2 = 1 GROUP BY 1)
SELECT k AS metric, a.v > b.v * 1.02 AND a.v - b.v > 0.01 AS worse FROM a JOIN b USING (k)""")
def tolerance_compare(spark, sf_dir):
    """Metrics of two sets, worse beyond a tolerance and a floor; both in one aggregation."""
    e = table(spark, sf_dir, "events")
    m = e.groupBy(F.col("event_type").alias("metric")).agg(F.avg(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("user_id") % 2 == 1, F.col("value"))).alias("b"))
    return m.select("metric", ((F.col("a") > F.col("b") * 1.02) & (F.col("a") - F.col("b") > 0.01)).alias("worse"))


@query("""SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*)::BIGINT AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cube_counts(spark, sf_dir):
    """Grouping sets, which come with Spark."""
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")


@query("""SELECT event_id, (count(*) OVER w)::BIGINT AS volume FROM (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS sec FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)""")
def trailing_volume(spark, sf_dir):
    """Reports in the last hour, by range frame."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return e.select("event_id", F.count("*").over(trailing(["user_id"], "at", 3600)).alias("volume"))


@query("""WITH e AS (SELECT event_id, event_type, user_id, floor(epoch(ts))::BIGINT AS sec FROM events)
SELECT a.event_id, count(DISTINCT b.user_id)::BIGINT AS origins FROM e a JOIN e b ON a.event_type = b.event_type AND b.sec BETWEEN a.sec - 3600 AND a.sec GROUP BY 1""")
def trailing_origins(spark, sf_dir):
    """Distinct origins in the last hour, told by where each origin's stretches begin and end."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return e.join(trailing_distinct(e, "event_type", "user_id", "at", 3600), ["event_type", "at"]).select("event_id", F.col("n").alias("origins"))


DAILY = "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1"


def daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query(f"""WITH d AS ({DAILY}), u AS (SELECT *, coalesce((n > lag(n) OVER (ORDER BY day))::INT, 0) AS up FROM d), r AS (SELECT *, sum(1 - up) OVER (ORDER BY day) AS run FROM u)
SELECT day::VARCHAR AS day, n::BIGINT AS n, (sum(up) OVER (PARTITION BY run ORDER BY day))::BIGINT AS streak, least(9, 3 * sum(up) OVER (PARTITION BY run ORDER BY day))::BIGINT AS bonus FROM r""")
def rise_streak(spark, sf_dir):
    """Consecutive rises of a daily count; the series has a row per day."""
    return rises(daily(spark, sf_dir).withColumn("all", F.lit(1)), ["all"], "day", "n").select(F.col("day").cast("string").alias("day"), "n", "streak", F.col("bonus").cast("long").alias("bonus"))


@query(f"WITH d AS ({DAILY}) SELECT day::VARCHAR AS day, (n - lag(n) OVER (ORDER BY day))::BIGINT AS delta FROM d")
def day_delta(spark, sf_dir):
    """W6."""
    w = Window.partitionBy(F.lit(1)).orderBy("day")
    return daily(spark, sf_dir).select(F.col("day").cast("string").alias("day"), (F.col("n") - F.lag("n").over(w)).alias("delta"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2), g AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM d),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day) AS island FROM g)
SELECT user_id, island::BIGINT AS island, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, sum(n)::BIGINT AS n FROM s GROUP BY 1, 2""")
def trend_segments(spark, sf_dir):
    """Runs of days without a gap."""
    d = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    s = islands(d, ["user_id"], "day", F.date_diff("day", "_before") > 1)
    return s.groupBy("user_id", "island").agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.sum("n").alias("n"))


@query("""WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_nationkey, c_custkey FROM r WHERE rn <= greatest(1, ceil(0.25 * n))""")
def top_quartile_publishers(spark, sf_dir):
    """W8 R6."""
    return top_quartile(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey")


@query("""SELECT s_suppkey, s_nationkey, (ntile(4) OVER w)::INT AS tile, (dense_rank() OVER w)::INT AS dense, round(percent_rank() OVER w, 6) AS pct FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)""")
def analytic_ranks(spark, sf_dir):
    """Ranks that come with Spark."""
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.ntile(4).over(w).alias("tile"), F.dense_rank().over(w).alias("dense"), F.round(F.percent_rank().over(w), 6).alias("pct"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_total_order(spark, sf_dir):
    """K1."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, n FROM (SELECT c_custkey, c_mktsegment, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, n DESC, c_custkey LIMIT 30""")
def case_priority_order(spark, sf_dir):
    """K3 K4: order by a CASE, then a count joined in, then the key."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    return c.orderBy(place, F.desc("n"), "c_custkey").limit(30).select("c_custkey", "n")


@query("""SELECT c_custkey, last FROM (SELECT c_custkey, max(o_totalprice) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1) ORDER BY last ASC NULLS LAST, c_custkey LIMIT 1000""")
def nulls_last_order(spark, sf_dir):
    """K5."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("last"))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").orderBy(F.asc_nulls_last("last"), "c_custkey").limit(1000).select("c_custkey", "last")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2""")
def per_group_topn(spark, sf_dir):
    """K6: two per group."""
    return first_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 40")
def priority_queue(spark, sf_dir):
    """K7: priority, then first come."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(40).select("o_orderkey")


@query("SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def union_all_arms(spark, sf_dir):
    """U1."""
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 2")
def intersect_sets(spark, sf_dir):
    """U5."""
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_quantity > 49").select(F.col("l_partkey").alias("k")).intersect(li.where("l_quantity < 2").select("l_partkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def except_sets(spark, sf_dir):
    """U5."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("SELECT l_suppkey AS source, min(l_orderkey) AS first FROM lineitem GROUP BY 1")
def ordered_dedup(spark, sf_dir):
    """U4: the first of each key in order."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.min("l_orderkey").alias("first"))


def _versions(spark, sf_dir):
    """Orders as stored rows, and later sights of some of them."""
    o = table(spark, sf_dir, "orders")
    stored = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("body"), F.col("o_totalprice").alias("published"), (F.col("o_orderstatus") == "F").alias("is_saved"))
    incoming = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("new").alias("title"), F.concat("o_orderstatus", F.lit("+")).alias("body"), F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.lit(1.0)).alias("published"), F.lit(False).alias("is_saved"), F.lit(1).alias("seen_at"))
    return stored, incoming


VERSIONS_SQL = """s AS (SELECT o_orderkey AS id, o_orderpriority AS title, o_orderstatus AS body, o_totalprice AS published, o_orderstatus = 'F' AS is_saved FROM orders WHERE o_orderkey % 3 <> 0),
i AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'new' END AS title, o_orderstatus || '+' AS body, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1.0::DOUBLE END AS published FROM orders WHERE o_orderkey % 2 = 0)"""


@query(f"""WITH {VERSIONS_SQL} SELECT coalesce(s.id, i.id) AS id, coalesce(nullif(i.title, ''), s.title) AS title, CASE WHEN length(i.body) >= coalesce(length(s.body), -1) THEN i.body ELSE s.body END AS body,
coalesce(i.published, s.published) AS published, coalesce(s.is_saved, false) AS is_saved FROM s FULL JOIN i ON s.id = i.id""")
def upsert_merge(spark, sf_dir):
    """M1: a merge column by column."""
    return upsert(*_versions(spark, sf_dir), "id")


@query(f"WITH {VERSIONS_SQL} SELECT id, body FROM s UNION ALL SELECT id, body FROM i WHERE id NOT IN (SELECT id FROM s)")
def insert_ignore(spark, sf_dir):
    """M2."""
    s, i = _versions(spark, sf_dir)
    return insert_or_ignore(s.select("id", "body"), i.select("id", "body"), "id")


@query(f"WITH {VERSIONS_SQL} SELECT id, body FROM i UNION ALL SELECT id, body FROM s WHERE id NOT IN (SELECT id FROM i)")
def insert_replace(spark, sf_dir):
    """M2."""
    s, i = _versions(spark, sf_dir)
    return insert_or_replace(s.select("id", "body"), i.select("id", "body"), "id")


@query(f"WITH {VERSIONS_SQL} SELECT id FROM i WHERE id NOT IN (SELECT id FROM s WHERE is_saved)")
def tombstone_suppression(spark, sf_dir):
    """M3."""
    s, i = _versions(spark, sf_dir)
    return without_tombstones(i, s.where("is_saved"), "id").select("id")


@query("""WITH v AS (SELECT user_id AS id, event_id, event_type AS title, props AS body, value AS published, row_number() OVER w AS version, lag(event_type) OVER w AS t, lag(props) OVER w AS b, lag(value) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT *, (CASE WHEN title IS DISTINCT FROM t THEN 1 ELSE 0 END + CASE WHEN body IS DISTINCT FROM b THEN 2 ELSE 0 END + CASE WHEN published IS DISTINCT FROM p THEN 4 ELSE 0 END)::INT AS changed FROM v)
SELECT id, event_id, changed, b AS previous_text, version::INT AS version FROM c WHERE version > 1 AND changed > 0""")
def revision_log(spark, sf_dir):
    """M4: changes between consecutive versions."""
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.col("event_type").alias("title"), F.col("props").alias("body"), F.col("value").alias("published"))
    return revisions(v, "id", "event_id")


@query("""WITH o AS (SELECT o_orderkey AS id, date_diff('day', o_orderdate::DATE, DATE '2001-08-01') AS age, o_orderstatus AS st FROM orders) SELECT id FROM o WHERE NOT (age > 365 AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 48))""")
def retention_prune(spark, sf_dir):
    """M5: old rows go unless something refers to them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_diff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate")).alias("age"))
    kept, _ = prune(o, "id", "age", 365, table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.col("l_orderkey").alias("id")))
    return kept.select("id")


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS id, s_suppkey // 2 AS into_ FROM supplier WHERE s_suppkey >= 2 AND s_suppkey % 7 <> 0), w AS (SELECT id, into_ AS target FROM p UNION ALL SELECT w.id, p.into_ FROM w JOIN p ON p.id = w.target)
SELECT id, min(target) AS target FROM w GROUP BY 1""")
def merge_forwarding(spark, sf_dir):
    """M6: where forwarding pointers end."""
    p = table(spark, sf_dir, "supplier").where("s_suppkey >= 2 AND s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("id"), F.expr("s_suppkey div 2").alias("merged_into"))
    return forwarded(p)


@query("""WITH b AS (SELECT l_orderkey AS event, count(DISTINCT l_suppkey) AS publishers, max(l_linenumber) AS escalation FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1), n AS (SELECT l_orderkey AS event, count(DISTINCT l_suppkey) AS publishers, max(l_linenumber) AS escalation FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-07-01' GROUP BY 1)
SELECT n.event, (CASE WHEN b.event IS NULL THEN 0 WHEN n.publishers > b.publishers THEN 1 WHEN n.escalation > b.escalation THEN 2 WHEN n.escalation < b.escalation THEN 3 END)::INT AS kind, n.event AS position FROM n LEFT JOIN b ON n.event = b.event
WHERE b.event IS NULL OR n.publishers > b.publishers OR n.escalation <> b.escalation ORDER BY kind, position, n.event LIMIT 5""")
def edition_since_last(spark, sf_dir):
    """M7: the five first changes since the last edition."""
    li = table(spark, sf_dir, "lineitem")
    side = lambda day: li.where(f"l_shipdate < timestamp'{day}'").groupBy(F.col("l_orderkey").alias("event")).agg(F.count_distinct("l_suppkey").alias("publishers"), F.max("l_linenumber").alias("escalation")).withColumn("position", F.col("event"))
    return edition_changes(side("1998-06-01"), side("1998-07-01"))


@query("""SELECT l_orderkey AS event, (count(*) FILTER (WHERE l_linenumber > 2))::BIGINT AS updates FROM lineitem GROUP BY 1""")
def seen_updates(spark, sf_dir):
    """M8: members that joined after the version last seen."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(F.count_if(F.col("l_linenumber") > 2).alias("updates"))


@query("""SELECT doc_id FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id < 500) """)
def input_hash_stale(spark, sf_dir):
    """M9: rows whose input isn't among those processed; digests are compared, not texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return d.join(d.where("doc_id < 500").select("h"), "h", "left_anti").select("doc_id")
