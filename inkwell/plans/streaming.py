"""Streaming queries over the events table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.storage import frozen
from ..registry import query
from ..sources.tables import table
from ..streaming.events import deduplicated, latest, limited, merge_into, read_events, run, session_counts, shared_folder, sliding_counts, tumbling_counts


def _stream(spark, sf_dir):
    return read_events(spark, f"{sf_dir}/events.parque[t]")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """ST3 ST6: hourly counts by event time; nothing is late in one batch."""
    return run(tumbling_counts(_stream(spark, sf_dir)), "tumbling", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT date_trunc('hour', ts) - to_hours(k) AS start, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events, (SELECT unnest(range(0, 6)) AS k) GROUP BY 1""")
def stream_sliding(spark, sf_dir):
    """ST6: six-hour windows every hour."""
    made = run(sliding_counts(_stream(spark, sf_dir)), "sliding", "complete")
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("value", 4).alias("value"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    """ST6: sessions of users."""
    made = run(session_counts(_stream(spark, sf_dir)), "sessions", "complete")
    return made.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """ST2: rows that come twice pass once."""
    twice = _stream(spark, sf_dir)
    return run(deduplicated(twice.unionByName(_stream(spark, sf_dir))).select("event_id", "event_type"), "dedup")


@query()
def stream_limiter(spark, sf_dir):
    """ST4 R9: banners that each user's limiter lets through."""
    return run(limited(_stream(spark, sf_dir)), "limiter")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_merge(spark, sf_dir):
    """ST1 D3 M1: micro-batches merged into a table, the newest row of each key winning."""
    out = shared_folder(spark, "merged")
    rows = _stream(spark, sf_dir).select("user_id", "event_id", "ts", F.struct("ts", "event_id").alias("version"))
    merge_into(rows, out, shared_folder(spark, "merge-state"), "user_id", "version")
    return latest(spark, out, "user_id", "version").select("user_id", "ts", "event_id")


@query("""SELECT ts::DATE AS day, count(*) FILTER (WHERE event_id % 3 > 0)::BIGINT AS n, count(DISTINCT user_id) FILTER (WHERE event_id % 3 > 0)::BIGINT AS readers FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_id % 3 > 0) > 0
UNION ALL SELECT ts::DATE, count(*)::BIGINT, count(DISTINCT user_id)::BIGINT FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_id % 3 > 0) = 0""")
def edition_freeze(spark, sf_dir):
    """ST5: each day's edition as first frozen. A second run with late rows freezes the days that the first had not and reads the others unchanged."""
    root = shared_folder(spark, "editions")
    editions = lambda e: e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("readers"))
    events = table(spark, sf_dir, "events")
    frozen(editions(events.where("event_id % 3 > 0")), root, "day")
    return frozen(editions(events), root, "day")
