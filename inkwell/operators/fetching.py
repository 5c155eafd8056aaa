"""Which due feeds are requested at once: two limits and hosts that asked to be left alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import first_rows

#: Requests at once of a fetcher, and of it to one host.
IN_ALL, PER_HOST = 6, 2


def cooldowns(refusals: DataFrame) -> DataFrame:
    """(fetcher, host, until): how long each host is left alone, from refusals (fetcher, host, at, wait): the longest ask holds, a later, shorter one never shortens it."""
    return refusals.groupBy("fetcher", "host").agg(F.max(F.col("at") + F.col("wait")).alias("until"))


def paused(feeds: DataFrame, waits: DataFrame, now: int) -> DataFrame:
    """Feeds (fetcher, host, feed, due, retry_at) with ``until``: the later of their own retry and their host's cooldown where that is after ``now``, else null."""
    joined = feeds.join(waits, ["fetcher", "host"], "left")
    until = F.greatest(F.coalesce("retry_at", F.lit(now)), F.coalesce("until", F.lit(now)))
    return joined.withColumn("until", F.when(until > now, until))


def fetch_waves(feeds: DataFrame, waits: DataFrame, now: int, in_all: int = IN_ALL, per_host: int = PER_HOST) -> DataFrame:
    """(fetcher, feed, place): the requests that each fetcher starts at ``now``, in order of ``due`` and feed.

    A feed starts if it is not paused, fewer than ``per_host`` of its host start before it, and fewer than ``in_all`` in all:
    a host at its limit is passed over and holds up nothing behind it. Both limits are windows that keep their first rows
    before the shuffle, so a host or fetcher with very many feeds costs no more than a few rows a task.
    """
    open_ = paused(feeds.where(F.col("due") <= now), waits, now).where("until IS NULL")
    of_host = first_rows(open_, ["fetcher", "host"], [F.asc("due"), F.asc("feed")], per_host)
    place = F.row_number().over(Window.partitionBy("fetcher").orderBy("due", "feed"))
    return of_host.withColumn("place", place).where(F.col("place") <= in_all).select("fetcher", "feed", "place")
