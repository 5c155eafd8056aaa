"""Structured Streaming over event files: windows, late data, a stateful limiter, and a merge into a table.

Every job runs with ``availableNow``: it takes what is there in bounded micro-batches and stops, and its
checkpoint lets the next run go on from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.storage import shared_root

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Files of a micro-batch.
FILES = 64


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the folder that driver and executors share."""
    return f"{shared_root(spark)}/inkwell-{label}-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, glob: str, files: int = FILES) -> DataFrame:
    """Event files as a stream, with event time ``at``."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(glob).withColumn("at", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream to the end of what is there; its rows are written once each and read back.

    ``complete`` and ``update`` results are written per batch under the batch's number, which a
    repeated batch replaces, so that a restart writes nothing twice.
    """
    spark = stream.sparkSession
    out, state = shared_folder(spark, label), shared_folder(spark, f"{label}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    rows = spark.read.schema(f"{stream._jdf.schema().toDDL()}, batch int").option("basePath", out).parquet(out)
    if mode == "complete":  # the last batch holds the whole result
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == F.lit(last))
    return rows.drop("batch")


def tumbling_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n): events of each window; events later than ``late`` behind the newest are dropped."""
    g = stream.withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def sliding_counts(stream: DataFrame, width: str = "6 hours", step: str = "1 hour", late: str = "12 hours") -> DataFrame:
    g = stream.withWatermark("at", late).groupBy(F.window("at", width, step)).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("window.start").alias("start"), "n", "value")


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): sessions of a user, closed by a gap."""
    g = stream.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each event_id; state is dropped as the watermark passes."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


# Banners that a reader gets at most within half an hour and within an hour.
HALF_HOUR, HOUR = 3, 5


def allow(times: list[int], sent: list[int]) -> tuple[list[bool], list[int]]:
    """Which of the times (epoch seconds, in order) a limiter lets through after those ``sent``, and what it remembers."""
    out = []
    for t in times:
        sent = [s for s in sent if s > t - 3600]
        ok = len(sent) < HOUR and sum(s > t - 1800 for s in sent) < HALF_HOUR
        out.append(ok)
        if ok:
            sent.append(t)
    return out, sent


def limited(stream: DataFrame) -> DataFrame:
    """(user_id, event_id, allowed): each user's events through the limiter; state holds an hour's deliveries at most."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["sec", "event_id"])
        ok, sent = allow(rows["sec"].tolist(), list(state.get[0]) if state.exists else [])
        state.update((sent,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "allowed": ok})

    rows = stream.select("user_id", "event_id", F.unix_seconds("at").alias("sec"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", "sent array<long>", "append", GroupStateTimeout.NoTimeout)


def merge_into(stream: DataFrame, table: str, checkpoint: str, key: str, version: str) -> None:
    """Append each micro-batch's newest row of every key under the batch's number; ``latest`` reads the table.

    A batch that is run again after a failure replaces its own folder: every row arrives exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), version).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{table}/batch={number:08d}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def latest(spark: SparkSession, table: str, key: str, version: str) -> DataFrame:
    """The newest row of every key of a merged table; of equal versions the later batch's."""
    rows = spark.read.option("basePath", table).parquet(table)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(version, "batch")).alias("r")).select("r.*").drop("batch")
