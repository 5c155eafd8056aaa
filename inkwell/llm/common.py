"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of its own is set only where a local session, whose executors are the driver, names none;
    on a cluster that raises, as executors can't see a folder of the driver's machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Cuts the lineage (a lost executor costs no recomputation of what came before) and lets later
    steps read the rows as often as they need without repeating the work that made them.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/inkwell-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns asked for of the documents table; only they are read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def in_parts(it: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches of a task cut to ``rows`` rows, so that what Python makes of one at a time stays small."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
