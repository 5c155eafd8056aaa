"""Checkpoints and written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of its own only where a local session names none. On a cluster that raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder, for steps that read it more than once."""
    path = f"{shared_root(df.sparkSession)}/inkwell-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frozen(df: DataFrame, root: str, key: str) -> DataFrame:
    """The write-once table under ``root``, after freezing the rows of ``df`` whose ``key`` it does not hold yet.

    The rows of each new key are written to a folder beside the table and moved to their place by one rename that fails
    where the place is taken: the first writer wins, and a later run, or one that comes second, reads what the first wrote
    whatever its own rows are. A run that dies before the rename leaves nothing of the key. ``key`` is a column of whole
    numbers, text or days; a null key is not frozen. There is one rename a new key, as editions come one a day.
    """
    spark = df.sparkSession
    files, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    place = lambda p: files.Path(p)
    fs = place(root).getFileSystem(conf)
    rows = df.where(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("string"))
    held = []
    if fs.exists(place(root)):
        held = [unquote(s.getPath().getName()[5:]) for s in fs.listStatus(place(root)) if s.getPath().getName().startswith("held=")]
    fresh = rows if not held else rows.join(spark.createDataFrame([(h,) for h in held], "_key string"), "_key", "left_anti")
    staging = f"{root.rstrip('/')}-staging-{uuid.uuid4().hex}"
    fresh.write.partitionBy("_key").parquet(staging)
    fs.mkdirs(place(root))
    context = files.FileContext.getFileContext(place(root).toUri(), conf)
    careful = spark.sparkContext._gateway.new_array(files.Options.Rename, 0)
    for s in fs.listStatus(place(staging)):
        name = s.getPath().getName()
        if name.startswith("_key="):
            try:
                context.rename(s.getPath(), place(f"{root.rstrip('/')}/held={name[5:]}"), careful)
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception) and "already exists" not in str(e.java_exception):
                    raise
    fs.delete(place(staging), True)
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(root)
