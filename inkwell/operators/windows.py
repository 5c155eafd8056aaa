"""Window operators: first rows, runs, streaks, quartiles, trailing counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps n a partition before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def top_quartile(df: DataFrame, keys: list[str], weight: str, id_col: str) -> DataFrame:
    """The heaviest quarter of each group's rows, one at least."""
    group = Window.partitionBy(*keys)
    rank = F.row_number().over(group.orderBy(F.desc(weight), F.asc(id_col)))
    keep = F.greatest(F.lit(1), F.ceil(0.25 * F.count("*").over(group)))
    return df.withColumns({"_rank": rank, "_keep": keep}).where("_rank <= _keep").drop("_rank", "_keep")


def islands(df: DataFrame, keys: list[str], order: str, gap: Column) -> DataFrame:
    """Add ``island``: numbers runs of rows, a new one where ``gap`` (over the row and ``_before``, the previous order value) holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_before", F.lag(order).over(w))
    marked = marked.withColumn("_new", F.when(F.col("_before").isNull() | gap, 1).otherwise(0))
    return marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_before", "_new")


def rises(df: DataFrame, keys: list[str], order: str, value: str, cap: int = 9, step: int = 3) -> DataFrame:
    """Add ``streak``, the number of consecutive rises up to each row, and ``bonus`` = min(cap, step * streak)."""
    w = Window.partitionBy(*keys).orderBy(order)
    up = df.withColumn("_up", F.coalesce((F.col(value) > F.lag(value).over(w)).cast("int"), F.lit(0)))
    up = up.withColumn("_run", F.sum(1 - F.col("_up")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return up.withColumn("streak", F.sum("_up").over(runs)).withColumn("bonus", F.least(F.lit(cap), step * F.col("streak"))).drop("_up", "_run")


def trailing(keys: list[str], seconds: str, length: int):
    """The window of the last ``length`` seconds up to each row."""
    return Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-length, 0)


def trailing_distinct(df: DataFrame, key: str, value: str, seconds: str, length: int) -> DataFrame:
    """(key, seconds, n): for each second of a key that has rows, the distinct values in the last ``length`` seconds up to it, that second included.

    A value counts from a row of it until ``length`` seconds after, so it adds one where such a stretch begins and takes one away
    behind its end; no row looks back over others. Changes are summed by key and second, then by stretches of ``length`` seconds
    whose rows are at most one a second, so a hot key is dealt by time. Null keys and seconds have no row, null values count nothing.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(seconds).isNotNull()).select(key, value, F.col(seconds).cast("long").alias("_at"))
    w = Window.partitionBy(key, value).orderBy("_at")
    seen = rows.where(F.col(value).isNotNull()).distinct().withColumns({"_before": F.lag("_at").over(w), "_next": F.lead("_at").over(w)})
    begins = F.when(F.col("_before").isNull() | (F.col("_at") - F.col("_before") > length), F.struct(F.col("_at").alias("at"), F.lit(1).alias("by")))
    ends = F.when(F.col("_next").isNull() | (F.col("_next") - F.col("_at") > length), F.struct((F.col("_at") + length + 1).alias("at"), F.lit(-1).alias("by")))
    changes = seen.select(key, F.explode(F.array_compact(F.array(begins, ends))).alias("c")).select(key, F.col("c.at").alias("_at"), F.col("c.by").alias("_by"), F.lit(False).alias("_own"))
    asked = rows.select(key, "_at", F.lit(0).alias("_by"), F.lit(True).alias("_own"))
    by_second = changes.unionByName(asked).groupBy(key, "_at").agg(F.sum("_by").alias("_by"), F.bool_or("_own").alias("_own")).withColumn("_slot", F.expr(f"_at div {length}"))
    until = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    held = by_second.groupBy(key, "_slot").agg(F.sum("_by").alias("_by")).select(key, "_slot", F.coalesce(F.sum("_by").over(until), F.lit(0)).alias("_held"))
    inside = F.sum("_by").over(Window.partitionBy(key, "_slot").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return by_second.withColumn("_in", inside).where("_own").join(held, [key, "_slot"]).select(key, F.col("_at").alias(seconds), (F.col("_held") + F.col("_in")).cast("long").alias("n"))


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], given: list[str], step: Callable, zero, schema: str, last: bool = False) -> DataFrame:
    """(keys, given, ``schema``): a fold over each key's rows in order, for what depends on earlier outcomes.

    ``step(state, values of given)`` returns the next state and the row's new values; None for these
    drops the row. With ``last`` only the keys and the last row's new values come out. Keys are dealt to tasks and
    sorted there, so a task streams its rows and holds one state, however long a key's history is.
    """
    names = [*keys, *given]
    kept = keys if last else names
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    types = dict(df.dtypes)
    out = ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"`{n}` {t}" for n, t in fields)])
    made_schema = df.select(*kept).limit(0).selectExpr("*", *(f"CAST(NULL AS {t}) AS `{n}`" for n, t in fields)).toArrow().schema
    n_keys = len(keys)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held = None, None, None
        for b in it:
            rows = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:n_keys] != key:
                    if last and key is not None:
                        rows.append((*key, *held))
                    key, state = row[:n_keys], zero
                state, new = step(state, row[n_keys:])
                if last:
                    held = new
                elif new is not None:
                    rows.append((*row, *new))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), made_schema, strict=True)], schema=made_schema)
        if last and key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, *held), made_schema, strict=True)], schema=made_schema)

    dealt = df.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, *order)
    return dealt.select(*names).mapInArrow(batches, out)
