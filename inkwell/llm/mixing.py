"""Mixing sources to target weights by a Pfair schedule, with DataFrame functions only.

Time runs in slots of one block. With weight w, block j of a source (from 0) is released at slot
floor(j / w) and due by slot ceil((j + 1) / w); the earliest deadline among the released blocks
runs next. Weights are whole shares of a period, so the schedule of one period, a table with one
row per slot, repeats for ever, and the slot of any block follows from its number alone.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents

#: Documents to a block.
BLOCK = 32
#: Slots of a period: at least, and at most. The latter bounds the schedule that is broadcast.
PERIOD, MAX_PERIOD = 1000, 1 << 17
#: Slots that the smallest weight has in a period, as far as MAX_PERIOD allows: its rounding is within one part in twice as many.
FINE = 8
#: Sources with a stream of their own: those with the largest weights. All further ones share one stream.
STREAMS = 4096
#: Name of the stream that the sources beyond STREAMS share.
REST = "(further sources)"
#: Ranges of the hash order that rows of one stream are numbered in; a third of all rows in one source is spread over all of them.
LANES = 256
#: Columns that a schedule adds.
ADDED = ("mix_source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_order")


def period_of(weights: dict[str, float]) -> int:
    """Slots enough for every weight to have its true share within 1 / (2 FINE), MAX_PERIOD at most."""
    total = sum(weights.values())
    return min(MAX_PERIOD, max(PERIOD, math.ceil(FINE * total / min(weights.values()))))


def shares(weights: dict[str, float], period: int | None = None) -> dict[str, int]:
    """Whole shares of a period by largest remainder; positive weights only, and one slot at least for each."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    period = period or period_of(weights)
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources don't fit a period of {period} slots; raise period")
    total = sum(weights.values())
    exact = {s: period * w / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    gap = period - sum(out.values())
    for s in sorted(weights, key=lambda s: (out[s] - exact[s], s))[: max(gap, 0)]:
        out[s] += 1
    while gap < 0:  # sources lifted to one slot take it from the largest
        s = max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -1.0, s))
        out[s] -= 1
        gap += 1
    return out


def period_slots(parts: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block of the period, release, deadline, slot) of one period, earliest deadline first among the released."""
    period = sum(parts.values())
    jobs = []
    for source, share in parts.items():
        for j in range(share):
            jobs.append((j * period // share, -((-(j + 1) * period) // share), source, j))
    jobs.sort()
    ready, out, at = [], [], 0
    for slot in range(period):
        while at < len(jobs) and jobs[at][0] <= slot:
            release, deadline, source, j = jobs[at]
            heapq.heappush(ready, (deadline, source, j, release))
            at += 1
        deadline, source, j, release = heapq.heappop(ready)
        out.append((source, j, release, deadline, slot))
    return out


def number_within(df: DataFrame, group_col: str, order_col: str, ties: list) -> DataFrame:
    """Add ``nth`` (from 0): the row's number within its group by ``order_col``, a hex digest.

    A group is numbered in LANES ranges of the digest's first byte, then ranges are stacked by
    their counts, so the largest group is spread over that many tasks. There are STREAMS + 1 groups
    at most, which bounds the table of counts that is broadcast.
    """
    laned = df.withColumn("_lane", F.conv(F.substring(order_col, 1, 2), 16, 10).cast("int") % LANES)
    counts = laned.groupBy(group_col, "_lane").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group_col).orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group_col).alias("_g"), F.col("_lane").alias("_l"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(group_col, "_lane").orderBy(order_col, *ties))
    numbered = laned.withColumn("_k", inside)
    joined = numbered.join(F.broadcast(counts), (F.col(group_col) == F.col("_g")) & (F.col("_lane") == F.col("_l")))
    return joined.withColumn("nth", F.col("_base") + F.col("_k") - 1).drop("_lane", "_l", "_g", "_k", "_base")


def _values(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as SQL values."""
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v}L"
    body = ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({schema})")


def default_weights(counts: DataFrame, power: float = 0.5) -> dict[str, float]:
    """Each source's row count to a power below one, as is usual to lift small sources.

    The STREAMS largest sources are read, and the sum over all others, which share the stream REST.
    """
    name, n = counts.columns
    weighed = counts.select(F.col(name).alias("s"), F.pow(F.col(n).cast("double"), F.lit(power)).alias("w"))
    top = weighed.orderBy(F.desc("w"), "s").limit(STREAMS).collect()
    weights = {r.s: r.w for r in top}
    if len(top) == STREAMS:
        left = weighed.agg(F.sum("w").alias("w"), F.count("*").alias("n")).first()
        if left.n > STREAMS:
            weights[REST] = max(left.w - sum(weights.values()), min(weights.values()))
    return weights


def _scheduled(df: DataFrame, weights: dict[str, float] | None, block: int, period: int | None, id_col: str, source_col: str) -> DataFrame:
    """(row, mix_...): the rows of ``df``, each as one struct so that its names can't clash, with their schedule."""
    spark = df.sparkSession
    rows = df.select(F.struct(*df.columns).alias("row"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"), F.col(id_col).alias("_id"), F.xxhash64(*df.columns).alias("_all"))
    # Null and repeated ids with other columns that differ are dealt by these.
    rows = rows.withColumn("mix_order", F.md5(F.when(F.col("_id").isNull(), F.concat(F.lit(":"), F.col("_all").cast("string"))).otherwise(F.col("_id").cast("string"))))
    if weights is None:
        weights = default_weights(rows.groupBy("mix_source").agg(F.count("*").alias("n")))
        if REST in weights:
            own = _values(spark, [(s,) for s in weights], "_own")
            rows = rows.join(F.broadcast(own), F.col("mix_source") == F.col("_own"), "left").withColumn("mix_source", F.coalesce("_own", F.lit(REST))).drop("_own")
    elif missing := rows.select("mix_source").distinct().where(~F.col("mix_source").isin(list(weights))).limit(3).collect():
        raise ValueError(f"no target weight for sources {[r[0] for r in missing]}")
    if not weights:
        empty = F.lit(None).cast("long")
        return rows.withColumns({c: empty for c in ADDED[1:5]}).where(F.lit(False)).select("row", *ADDED)
    parts = shares(weights, period)
    turn_slots, slots_of = sum(parts.values()), {s: [] for s in parts}
    for s, _, _, _, t in period_slots(parts):
        slots_of[s].append(str(t))
    streams = _values(spark, [(s, k, ",".join(slots_of[s])) for s, k in parts.items()], "_s, _share, _slots")
    # One row per slot of a period: bounded by MAX_PERIOD, whatever the data. Release and deadline are closed forms.
    slots = streams.select("_s", F.posexplode(F.split("_slots", ",").cast("array<long>")).alias("_j", "_t"))
    numbered = number_within(rows, "mix_source", "mix_order", [F.asc_nulls_first("_id"), "_all"])
    numbered = numbered.withColumn("mix_block", F.expr(f"nth div {block}L"))
    sized = numbered.join(F.broadcast(streams.select(F.col("_s").alias("_of"), "_share")), F.col("mix_source") == F.col("_of"))
    joined = sized.join(F.broadcast(slots), (F.col("mix_source") == F.col("_s")) & (F.col("mix_block") % F.col("_share") == F.col("_j")))
    made = joined.withColumns({
        "mix_release": F.expr(f"mix_block * {turn_slots}L div _share"),
        "mix_deadline": F.expr(f"((mix_block + 1) * {turn_slots}L + _share - 1) div _share"),
        "mix_slot": F.expr(f"_t + (mix_block div _share) * {turn_slots}L"),
    })
    return made.select("row", *ADDED)


def schedule(df: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Add ``mix_source, mix_block, mix_release, mix_deadline, mix_slot, mix_order`` to every row of ``df``.

    Order by (mix_slot, mix_order) to read the mix. Every row is kept: a source that runs out leaves
    its slots empty and the others go on in their order. While all sources last, each has run within
    one block of its weight at every slot. Without weights, of more than STREAMS sources the smallest
    share one stream, which takes their rows in hash order. Null sources form the source ''; repeated
    rows are numbered one after the other; an empty table stays empty; sources without a weight raise.
    Columns of ``df`` may have any names; those named like the added ones give way to them.
    """
    made = _scheduled(df, weights, block, period, id_col, source_col)
    return made.select(*(F.col("row")[c].alias(c) for c in df.columns if c.lower() not in ADDED), *ADDED)


def mixed(df: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows of ``df`` with its own columns, in mixed order: range-partitioned and sorted by slot."""
    return _scheduled(df, weights, block, None, id_col, source_col).orderBy("mix_slot", "mix_order").select("row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, block, release, deadline and slot of every document under the default weights."""
    docs = documents(spark, sf_dir, "doc_id", "source")
    made = schedule(docs)
    return made.select("doc_id", "source", *(F.col(f"mix_{c}").alias(c) for c in ("block", "release", "deadline", "slot", "order")))
