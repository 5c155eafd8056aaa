"""Merges of stored and incoming rows, revisions, tombstones, pruning and forwarding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import checkpointed
from .windows import first_rows


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Merge by key, column by column.

    ``title``: the incoming one unless empty. ``body``: the longer one. ``published``: the incoming one
    unless unknown. ``is_saved``: once true, stays true. Several incoming rows of one key: the latest
    ``seen_at`` counts. Rows on one side only stay as they are.
    """
    fresh = first_rows(incoming, [key], [F.desc("seen_at"), F.desc_nulls_last("body")])
    s, i = stored.alias("s"), fresh.alias("i")
    longer = F.when(F.length("i.body") >= F.coalesce(F.length("s.body"), F.lit(-1)), F.col("i.body")).otherwise(F.col("s.body"))
    return s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer").select(
        F.coalesce(f"s.{key}", f"i.{key}").alias(key),
        F.coalesce(F.nullif("i.title", F.lit("")), "s.title").alias("title"),
        longer.alias("body"),
        F.coalesce("i.published", "s.published").alias("published"),
        (F.coalesce("s.is_saved", F.lit(False)) | F.coalesce("i.is_saved", F.lit(False))).alias("is_saved"),
    )


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows, and incoming rows of keys that aren't stored."""
    return stored.unionByName(incoming.join(stored.select(key), key, "left_anti"))


def insert_or_replace(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows, and stored rows of keys that aren't incoming."""
    return incoming.unionByName(stored.join(incoming.select(key), key, "left_anti"))


def without_tombstones(incoming: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return incoming.join(tombstones.select(key), key, "left_anti")


#: Bits of a revision's changed fields.
CHANGED = {"title": 1, "body": 2, "published": 4}
PREVIOUS_CHARS = 50_000


def revisions(versions: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each change between consecutive versions: which fields, and the text before (a stored prefix)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    bits = sum((F.when(~F.col(c).eqNullSafe(F.lag(c).over(w)), b).otherwise(0) for c, b in CHANGED.items()), F.lit(0))
    rows = versions.select(key, order, bits.alias("changed"), F.left(F.lag("body").over(w), F.lit(PREVIOUS_CHARS)).alias("previous_text"), F.row_number().over(w).alias("version"))
    return rows.where("version > 1 AND changed > 0")


def prune(rows: DataFrame, key: str, age: str, days: int, protected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, tombstones): rows older than ``days`` go unless protected."""
    old = rows.where(F.col(age) > days).join(protected.select(key), key, "left_anti")
    return rows.join(old.select(key), key, "left_anti"), old.select(key)


def forwarded(pointers: DataFrame) -> DataFrame:
    """(id, target): where chains of (id → merged_into) end, by pointer doubling.

    Each round doubles the steps that a row has gone and the least id it met on them. Chains that end
    stop moving; what still moves after as many rounds as the number of pointers has binary digits goes
    round in a circle, has gone round it in full, and ends at the circle's smallest id. An id has one
    pointer. Every round is checkpointed.
    """
    now = checkpointed(pointers.select("id", F.col("merged_into").alias("target"), F.col("merged_into").alias("least")))
    for _ in range(now.count().bit_length() + 1):
        after = now.select(F.col("id").alias("target"), F.col("target").alias("next"), F.col("least").alias("beyond"))
        step = now.join(after, "target", "left")
        step = checkpointed(step.select("id", F.coalesce("next", "target").alias("target"), F.least("least", "beyond").alias("least"), F.col("next").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now.select("id", "target")
    # Rows that still move stand inside a circle; the least id on their way round it is the circle's.
    inside = now.select(F.col("id").alias("target"), F.col("least").alias("ring"))
    return now.join(inside, "target", "left").select("id", F.coalesce("ring", "target").alias("target"))


def edition_changes(before: DataFrame, now: DataFrame, limit: int = 5) -> DataFrame:
    """What changed between two editions' (event, publishers, escalation, position): new, more coverage, escalation, easing."""
    b, n = before.alias("b"), now.alias("n")
    kind = (
        F.when(F.col("b.event").isNull(), 0)
        .when(F.col("n.publishers") > F.col("b.publishers"), 1)
        .when(F.col("n.escalation") > F.col("b.escalation"), 2)
        .when(F.col("n.escalation") < F.col("b.escalation"), 3)
    )
    rows = b.join(n, F.col("b.event") == F.col("n.event"), "full_outer").where("n.event IS NOT NULL").select(F.col("n.event").alias("event"), kind.alias("kind"), F.col("n.position").alias("position"))
    return rows.where("kind IS NOT NULL").orderBy("kind", "position", "event").limit(limit)
