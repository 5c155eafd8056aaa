"""Maintenance of events: create, add, remove, merge, split, include, separate, and a new partition after a rule change.

A state is three tables: ``events`` (event, version, merged_into, seen_version), ``members`` (article,
event, joined_version) with one row per article, and ``verdicts`` (a, b, include, at), a < b. Each function takes a batch of orders,
one per event touched, and returns the next state; every change of an event's members raises its version by one.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merging import forwarded


class State(NamedTuple):
    events: DataFrame
    members: DataFrame
    verdicts: DataFrame


def live(state: State, ids: DataFrame, column: str) -> DataFrame:
    """``ids`` with ``column`` replaced by the event that its merges end at; unknown events give no row."""
    ends = forwarded(state.events.where("merged_into IS NOT NULL").select(F.col("event").alias("id"), "merged_into"))
    j = ids.join(ends.select(F.col("id").alias(column), F.col("target").alias("_end")), column, "left").withColumn(column, F.coalesce("_end", column)).drop("_end")
    return j.join(state.events.where("merged_into IS NULL").select(F.col("event").alias(column)), column, "left_semi")


def _raised(state: State, changed: DataFrame) -> DataFrame:
    """Events with the versions of ``changed`` (event) one higher."""
    touched = changed.select("event").distinct().withColumn("_up", F.lit(1))
    return state.events.join(touched, "event", "left").withColumn("version", F.col("version") + F.coalesce("_up", F.lit(0))).drop("_up")


def _moved(state: State, moves: DataFrame) -> State:
    """The state after articles (article, event) have moved: both the event they join and the one they leave change."""
    j = moves.select("article", F.col("event").alias("_to")).join(state.members.select("article", F.col("event").alias("_from")), "article", "left")
    real = j.where("_from IS NULL OR _from <> _to")
    events = _raised(state, real.select(F.col("_to").alias("event")).union(real.where("_from IS NOT NULL").select("_from")))
    versions = events.select(F.col("event").alias("_to"), F.col("version").alias("_v"))
    new = real.join(versions, "_to").select("article", F.col("_to").alias("event"), F.col("_v").alias("joined_version"))
    return state._replace(events=events, members=state.members.join(real, "article", "left_anti").unionByName(new))


def create(state: State, orders: DataFrame) -> State:
    """New events with articles (event, article) under ids of their own; articles of other events move here."""
    made = orders.select("event").distinct().join(state.events, "event", "left_anti")
    rows = made.select("event", F.lit(0).cast("long").alias("version"), F.lit(None).cast(state.events.schema["event"].dataType).alias("merged_into"), F.lit(None).cast("long").alias("seen_version"))
    return _moved(state._replace(events=state.events.unionByName(rows)), orders.join(made, "event"))


def add(state: State, orders: DataFrame) -> State:
    """Articles (event, article) join live events, wherever they were."""
    return _moved(state, live(state, orders, "event"))


def remove(state: State, orders: DataFrame) -> State:
    """Articles (event, article) leave an event; one left empty keeps its id. Others' members stay."""
    gone = live(state, orders, "event").join(state.members.select("article", "event"), ["article", "event"])
    return state._replace(events=_raised(state, gone), members=state.members.join(gone, ["article", "event"], "left_anti"))


def merge(state: State, orders: DataFrame) -> State:
    """Events ``absorbed`` go into ``survivor``, with all members; the absorbed id forwards there, one step deep.

    ``absorbed_version`` and ``survivor_version`` are those that the caller saw (null: any): an order whose events have changed is refused.
    """
    o = live(state, live(state, orders, "absorbed"), "survivor").where("absorbed <> survivor")
    v = state.events.select("event", "version")
    o = o.join(v.toDF("absorbed", "_a"), "absorbed").join(v.toDF("survivor", "_s"), "survivor")
    o = o.where("coalesce(absorbed_version, _a) = _a AND coalesce(survivor_version, _s) = _s").select("absorbed", "survivor")
    moves = state.members.select("article", F.col("event").alias("absorbed")).join(o, "absorbed").select("article", F.col("survivor").alias("event"))
    # The absorbed event changes even where it held nothing.
    empty = o.join(state.members.select(F.col("event").alias("absorbed")), "absorbed", "left_anti").select(F.col("absorbed").alias("event"))
    after = _moved(state._replace(events=_raised(state, empty)), moves)
    to = o.select(F.col("absorbed").alias("_of"), F.col("survivor").alias("_to"))
    e = after.events.join(to, F.coalesce("merged_into", "event") == F.col("_of"), "left").withColumn("merged_into", F.coalesce("_to", "merged_into"))
    return after._replace(events=e.drop("_of", "_to"))


def split(state: State, orders: DataFrame) -> State:
    """Some but not all members of ``source`` (source, event, article) go to the new event ``event``; other orders change nothing."""
    o = live(state, orders, "source").join(state.members.select("article", F.col("event").alias("source")), ["article", "source"])
    moving = o.groupBy("source", "event").agg(F.count("*").alias("_n"))
    asked = orders.groupBy("event").agg(F.count_distinct("article").alias("_asked"))
    held = state.members.groupBy(F.col("event").alias("source")).agg(F.count("*").alias("_all"))
    good = moving.join(asked, "event").join(held, "source").where("_n = _asked AND _n < _all").select("source", "event")
    return create(state, o.join(good, ["source", "event"]).select("event", "article"))


def include(state: State, orders: DataFrame, at: int, size: int = 100) -> State:
    """A reader's "same event": ``source`` goes into ``target`` and every pair across them is kept together from now on.

    Newer verdicts replace older ones of a pair. The combined event counts as seen. Orders over ``size`` articles in all are refused.
    """
    o = live(state, live(state, orders.select("source", "target"), "source"), "target").where("source <> target")
    n = state.members.groupBy("event").agg(F.count("*").alias("n"))
    o = o.join(n.toDF("source", "ns"), "source").join(n.toDF("target", "nt"), "target").where(F.col("ns") + F.col("nt") <= size).select("source", "target")
    m = state.members.select("article", "event")
    pairs = o.join(m.toDF("x", "source"), "source").join(m.toDF("y", "target"), "target")
    state = _judged(state, pairs.select("x", "y"), True, at)
    none = F.lit(None).cast("long")
    after = merge(state, o.select(F.col("source").alias("absorbed"), F.col("target").alias("survivor"), none.alias("absorbed_version"), none.alias("survivor_version")))
    seen = o.select(F.col("target").alias("event")).distinct().withColumn("_seen", F.lit(True))
    e = after.events.join(seen, "event", "left").withColumn("seen_version", F.when(F.col("_seen"), F.col("version")).otherwise(F.col("seen_version"))).drop("_seen")
    return after._replace(events=e)


def separate(state: State, orders: DataFrame, at: int) -> State:
    """A reader's "not the same event": the article (event, article) leaves, and stays apart from every other member."""
    o = live(state, orders, "event").join(state.members.select("article", "event"), ["article", "event"])
    rest = state.members.select(F.col("article").alias("y"), "event")
    pairs = o.select(F.col("article").alias("x"), "event").join(rest, "event").where("x <> y")
    return remove(_judged(state, pairs.select("x", "y"), False, at), o)


def _judged(state: State, pairs: DataFrame, together: bool, at: int) -> State:
    new = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return state._replace(verdicts=state.verdicts.join(new, ["a", "b"], "left_anti").unionByName(new.select("a", "b", F.lit(together).alias("include"), F.lit(at).cast("long").alias("at"))))


def regrouped(members: DataFrame, pairs: DataFrame, least: float = 0.45) -> DataFrame:
    """(event, article, part): how the rules part each event after a change of them; part 0 keeps the event's id.

    ``members``: event, article, at. ``pairs``: event, a, b, score, level, specific, conflict for every two members. In order of time,
    an article joins the first part that admits it: no conflict, a shared name with each, a match, two thirds compatible, a mean score of
    ``least``. An event has a hundred members at most, which bounds a group.
    """

    def part(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        told = {}
        for r in right.itertuples():
            told[r.a, r.b] = told[r.b, r.a] = r
        parts: list[list] = []
        for r in left.sort_values(["at", "article"]).itertuples():
            for p in parts:
                met = [told.get((r.article, m)) for m in p]
                known = [m for m in met if m is not None]
                ok = len(known) == len(met) and all(m.conflict is None and m.specific >= 1 for m in known) and any(m.level == "match" for m in known)
                if ok and 3 * sum(m.level in ("match", "compatible") for m in known) >= 2 * len(known) and round(sum(m.score for m in known) / len(known), 9) >= least:
                    p.append(r.article)
                    break
            else:
                parts.append([r.article])
        rows = [(k, a) for k, p in enumerate(parts) for a in p]
        return pd.DataFrame({"event": [left["event"].iloc[0]] * len(rows), "article": [a for _, a in rows], "part": [k for k, _ in rows]})

    kept = pairs.select(F.col("event").alias("_event"), "a", "b", "score", "level", "specific", "conflict")
    types = dict(members.dtypes)
    return members.groupBy("event").cogroup(kept.groupBy("_event")).applyInPandas(part, f"event {types['event']}, article {types['article']}, part int")


def apply_regrouping(state: State, parts: DataFrame, new_id) -> State:
    """Articles of parts above 0 move to new events, whose ids ``new_id`` makes of (event, part)."""
    return create(state, parts.where("part > 0").select(new_id(F.col("event"), F.col("part")).alias("event"), "article"))
