"""Ranking and selection: MMR, greedy briefing, lanes, discovery, profiles, notification limits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .storage import written
from .windows import first_rows, ordered_fold

# Candidates of one query and picks of one list: features of the operators.
MAX_CANDIDATES, MAX_PICKS = 500, 50


def mmr_order(ids, relevance, vectors, times, lam: float, tau: float, picks: int) -> list[tuple[int, float]]:
    """Greedy picks of (index, score): lambda * relevance - (1 - lambda) * largest decayed similarity to a pick; ties to the smallest id."""
    order = np.argsort(ids, kind="stable")
    rel, vec, at = np.clip(np.asarray(relevance, float)[order], 0, 1), np.asarray(vectors, float)[order], np.asarray(times, float)[order]
    penalty, left, out = np.zeros(len(order)), np.ones(len(order), bool), []
    for _ in range(min(picks, len(order))):
        score = np.where(left, lam * rel - (1 - lam) * penalty, -np.inf)
        best = int(score.argmax())
        out.append((int(order[best]), float(score[best])))
        left[best] = False
        near = np.maximum(0, vec @ vec[best]) * np.exp(-np.abs(at - at[best]) / tau)
        penalty = np.maximum(penalty, near)
    return out


def mmr(candidates: DataFrame, key: str, lam: float = 0.7, tau: float = 86_400.0, picks: int = 10) -> DataFrame:
    """(key, id, place, score) per query from (key, id, relevance, vector, at).

    The most relevant MAX_CANDIDATES of a query are taken first, in the JVM, so a group in Python is bounded.
    """
    top = first_rows(candidates, [key], [F.desc("relevance"), F.asc("id")], MAX_CANDIDATES)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        made = mmr_order(pdf["id"].to_numpy(), pdf["relevance"].to_numpy(), np.stack(pdf["vector"].to_list()), pdf["at"].to_numpy(), lam, tau, min(picks, MAX_PICKS))
        return pd.DataFrame({key: pdf[key].iloc[0], "id": [pdf["id"].iloc[i] for i, _ in made], "place": range(1, len(made) + 1), "score": [s for _, s in made]})

    return top.groupBy(key).applyInPandas(pick, f"{key} long, id long, place int, score double")


def diversity(df: DataFrame, key: str, id_col: str, vector_col: str) -> DataFrame:
    """(key, diversity): mean of 1 - cosine over the pairs of a list, without making pairs.

    The sum over pairs of unit vectors' dots is (|sum|^2 - sum |v|^2) / 2, so one pass of element-wise
    sums is enough, whatever the list's length.
    """
    squares = dot(F.col(vector_col), F.col(vector_col))
    long = df.select(key, id_col, squares.alias("q"), F.posexplode(vector_col).alias("i", "x"))
    sums = long.groupBy(key, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.when(F.col("i") == 0, F.col("q"))).alias("q"), F.sum(F.when(F.col("i") == 0, 1)).alias("n"))
    g = sums.groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("total"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return g.where("n > 1").select(key, (1 - (F.col("total") - F.col("q")) / 2 / pairs).alias("diversity"))


def briefing(candidates: DataFrame, key: str, picks: int = 10, per_source: int = 2) -> DataFrame:
    """(key, id, place): greedy list from (key, id, source, category, event, sources, interest, at).

    The newest MAX_CANDIDATES of a reader take part. Each pick is the largest by (number of sources,
    interest, least use of its source and category, least use of its source), ties to the newest; a
    source at most twice, an event once.
    """
    top = first_rows(candidates, [key], [F.desc("at"), F.asc("id")], MAX_CANDIDATES)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["at", "id"], ascending=[False, True]).to_dict("records")
        used, cats, events, out = {}, {}, set(), []
        for _ in range(picks):
            open_ = [r for r in rows if used.get(r["source"], 0) < per_source and r["event"] not in events]
            if not open_:
                break
            best = max(open_, key=lambda r: (r["sources"], r["interest"], -(used.get(r["source"], 0) + cats.get(r["category"], 0)), -used.get(r["source"], 0)))
            rows.remove(best)
            used[best["source"]] = used.get(best["source"], 0) + 1
            cats[best["category"]] = cats.get(best["category"], 0) + 1
            events.add(best["event"])
            out.append(best["id"])
        return pd.DataFrame({key: pdf[key].iloc[0], "id": out, "place": range(1, len(out) + 1)})

    return top.groupBy(key).applyInPandas(pick, f"{key} long, id long, place int")


def editorial_score(originals: Column, level: Column, sector: Column, salience: Column, rising: Column, developing: Column, promotional: Column) -> Column:
    breadth = 0.42 * F.least(F.lit(1.0), F.log2(F.greatest(F.lit(1), originals)) / float(np.log2(6)))
    importance = F.when(level == "major", 0.28).when(level == "notable", 0.16).otherwise(0.04)
    momentum = F.when(rising & developing, 0.10).when(rising | developing, 0.07).otherwise(0.0)
    raw = breadth + importance + F.when(sector & (level != "major"), 0.05).otherwise(0.0) + 0.20 * salience + momentum
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))
    return F.when(promotional, F.least(clamped, F.lit(0.25))).otherwise(clamped)


def importance(coverage: Column, originals: Column, severe: Column, any_type: Column, harm: Column, sector: Column, moving: Column) -> Column:
    """major from four points on; notable from two, or with two publishers; else minor."""
    points = F.when(coverage >= 8, 3).when(coverage >= 5, 2).when(coverage >= 3, 1).otherwise(0) + F.when(originals >= 5, 1).otherwise(0)
    points = points + F.when(severe, 2).when(any_type, 1).otherwise(0) + harm.cast("int") + sector.cast("int") + moving.cast("int")
    return F.when(points >= 4, "major").when((points >= 2) | (coverage >= 2), "notable").otherwise("minor")


#: Lanes in cascade order: (name, eligible column, score column, least, most).
LANES = (("lead", "lead_ok", "score", 1, 5), ("in_motion", "motion_ok", "motion", 3, 12), ("deep_read", "deep_ok", "deep", 3, 8), ("your_beat", "beat_ok", "beat", 3, 12), ("outside", "outside_ok", "outside", 3, 6))


def lanes(stories: DataFrame, key: str = "edition") -> DataFrame:
    """(edition, id, lane): each lane takes its best eligible stories in turn; what a full lane leaves falls through.

    A lane with fewer than its least releases all. The rest is 'latest'. Ids have to be distinct within ``key``. A lane takes from
    its first ``most`` eligible stories and as many more as the lanes before it may have taken; only these, a few for each ``key``
    however many stories it has, meet in one task.
    """
    firsts, before = None, 0
    for _, ok, score, least, most in LANES:
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), F.asc("id")))
        best = stories.where(F.col(ok)).withColumn("_place", place).where(F.col("_place") <= max(least, most) + before).drop("_place")
        firsts, before = best if firsts is None else firsts.unionByName(best), before + most
    left, out = written(firsts.dropDuplicates([key, "id"]), "lane-firsts"), None
    for name, ok, score, least, most in LANES:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ok), F.desc(score), F.asc("id")))
        size = F.count_if(F.col(ok)).over(Window.partitionBy(key))
        marked = left.withColumn("_in", F.coalesce(F.col(ok) & (rank <= most) & (size >= least), F.lit(False)))
        taken = marked.where("_in").select(F.col(key).alias("_key"), F.col("id").alias("_id"), F.lit(name).alias("lane"))
        out = taken if out is None else out.unionByName(taken)
        left = marked.where("NOT _in").drop("_in")
    return stories.join(out, F.col(key).eqNullSafe(F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left").select(key, "id", F.coalesce("lane", F.lit("latest")).alias("lane"))


def discovery_slots(batch: Column, remainder: Column) -> tuple[Column, Column]:
    """(slots, carried): three in twenty of a batch, the remainder carried."""
    total = 3 * batch + remainder
    return F.floor(total / 20).cast("long"), total % 20


def profiles(actions: DataFrame, half_life: float = 7 * 86_400.0, weights: dict | None = None) -> DataFrame:
    """(user_id, profile, n): unit profile vectors from (user_id, at, id, action, vector), folded in time order.

    v becomes normalize(v * 2^(-dt / h) + w x). Not a linear sum, so it is a fold per user over sorted
    actions; each action of an item counts once, and a skip counts only without a click or save of it.
    """
    w = weights or {"click": 1.0, "save": 2.0, "skip": -0.5}
    once = actions.groupBy("user_id", "id", "action").agg(F.min("at").alias("at"), F.min_by("vector", "at").alias("vector"))
    engaged = Window.partitionBy("user_id", "id")
    kept = once.withColumn("_e", F.bool_or(F.col("action") != "skip").over(engaged)).where("action <> 'skip' OR NOT _e")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        v, last = None, None
        for r in pdf.sort_values(["at", "id", "action"]).itertuples():
            x = np.asarray(r.vector, float)
            x = x / (np.linalg.norm(x) or 1.0) * w[r.action]
            v = x if v is None else v * 2 ** (-(r.at - last) / half_life) + x
            v, last = v / (np.linalg.norm(v) or 1.0), r.at
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "profile": [v], "n": [len(pdf)]})

    return kept.groupBy("user_id").applyInPandas(fold, "user_id long, profile array<double>, n long")


def salience(sentiment: Column, entities: Column, signals: Column) -> Column:
    cap = lambda c, n: F.least(c / float(n), F.lit(1.0))
    return F.least(F.lit(1.0), 0.25 * F.abs(sentiment) + 0.30 * cap(entities, 6) + 0.30 * cap(signals, 3) + 0.15)


def limited(df: DataFrame, keys: list[str], at: str, windows: tuple[tuple[int, int], ...]) -> DataFrame:
    """Rows that a rate limit lets through in time order: at most n accepted in the trailing seconds, for each (n, seconds).

    Whether a row passes depends on earlier passes, so it is a fold per key; what it keeps is the times of
    the last n accepted, not the history.
    """
    longest = max(n for n, _ in windows)

    def step(recent, row):
        now = row[0]
        if all(sum(t > now - seconds for t in recent) < n for n, seconds in windows):
            return (now, *recent)[:longest], (True,)
        return recent, None

    rows = df.select(*keys, F.col(at).alias("_at"), "id")
    return ordered_fold(rows, keys, ["_at", "id"], ["_at", "id"], step, (), "passed boolean").select(*keys, "id")
