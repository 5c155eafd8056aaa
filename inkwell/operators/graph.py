"""Entity graph: co-report edges, PageRank, personalized PageRank, related entities, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import recency_weight
from .storage import checkpointed

DAMPING, ROUNDS = 0.85, 30
PER_STORY = 12


def capped_mentions(mentions: DataFrame, per_story: int = PER_STORY) -> DataFrame:
    """A story's best-scored entities: the feature that keeps pairs of a story bounded. Columns story, entity, score, ..."""
    rank = F.row_number().over(Window.partitionBy("story").orderBy(F.desc("score"), "entity"))
    return mentions.withColumn("_r", rank).where(F.col("_r") <= per_story).drop("_r")


def edges(mentions: DataFrame, least_stories: int = 2) -> DataFrame:
    """(a, b, weight, evidence), both directions.

    ``mentions``: story, entity, publisher, age_days, with a bounded number of entities per story.
    A pair weighs, for each publisher, the largest recency weight of its stories. Symmetric pairs are
    made once (a < b) and reversed after the aggregation.
    """
    m = mentions.select("story", "entity", "publisher", recency_weight(F.col("age_days")).alias("w")).distinct()
    x, y = m.alias("x"), m.select("story", "entity", "publisher").alias("y")
    pairs = x.join(y, (F.col("x.story") == F.col("y.story")) & (F.col("x.publisher") == F.col("y.publisher")) & (F.col("y.entity") > F.col("x.entity")))
    per = pairs.groupBy(F.col("x.entity").alias("a"), F.col("y.entity").alias("b"), "x.publisher").agg(F.max("w").alias("w"), F.count("*").alias("n"))
    once = per.groupBy("a", "b").agg(F.sum("w").alias("weight"), F.sum("n").alias("evidence")).where(F.col("evidence") >= least_stories)
    return once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", "evidence"))


def pagerank(edge: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, every: int = 10) -> DataFrame:
    """(node, rank): ranks that sum to 1; the mass of nodes without edges is shared by all.

    Each round is one join on the source and one aggregation by target; lineage is cut every few rounds.
    """
    out = edge.groupBy("a").agg(F.sum("weight").alias("total"))
    share = checkpointed(edge.join(out, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("share")))
    nodes = checkpointed(edge.select(F.col("a").alias("node")).union(edge.select("b")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(None).cast("double"))
    sources = share.select(F.col("a").alias("node")).distinct()
    dead = nodes.join(sources, "node", "left_anti").limit(1).count() > 0
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(rounds):
        got = ranks.join(share, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        base = F.lit((1 - damping) / n)
        joined = nodes.join(got, "node", "left")
        if dead:
            lost = ranks.join(sources, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            joined = joined.join(F.broadcast(lost))  # one row
            base = base + damping * F.col("lost") / n
        ranks = joined.select("node", (base + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if (k + 1) % every == 0:
            ranks = checkpointed(ranks)
    return ranks


def personalized(edge: DataFrame, seed, rounds: int = ROUNDS, damping: float = DAMPING, every: int = 10) -> DataFrame:
    """(node, rank) of a walk that restarts at ``seed``; mass that can't move on returns there."""
    out = edge.groupBy("a").agg(F.sum("weight").alias("total"))
    share = checkpointed(edge.join(out, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("share")))
    start = checkpointed(share.where(F.col("a") == seed).select(F.col("a").alias("node")).distinct().withColumn("rank", F.lit(1.0)))
    # What the walk's restart brings back each round: the mass of all ranks is 1, and none is there without the seed.
    back = start.select("node", F.lit(1 - damping).alias("rank"))
    sources = share.select(F.col("a").alias("node")).distinct()
    dead = edge.select(F.col("b").alias("node")).join(sources, "node", "left_anti").limit(1).count() > 0
    ranks = start
    for k in range(rounds):
        parts = ranks.join(share, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (damping * F.col("rank") * F.col("share")).alias("rank")).unionByName(back)
        if dead:
            stuck = ranks.join(sources, "node", "left_anti").select(F.lit(seed).alias("node"), (damping * F.col("rank")).alias("rank"))
            parts = parts.unionByName(stuck)
        ranks = parts.groupBy("node").agg(F.sum("rank").alias("rank"))
        if dead or (k + 1) % every == 0:  # with dead ends the ranks are read twice a round
            ranks = checkpointed(ranks)
    return ranks


def related(personal: DataFrame, central: DataFrame, seed, n_nodes: int, keep: int = 8) -> DataFrame:
    """Nodes by personalized over global rank, the best ``keep``."""
    c = central.withColumnRenamed("rank", "central")
    return personal.where(F.col("node") != seed).join(c, "node").select("node", (F.col("rank") / (F.col("central") + 1.0 / n_nodes)).alias("score")).orderBy(F.desc("score"), "node").limit(keep)


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): connected components named by their smallest node, from (a, b).

    Each round hooks every node to the least label among its neighbours and then jumps pointers, so
    long chains take few rounds; every round is checkpointed. Labels that still move after
    ``max_rounds`` raise: no unfinished result is returned.
    """
    both = checkpointed(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct())
    label = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(max_rounds):
        near = both.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = label.join(near, "node").select("node", F.least("component", "near").alias("component"), "component")
        hooked = hooked.toDF("node", "new", "old")
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("root"))
        step = checkpointed(hooked.join(jump, "new", "left").select("node", F.least("new", F.coalesce("root", "new")).alias("component"), "old"))
        if not step.where("component <> old").limit(1).count():
            return step.select("node", "component")
        label = step.select("node", "component")
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
