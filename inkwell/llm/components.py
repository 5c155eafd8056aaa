"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is a join and a group-by over links; nothing is collected. The link table is
checkpointed each round, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_root


def _signature(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links between long ids → (node, component), the component being its smallest node.

    Only nodes with a link to another node are returned. Null ends, self links and repeated links
    are ignored; an empty table gives an empty table. Links that are not settled after ``max_rounds``
    raise: no unfinished result is returned (the rounds grow with the logarithm of the longest path).
    """
    shared_root(links.sparkSession)
    edges = (
        links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
        .checkpoint()
    )
    before = _signature(edges)
    for _ in range(max_rounds):
        if not before.n:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lower.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = small.checkpoint()
        now = _signature(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)
