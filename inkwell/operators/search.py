"""Hybrid retrieval: a BM25 arm over an inverted index, a vector arm, and reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.vectors import dot

K1, B = 1.2, 0.75
RRF = 60
#: Least cosine of the vector arm.
SIMILAR = 0.35


def inverted_index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf, length): a term's occurrences in each document, by one explode and a group-by within the document."""
    tokens = df.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    return tokens.select("id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25(df: DataFrame, id_col: str, text_col: str, terms: list[str], prefix: bool = False, match_all: bool = True) -> DataFrame:
    """(id, score) of the documents that hold all terms (or any).

    Term counts are taken inside each row, so the documents are read once and only matches are
    shuffled; corpus figures (documents, mean length, document frequencies) are one aggregate row.
    ``prefix``: a term matches every word that it begins.
    """
    tokens = df.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    hit = lambda t: F.size(F.filter("w", lambda x: x.startswith(t) if prefix else x == t))
    counted = tokens.select("id", F.size("w").alias("length"), *(hit(t).alias(f"tf{i}") for i, t in enumerate(terms)))
    corpus = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    held = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    test = held[0]
    for h in held[1:]:
        test = (test & h) if match_all else (test | h)
    scored = counted.where(test).join(F.broadcast(corpus))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, d = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.select("id", score.alias("score"))


def nearest(df: DataFrame, id_col: str, vector_col: str, query: list[float], least: float = SIMILAR) -> DataFrame:
    """(id, score) of the vectors whose cosine with the query, a parameter, is at least ``least``. All are unit vectors."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return df.select(F.col(id_col).alias("id"), dot(F.col(vector_col), q).alias("score")).where(F.col("score") >= least)


def ranked(arm: DataFrame, keep: int | None = None) -> DataFrame:
    """Add ``rank`` by (score descending, id).

    Ranks of a whole arm would need one task. With ``keep``, the top rows are taken first (each task
    keeps its own top), so the single-partition rank is over ``keep`` rows. Without it, rows are range-partitioned
    by rank order, numbered inside partitions, and shifted by the sizes of the partitions before.
    """
    if keep is not None:
        top = arm.orderBy(F.desc("score"), "id").limit(keep)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    dealt = arm.repartitionByRange(F.desc("score"), F.asc("id")).withColumn("_part", F.spark_partition_id())
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("score"), "id"))
    return dealt.withColumn("_k", inside).join(F.broadcast(before), "_part").withColumn("rank", F.col("_base") + F.col("_k")).drop("_part", "_base", "_k")


def fuse(arms: list[DataFrame], keep: int) -> DataFrame:
    """(id, score): reciprocal-rank fusion of the arms' top ``keep`` rows."""
    parts = [ranked(a, keep).select("id", "rank") for a in arms]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"), F.min("rank").alias("best"))


def snippet(df: DataFrame, id_col: str, text_col: str, term: str, width: int = 15) -> DataFrame:
    """(id, snippet): ``width`` words around the first match, the match in brackets."""
    tokens = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")
    clean = F.transform(tokens, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
    at = F.array_position(clean, term)
    start = F.greatest(F.lit(1), at.cast("int") - width // 2)
    return (
        df.select(F.col(id_col).alias("id"), tokens.alias("w"), at.alias("at"), start.alias("s")).where("at > 0")
        .select("id", F.array_join(F.transform(F.slice("w", F.col("s"), F.lit(width)), lambda w, i: F.when(F.col("s") + i == F.col("at"), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ").alias("snippet"))
    )
