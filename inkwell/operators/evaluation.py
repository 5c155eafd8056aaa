"""Evaluation metrics as aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words


def ndcg(df: DataFrame, key: str, score: str, grade: str, id_col: str, k: int = 10) -> DataFrame:
    """(key, ndcg) with gains 2^grade - 1; null where no row has a grade."""
    place = lambda c: F.row_number().over(Window.partitionBy(key).orderBy(F.desc(c), F.asc(id_col)))
    gain = F.pow(F.lit(2.0), F.col(grade)) - 1
    r = df.withColumns({"_p": place(score), "_q": place(grade)})
    at = lambda p: F.sum(F.when(F.col(p) <= k, gain / F.log2(F.col(p) + 1.0)))
    return r.groupBy(key).agg((at("_p") / F.nullif(at("_q"), F.lit(0.0))).alias("ndcg"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The bounds of a rate's interval; null without trials."""
    total = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / total
    mid, wide = (p + z * z / (2 * total)), z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))
    return (mid - wide) / (1 + z * z / total), (mid + wide) / (1 + z * z / total)


def precision_recall(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """Counts and rates by group; a null prediction abstains: it is missed by recall but not by precision."""
    hit, said, real = F.count_if(F.col(truth) & F.col(predicted)), F.count_if(F.col(predicted)), F.count_if(F.col(truth))
    g = df.groupBy(*keys).agg(hit.alias("hits"), said.alias("said"), real.alias("real"), F.count_if(F.col(predicted).isNull()).alias("abstained"))
    return g.withColumns({"precision": F.col("hits") / F.nullif("said", F.lit(0)), "recall": F.col("hits") / F.nullif("real", F.lit(0))})


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters, one row: agreement against that of the raters' own rates."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    ra, rb = cells.groupBy(F.col(a).alias("r")).agg(F.sum("n").alias("na")), cells.groupBy(F.col(b).alias("r")).agg(F.sum("n").alias("nb"))
    chance = ra.join(rb, "r").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select(((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))  # one row each


def threshold_at_precision(df: DataFrame, score: str, truth: str, target: float) -> DataFrame:
    """(threshold, precision, recall): the lowest score from which on precision reaches the target.

    Rows are counted by score first; the running counts are over distinct scores.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col(truth)).alias("hits"))
    w = Window.orderBy(F.desc("s"))
    run = by.select("s", F.sum("n").over(w).alias("n"), F.sum("hits").over(w).alias("hits"), F.sum("hits").over(Window.partitionBy()).alias("all"))
    return run.where(F.col("hits") / F.col("n") >= target).orderBy("s").limit(1).select(F.col("s").alias("threshold"), (F.col("hits") / F.col("n")).alias("precision"), (F.col("hits") / F.nullif("all", F.lit(0))).alias("recall"))


def stratified_sample(df: DataFrame, strata: list[str], id_col: str, n: int, salt: str = "") -> DataFrame:
    """``n`` rows of each stratum, the first by a hash of their id: the same rows each time."""
    from .windows import first_rows

    return first_rows(df.withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col(id_col).cast("string")), 256)), strata, [F.asc("_h"), F.asc(id_col)], n).drop("_h")


def random_unit(seed: str, *parts: Column) -> Column:
    """A reproducible number in [0, 1) from a hash of the parts."""
    raw = F.sha2(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts)), 256)
    return F.conv(F.left(raw, F.lit(13)), 16, 10).cast("double") / float(16**13)


def shared_run(a: list[str], b: list[str]) -> int:
    """The length of the longest run of words that stands in both lists."""
    best, row = 0, {}
    at: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    for w in a:
        now = {}
        for j in at.get(w, ()):
            now[j] = row.get(j - 1, 0) + 1
            best = max(best, now[j])
        row = now
    return best


def longest_run(df: DataFrame, id_cols: list[str], text: str, source: str) -> DataFrame:
    """(ids, run, verbatim): the longest run of words of a text that its source holds too, and that run's share of the text."""
    n = len(id_cols)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(shared_run(x, y), len(x)) for x, y in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([r for r, _ in rows], pa.int32()), pa.array([r / k if k else 0.0 for r, k in rows], pa.float64())], [*id_cols, "run", "verbatim"])

    rows = df.select(*id_cols, words(F.coalesce(F.col(text), F.lit(""))).alias("_t"), words(F.coalesce(F.col(source), F.lit(""))).alias("_s"))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*id_cols).dtypes)
    return rows.mapInArrow(batches, schema + ", run int, verbatim double")


def top_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(shared): how much of the top ``k`` of two lists (id, score) is the same, over k; one row."""
    top = lambda x: x.orderBy(F.desc("score"), "id").limit(k).select("id")
    return top(a).join(top(b), "id").agg((F.count("*") / float(k)).alias("shared"))
