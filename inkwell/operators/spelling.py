"""Spelling correction by optimal string alignment distance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def osa(a: str, b: str) -> int:
    """Edits between two words; a swap of neighbours is one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        rows.append(row)
    return rows[-1][-1]


def corrections(spark, terms: list[str], vocabulary: DataFrame) -> DataFrame:
    """(term, correction): the closest word of (word, n) for each term, by edits, then count, then alphabet.

    One edit up to five characters, two beyond. Terms under four characters, with digits, or that begin
    a known word stay uncorrected. Words whose length or plain edit distance rules them out are
    dropped in the JVM; only the few left are compared in Python.
    """
    asked = [t.lower() for t in terms if len(t) >= 4 and not any(c.isdigit() for c in t)]
    if not asked:
        return spark.createDataFrame([], "term string, correction string")
    q = spark.createDataFrame([(t, 1 if len(t) <= 5 else 2) for t in asked], "term string, most int")
    near = vocabulary.join(F.broadcast(q), F.abs(F.length("word") - F.length("term")) <= F.col("most"))
    # A swap costs two plain edits, so twice the limit bounds the plain distance.
    near = near.where(F.levenshtein("word", "term") <= 2 * F.col("most"))

    @F.pandas_udf("int")
    def edits(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in it:
            yield pd.Series([osa(x, y) for x, y in zip(a, b, strict=True)])

    known = vocabulary.join(F.broadcast(q), F.col("word").startswith(F.col("term")), "inner").select("term").distinct()
    scored = near.withColumn("edits", edits("term", "word")).where("edits <= most")
    best = scored.groupBy("term").agg(F.min_by("word", F.struct("edits", (-F.col("n")).alias("n"), "word")).alias("correction"))
    return best.join(known, "term", "left_anti")
