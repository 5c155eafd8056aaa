"""Vectors of texts: pooled token vectors, hashed words, and word pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import words

#: Dimensions of a hashed vector, and pieces of one text and of a pair.
BUCKETS, ONE, PAIR = 384, 128, 256


def pooled(tokens: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the mean of each key's vectors at length one, in one pass of element-wise means; a zero mean stays zero."""
    parts = tokens.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    g = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("size"))
    return g.select(key, F.transform("v", lambda e: F.when(F.col("size") > 0, e["m"] / F.col("size")).otherwise(e["m"])).alias("vector"))


def bucket(word):
    """Bernstein's hash of a word's UTF-8 bytes in 64 unsigned bits (5381, times 33 plus the byte), over the number of buckets."""
    codes = F.filter(F.split(F.regexp_replace(F.hex(F.encode(word, "UTF-8")), "(..)", "$1,"), ","), lambda h: h != "")
    wide = lambda c: c.cast("decimal(38,0)")
    ring = F.lit("18446744073709551616").cast("decimal(38,0)")
    h = F.aggregate(codes, wide(F.lit(5381)), lambda a, c: wide((a * 33 + wide(F.conv(c, 16, 10))) % ring))
    return (h % BUCKETS).cast("int")


def hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bucket, weight): the hashed word counts of each text at length one; words of two characters or more.

    A text without words has weight one in bucket 0. Hashes are taken once a distinct word, not once an occurrence.
    """
    w = df.select(F.col(id_col).alias("id"), F.explode(F.filter(words(F.col(text_col)), lambda x: F.length(x) >= 2)).alias("word"))
    counts = w.groupBy("id", "word").agg(F.count("*").alias("n"))
    known = counts.select("word").distinct().withColumn("bucket", bucket(F.col("word")))
    by = counts.join(known, "word").groupBy("id", "bucket").agg(F.sum("n").alias("n"))
    size = by.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    made = by.join(size, "id").select("id", "bucket", (F.col("n") / F.col("size")).alias("weight"))
    none = df.select(F.col(id_col).alias("id")).join(size, "id", "left_anti").select("id", F.lit(0).alias("bucket"), F.lit(1.0).alias("weight"))
    return made.unionByName(none)


def pieces_of(word: str, vocabulary: dict[str, int], unknown: int, longest: int = 100) -> list[int]:
    """Longest known pieces from the left, those after the first marked ##; a word that can't be cut so is unknown."""
    out, at = [], 0
    while at < len(word):
        end = len(word) if len(word) <= longest else at
        while end > at and ("##" if at else "") + word[at:end] not in vocabulary:
            end -= 1
        if end == at:
            return [unknown]
        out.append(vocabulary[("##" if at else "") + word[at:end]])
        at = end
    return out


def word_pieces(df: DataFrame, id_col: str, first: str, second: str | None, vocabulary: dict[str, int]) -> DataFrame:
    """(id, ids): piece ids of a text, or of a pair, between [CLS] and [SEP]: ONE or PAIR of them at most.

    A pair too long loses pieces from its longer side's end, one at a time. Null texts count as empty. The vocabulary is a parameter.
    """
    cls, sep, unknown = (vocabulary[t] for t in ("[CLS]", "[SEP]", "[UNK]"))
    cols = [F.col(id_col).alias("id"), words(F.coalesce(F.col(first), F.lit(""))).alias("a")]
    if second:
        cols.append(words(F.coalesce(F.col(second), F.lit(""))).alias("b"))

    def cut(ws: list[str], most: int) -> list[int]:
        out: list[int] = []
        for w in ws:
            if len(out) >= most:
                break
            out += pieces_of(w, vocabulary, unknown)
        return out[:most]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for k in range(b.num_rows):
                a = cut(b.column(1)[k].as_py(), ONE - 2 if not second else PAIR)
                if not second:
                    rows.append([cls, *a, sep])
                    continue
                o = cut(b.column(2)[k].as_py(), PAIR)
                over = len(a) + len(o) - (PAIR - 3)
                while over > 0:
                    (a if len(a) >= len(o) else o).pop()
                    over -= 1
                rows.append([cls, *a, sep, *o, sep])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["id", "ids"])

    made = df.select(*cols)
    return made.mapInArrow(batches, f"id {dict(made.dtypes)['id']}, ids array<int>")
