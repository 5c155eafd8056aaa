"""Phrases of a dictionary found in whole texts in one pass, however many the phrases.

Texts and phrases are cut to words in the same way; a phrase is met where its words stand side by
side. A dictionary up to a stated size becomes an automaton in each task; a larger one is joined with
the runs of words of each of its phrase lengths, which needs no copy of it anywhere. Both give the
same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words

#: Characters of a dictionary that is sent to every task.
AUTOMATON_CHARS = 8_000_000


def dictionary(phrases: DataFrame, id_col: str, phrase_col: str) -> DataFrame:
    """(phrase_id, phrase, size): distinct phrases by their words; those without words are left out."""
    cut = phrases.select(F.col(id_col).alias("phrase_id"), words(F.col(phrase_col)).alias("w")).where(F.size("w") > 0)
    return cut.select("phrase_id", F.array_join("w", " ").alias("phrase"), F.size("w").alias("size")).distinct()


def phrase_hits(df: DataFrame, id_col: str, fields: list[str], known: DataFrame, removed: list[str] = (), automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(id, field, phrase_id, at, size): each place, from word 0 of its field, where a phrase of ``known`` stands.

    ``known`` is a ``dictionary``. ``removed`` names phrases that are taken out of the texts first, so that no phrase is
    met over their words; they and their places leave no word behind. Null texts hold no phrase; ids may repeat.
    """
    gone = [" ".join("".join(c if c.isalnum() else " " for c in r.lower()).split()) for r in removed]
    texts = None
    for k, f in enumerate(fields):
        padded = F.concat(F.lit(" "), F.array_join(words(F.coalesce(F.col(f), F.lit(""))), " "), F.lit(" "))
        for g in gone:
            padded = F.replace(padded, F.lit(f" {g} "), F.lit(" "))
        part = df.select(F.col(id_col).alias("id"), F.lit(f).alias("field"), padded.alias("padded"))
        texts = part if texts is None else texts.unionByName(part)
    if (known.agg(F.sum(F.length("phrase"))).first()[0] or 0) <= automaton_chars:
        return _by_automaton(texts, known)
    return _by_join(texts, known)


def _by_automaton(texts: DataFrame, known: DataFrame) -> DataFrame:
    pairs: dict[str, list] = {}
    for r in known.select("phrase_id", "phrase").collect():
        pairs.setdefault(r.phrase, []).append(r.phrase_id)
    sent = texts.sparkSession.sparkContext.broadcast(pairs)
    schema = T.StructType([texts.schema["id"], texts.schema["field"], known.schema["phrase_id"], T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for phrase, ids in sent.value.items():
            found.add_word(f" {phrase} ", (ids, len(phrase) + 2, phrase.count(" ") + 1))
        if not sent.value:
            return
        found.make_automaton()
        for b in it:
            rows, numbers, at, sizes = [], [], [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                counted, place = 0, 0  # words before the character ``counted``
                for end, (ids, length, size) in found.iter(text):
                    start = end - length + 1
                    if start >= counted:
                        place += text.count(" ", counted, start)
                        counted, here = start, place
                    else:
                        here = place - text.count(" ", start, counted)
                    for i in ids:
                        rows.append(k)
                        numbers.append(i)
                        at.append(here)
                        sizes.append(size)
            taken = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(numbers, pa_type), pa.array(at, pa.int32()), pa.array(sizes, pa.int32())], ["id", "field", "phrase_id", "at", "size"])

    pa_type = pa.int64() if isinstance(known.schema["phrase_id"].dataType, T.LongType) else None
    return texts.mapInArrow(batches, schema)


def _by_join(texts: DataFrame, known: DataFrame) -> DataFrame:
    lengths = [r.size for r in known.select("size").distinct().collect()]  # few: the lengths of phrases
    cut = texts.select("id", "field", F.filter(F.split("padded", " "), lambda w: w != "").alias("w"))
    runs = [
        cut.where(F.size("w") >= n).select("id", "field", F.lit(n).alias("size"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("at", "phrase"))
        for n in lengths
    ]
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    return every.join(known.select("phrase", "phrase_id"), "phrase").select("id", "field", "phrase_id", "at", "size")


def leftmost_longest(hits: DataFrame) -> DataFrame:
    """The hits that remain when each field is read from its start and the longest phrase at a place wins; what it covers is passed over.

    Hits of one place and length keep the smallest phrase_id. A fold over each field's hits in order, which streams them.
    """
    schema = hits.select("id", "field", "phrase_id", "at", "size").schema
    ordered = hits.select("id", "field", "phrase_id", "at", "size").repartition("id", "field").sortWithinPartitions("id", "field", "at", F.desc("size"), "phrase_id")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, free = None, 0
        for b in it:
            kept = []
            for k, (i, f, at, size) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())):
                if (i, f) != key:
                    key, free = (i, f), 0
                if at >= free:
                    kept.append(k)
                    free = at + size
            yield b.take(pa.array(kept, pa.int32()))

    return ordered.mapInArrow(batches, schema)
