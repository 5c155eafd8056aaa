"""A stored inverted index: postings sorted by stem and term, so that a query reads the pages of its terms only.

Postings are range-partitioned and sorted by (stem, term, id): file and page statistics answer stems, exact terms and
prefixes alike, and a term that stands in very many documents fills several files. Stems stand beside the words as
written, so a query may ask for either, in phrases too. Positions of words count from a start of their own in each
field, so a phrase never runs from one field into the next. The words, with their stems and frequencies, are a table
of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import stem_of
from ..functions.text import words
from .search import B, K1
from .storage import shared_root

#: Positions that a field has room for.
FIELD = 1 << 32


class Index(NamedTuple):
    """``postings``: stem, term, id, tf, length, positions. ``vocabulary``: term, stem, df, cf. ``corpus``: one row of n, mean."""

    postings: DataFrame
    vocabulary: DataFrame
    corpus: DataFrame
    fields: tuple[str, ...]


class Term(NamedTuple):
    """A word, a prefix or a phrase of a query, in any field or in one; ``stemmed``: words with the same stems answer too."""

    text: str
    prefix: bool = False
    field: str | None = None
    stemmed: bool = False


#: Words that a step of the tokens' grouping works on at once, whole documents at a time.
CHUNK = 1 << 20


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, length, w0, w1, ...) → postings: the words of whole documents grouped by sorting their codes. Stems are made once a word and chunk."""
    for batch in batches:
        ids, lengths, lists = batch.column(0), batch.column(1).to_numpy(), batch.columns[2:]
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
            parts = [c.slice(start, stop - start) for c in lists]
            flat = pa.concat_arrays([p.flatten() for p in parts]).dictionary_encode()
            if len(flat):
                sizes = [pc.list_value_length(p).to_numpy() for p in parts]
                row = np.concatenate([np.repeat(np.arange(stop - start), s) for s in sizes])
                place = np.concatenate([np.int64(k * FIELD) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) for k, s in enumerate(sizes)])
                code = flat.indices.to_numpy().astype(np.int64)
                # stable: the places of a word in a document stay in order
                order = np.argsort(row * len(flat.dictionary) + code, kind="stable")
                row, code, place = row[order], code[order], place[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
                bounds = np.r_[first, len(row)]
                stem = pa.array([stem_of(w) for w in flat.dictionary.to_pylist()], pa.string())
                code, row = pa.array(code[first]), row[first] + start
                columns = [stem.take(code), flat.dictionary.take(code), ids.take(pa.array(row)), pa.array(np.diff(bounds)), pa.array(lengths[row].astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(place))]
                yield pa.RecordBatch.from_arrays(columns, names=["stem", "term", "id", "tf", "length", "positions"])
            start = stop


def build(df: DataFrame, id_col: str, fields: list[str], path: str) -> Index:
    """Write the index of the text columns ``fields`` under ``path``. Null texts hold no words.

    A document's words are grouped where it is read and written so; the one shuffle is that of the postings by range, whose bounds are
    drawn from what was written. Rows that repeat an id are one document: only if there are any are postings put together again.
    """
    spark = df.sparkSession
    tokens = df.select(F.col(id_col).alias("id"), *(words(F.coalesce(F.col(f), F.lit(""))).alias(f"w{k}") for k, f in enumerate(fields)))
    length = sum((F.size(f"w{k}") for k in range(len(fields))), F.lit(0))
    kind = df.schema[id_col].dataType.simpleString()
    made = tokens.select("id", length.alias("length"), *(f"w{k}" for k in range(len(fields)))).mapInArrow(_postings, f"stem string, term string, id {kind}, tf bigint, length int, positions array<bigint>")
    made.write.parquet(f"{path}/grouped")
    placed = spark.read.parquet(f"{path}/grouped").repartitionByRange("stem", "term", "id")
    if not df.groupBy(F.col(id_col)).count().where("count > 1").isEmpty():
        placed = placed.groupBy("stem", "term", "id").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    placed.sortWithinPartitions("stem", "term", "id").write.parquet(f"{path}/postings")
    counted = spark.read.parquet(f"{path}/postings").groupBy("term", "stem").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    counted.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/vocabulary")
    tokens.agg(F.count("*").alias("n"), F.avg(length).alias("mean")).write.parquet(f"{path}/corpus")
    return opened(spark, path, fields)


def opened(spark: SparkSession, path: str, fields: list[str]) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "vocabulary", "corpus")), tuple(fields))


#: By application, id column and fields: the frames indexed, what their files or version were, and where the index is.
_BUILT: dict[tuple, list[tuple[DataFrame, object, str]]] = {}


def files_stamp(df: DataFrame) -> tuple:
    """Names, sizes and times of the files that a frame reads, by one listing a folder."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    wanted, found = set(df.inputFiles()), []
    for folder in sorted({name.rsplit("/", 1)[0] for name in wanted}):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        for s in at.getFileSystem(conf).listStatus(at):
            found.append((s.getPath().toUri().getPath(), s.getLen(), s.getModificationTime()))
    names = {jvm.java.net.URI(name).getPath() for name in wanted}
    return tuple(sorted(f for f in found if f[0] in names))


def index_of(df: DataFrame, id_col: str, fields: list[str], version: object = None) -> Index:
    """The index of a frame, built in this application at the first call for it and opened after.

    It is that of this frame alone: another plan (a filter, a derived id) or other files, by name, size or time, have an
    index of their own. ``version`` stands for the state of the files where the caller knows it; they are not listed then.
    """
    spark = df.sparkSession
    state = ("version", version) if version is not None else files_stamp(df)
    known = _BUILT.setdefault((spark.sparkContext.applicationId, id_col, tuple(fields)), [])
    for other, then, path in known:
        if then == state and other.sameSemantics(df):
            return opened(spark, path, fields)
    path = f"{shared_root(spark)}/inkwell-index-{uuid.uuid4().hex}"
    made = build(df, id_col, fields, path)
    known.append((df, state, path))
    return made


def _in_field(index: Index, term: Term) -> tuple[Column, Column]:
    """(tf, positions) of a posting, in the term's field if it names one."""
    if term.field is None:
        return F.col("tf"), F.col("positions")
    k = index.fields.index(term.field)
    kept = F.filter("positions", lambda p: F.floor(p / FIELD) == k)
    return F.size(kept).cast("long"), kept


def _answers(term: Term, word: str, prefix: bool) -> Column:
    """Which postings answer a word of a query. Each test names a column that the postings are sorted by."""
    stem = stem_of(word)
    if term.stemmed:
        return F.col("stem").startswith(stem) if prefix else F.col("stem") == stem
    return F.col("term").startswith(word) if prefix else (F.col("stem") == stem) & (F.col("term") == word)


def matches(index: Index, terms: list[Term], match_all: bool = True) -> DataFrame:
    """(id, length, tf0, tf1, ...): documents that hold all terms (or any), with each term's occurrences.

    A prefix counts all words that it begins; a phrase counts the places where its words follow each other; a stemmed term
    counts words of the same stem (a prefix: stems that begin with its own). Texts are cut to words as the documents are.
    A term without words matches nothing.
    """
    plain = [[w for w in "".join(c if c.isalnum() else " " for c in t.text.lower()).split()] for t in terms]
    parts = None
    for i, (term, ws) in enumerate(zip(terms, plain, strict=True)):
        tf, positions = _in_field(index, term)
        hit = None
        for j, w in enumerate(ws):
            rows = index.postings.where(_answers(term, w, term.prefix and j == len(ws) - 1))
            # Positions are read for phrases and fields alone.
            rows = rows.select("id", "length", F.lit(i).alias("i"), F.lit(j).alias("j"), tf.alias("tf"), (positions if len(ws) > 1 else F.lit(None).cast("array<bigint>")).alias("positions")).where("tf > 0")
            hit = rows if hit is None else hit.unionByName(rows)
        if hit is None:
            hit = index.postings.where("false").select("id", "length", F.lit(i).alias("i"), F.lit(0).alias("j"), "tf", "positions")
        parts = hit if parts is None else parts.unionByName(hit)
    here = lambda i, j: (F.col("i") == i) & (F.col("j") == j)
    cols = [F.first("length").alias("length")]
    for i, ws in enumerate(plain):
        if len(ws) <= 1:
            cols.append(F.coalesce(F.sum(F.when(here(i, 0), F.col("tf"))), F.lit(0)).cast("long").alias(f"tf{i}"))
        else:
            cols += [F.flatten(F.collect_list(F.when(here(i, j), F.col("positions")))).alias(f"p{i}_{j}") for j in range(len(ws))]
    per = parts.groupBy("id").agg(*cols)
    for i, ws in enumerate(plain):
        if len(ws) > 1:
            per = per.withColumn(f"tf{i}", _followed([f"p{i}_{j}" for j in range(len(ws))])).drop(*(f"p{i}_{j}" for j in range(len(ws))))
    held = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    test = held[0]
    for h in held[1:]:
        test = (test & h) if match_all else (test | h)
    return per.withColumn("_kept", test)


def _followed(places: list[str]) -> Column:
    """How many of the first word's places have each further word at its distance."""

    def test(p: Column) -> Column:
        out = F.lit(True)
        for j, c in enumerate(places[1:], 1):
            out = out & F.array_contains(F.col(c), p + j)
        return out

    return F.size(F.filter(places[0], test)).cast("long")


def ranked_matches(index: Index, terms: list[Term], match_all: bool = True) -> DataFrame:
    """(id, score) by BM25 over the fields together; a term's document frequency is that of its matches.

    The matching postings are read and shuffled once: frequencies and scores stand on the same shuffle.
    """
    per = matches(index, terms, match_all)
    counts = per.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    scored = per.where("_kept").join(F.broadcast(counts)).join(F.broadcast(index.corpus))  # one row each
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, d = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.select("id", score.alias("score"))
