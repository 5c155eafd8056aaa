"""Which earlier reports a new one is compared with: the best matches of its headline terms, near in time and in its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .search import B, K1

HOUR = 3600
#: Seconds around a report, for which an event stays open, candidates of a report; terms of a report and letters of a term.
WINDOW, LIFETIME, CANDIDATES = 48 * HOUR, 72 * HOUR, 40
TERMS, LETTERS = 8, 4
#: Tasks over which postings and pairs are dealt where the session's own number is smaller. Up to 200 (Spark's default threshold),
#: a task that deals rows writes them as they come and holds none of them.
DEALT = 200


def headline_terms(title: Column) -> Column:
    """Up to eight distinct words of four characters or more with a letter: capitalized words first, as written, then the others."""
    ws = F.filter(F.split(title, r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= LETTERS) & w.rlike(r"\p{L}"))
    named = F.concat(F.filter(ws, lambda w: w.rlike(r"^\p{Lu}")), F.filter(ws, lambda w: ~w.rlike(r"^\p{Lu}")))
    return F.slice(F.array_distinct(F.transform(named, F.lower)), 1, TERMS)


def shortlists(probes: DataFrame, archive: DataFrame, now: int | None = None, window: int = WINDOW, limit: int = CANDIDATES) -> DataFrame:
    """(a, b, place, score): up to ``limit`` reports b of the archive for each probe a, by BM25 over its terms, ties to the smaller b.

    ``probes``: (id, at, lang, terms). ``archive``: (id, at, lang, text, active), ``active`` being when the report's event last gained
    one, null for a report alone. A candidate shares a term, lies within ``window`` seconds, is not the probe, is of its
    language or of an unknown one (null), and its event was active in the 72 hours before ``now`` (by default the probe's
    time). Ids have to be distinct in the archive. A text's words are counted where it is read, so what is shuffled are its
    different words, once, and neither they nor what they meet are sorted: postings pass by the probes of their term and span
    of the window, which are the fewer rows. The scored terms of a pair are dealt by the probe, whose sums and places need no
    other shuffle.
    """
    cut = archive.select("id", "at", "lang", "active", words(F.coalesce("text", F.lit(""))).alias("w"))
    corpus = cut.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"))
    # reports whose event was closed to every probe near them are no candidates
    open_at = (F.lit(now) if now is not None else F.col("at") - window) - LIFETIME
    posted = _postings(cut.where(F.coalesce(F.col("active") >= open_at, F.lit(True))))
    # reports without an id count as one
    held = cut.select("id", F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg((F.count("id") + F.max(F.col("id").isNull().cast("int"))).alias("df"))
    asked = probes.select(F.col("id").alias("a"), F.col("at").alias("ta"), F.col("lang").alias("la"), F.explode(F.array_distinct("terms")).alias("term"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.join(held, "term").join(F.broadcast(corpus)).select("a", "ta", "la", "term", idf.alias("idf"))  # one row
    slot = lambda t: F.floor(F.col(t) / window)
    left = asked.withColumn("slot", F.explode(F.array(*(slot("ta") + k for k in (-1, 0, 1)))))
    right = posted.select(F.col("id").alias("b"), F.col("at").alias("tb"), F.col("lang").alias("lb"), "active", "tf", "length", F.col("term").alias("word"))
    since = (F.lit(now) if now is not None else F.col("ta")) - LIFETIME
    met = left.repartition(DEALT, "term", "slot").hint("shuffle_hash").join(right.repartition(DEALT, F.col("word"), slot("tb")), (F.col("term") == F.col("word")) & (F.col("slot") == slot("tb")))
    met = met.where((F.col("a") != F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= window) & F.coalesce(F.col("la") == F.col("lb"), F.lit(True)) & F.coalesce(F.col("active") >= since, F.lit(True)))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = met.join(F.broadcast(corpus)).select("a", "b", part.alias("part")).repartition(DEALT, "a").groupBy("a", "b").agg(F.round(F.sum("part"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return scored.withColumn("place", place).where(F.col("place") <= limit).select("a", "b", "place", "score")


def _postings(cut: DataFrame) -> DataFrame:
    """(id, at, lang, active, length, term, tf) of (id, at, lang, active, w), each row's words sorted and counted by themselves."""
    rows = cut.select("id", "at", "lang", "active", F.size("w").alias("length"), F.sort_array("w").alias("w"))
    first = F.transform("w", lambda x, i: F.when(~F.get("w", i - 1).eqNullSafe(x), F.struct(x.alias("term"), i.alias("i"))))
    rows = rows.withColumn("firsts", F.filter(first, lambda f: f.isNotNull())).drop("w")
    counted = F.transform("firsts", lambda f, k: F.struct(f["term"].alias("term"), (F.coalesce(F.get("firsts", k + 1)["i"], F.col("length")) - f["i"]).alias("tf")))
    return rows.select("id", "at", "lang", "active", "length", F.inline(counted))
