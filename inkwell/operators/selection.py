"""Choosing passages: highlights, token budgets, novel sentences, accounts to compare, material headline changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine_of_sets, dice, sentences, token_estimate, words
from .windows import first_rows, ordered_fold

#: Candidate sentences of a passage, and earlier passages it is held against: features of the operator.
MAX_SENTENCES, MAX_PASSAGES = 32, 256


def _repeats(new: frozenset, chosen: list[frozenset]) -> bool:
    """Half of the words in common, or seven tenths of the shorter statement if that has five words."""
    for old in chosen:
        shared = len(new & old)
        if shared * 2 >= len(new | old) and (new or old):
            return True
        least = min(len(new), len(old))
        if least >= 5 and shared >= 0.7 * least:
            return True
    return False


def highlights(facts: DataFrame, key: str, keep: int = 5) -> DataFrame:
    """(key, id): up to ``keep`` statements of each event from (key, id, source, statement, headline).

    Statements of five words or more, most words of four letters in common with the headline first, then by id.
    What mostly repeats a chosen one is skipped. Each source's best statement is taken before any second one: the
    statements are gone through twice, streamed, with the chosen ones as state.
    """
    long = lambda c: F.array_distinct(F.filter(words(c), lambda w: F.length(w) >= 4))
    rows = facts.where(F.size(F.filter(F.split("statement", r"\s+"), lambda w: w != "")) >= 5)
    rows = rows.select(key, "id", "source", long(F.col("statement")).alias("w"), F.size(F.array_intersect(long(F.col("statement")), long(F.col("headline")))).alias("n"))
    both = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"), (-F.col("n")).alias("order"))

    def step(state, row):
        chosen, sources, taken = state
        turn, source, w, i = row
        new = frozenset(w)
        if len(chosen) >= keep or i in taken or (turn == 0 and source in sources) or _repeats(new, chosen):
            return state, None
        return ([*chosen, new], sources | {source}, taken | {i}), (True,)

    picked = ordered_fold(both, [key], ["turn", "order", "id"], ["turn", "source", "w", "id"], step, ([], frozenset(), frozenset()), "chosen boolean")
    return picked.select(key, "id")


def within_budget(passages: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, id, form, tokens): the best passages (key, id, score, text) that fit a budget of estimated tokens.

    In order of score, then id, passages go in whole while their running sum fits. From the first that doesn't on, each is cut to
    its first sentence, as long as these still fit; the rest is left out.
    """
    order = [F.desc("score"), F.asc("id")]
    lead = F.coalesce(F.element_at(sentences(F.col("text")), 1), F.lit(""))
    rows = passages.select(key, "id", "score", token_estimate(F.col("text")).alias("whole"), token_estimate(lead).alias("lead"))
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("fits", F.sum("whole").over(upto) <= budget)
    rows = rows.withColumn("used", F.sum(F.when(F.col("fits"), F.col("whole")).otherwise(F.col("lead"))).over(upto))
    return rows.where(F.col("used") <= budget).select(key, "id", F.when(F.col("fits"), "whole").otherwise("lead").alias("form"), F.when(F.col("fits"), F.col("whole")).otherwise(F.col("lead")).alias("tokens"))


def novel_sentence(passages: DataFrame, key: str, repeat: float = 0.75, lexical: float = 0.6) -> DataFrame:
    """(key, at, sentence, distance): of each passage (key, at, text) the sentence farthest from what the event had before.

    A sentence's distance is 1 less its largest cosine with an earlier passage of the event (the newest MAX_PASSAGES count). One
    that is close to a passage and shares most of its words with it repeats, and is skipped. Passages without earlier ones give none.
    """
    p = passages.select(key, "at", "text").withColumn("w", F.array_distinct(words(F.col("text"))))
    cut = p.select(key, "at", F.posexplode(sentences(F.col("text"))).alias("i", "sentence")).where(F.col("i") < MAX_SENTENCES).withColumn("sw", F.array_distinct(words(F.col("sentence")))).where(F.size("sw") > 0)
    number = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    ranks = p.select(key, "at", number.alias("n"))
    a, b = cut.join(ranks, [key, "at"]), p.join(ranks, [key, "at"]).select(F.col(key).alias("_k"), F.col("n").alias("m"), F.col("w").alias("pw"))
    met = a.join(b, (F.col(key) == F.col("_k")) & (F.col("m") < F.col("n")) & (F.col("m") >= F.col("n") - MAX_PASSAGES))
    cosine = F.coalesce(cosine_of_sets(F.col("sw"), F.col("pw")), F.lit(0.0))
    met = met.select(key, "at", "i", "sentence", cosine.alias("c"), (F.size(F.array_intersect("sw", "pw")) / F.size("sw")).alias("o"))
    g = met.groupBy(key, "at", "i").agg(F.first("sentence").alias("sentence"), F.max("c").alias("c"), F.bool_or((F.col("c") >= repeat) & (F.col("o") >= lexical)).alias("bad")).where("NOT bad")
    best = F.max_by(F.struct("sentence", (1 - F.col("c")).alias("distance")), F.struct((1 - F.col("c")).alias("d"), (-F.col("i")).alias("i")))
    return g.groupBy(key, "at").agg(best.alias("b")).select(key, "at", "b.sentence", "b.distance")


def accounts(reports: DataFrame, key: str, least: int = 60) -> DataFrame:
    """(key, publisher, id, n_words): the fullest report of each publisher (key, publisher, id, text) of ``least`` words or more.

    Ties go to the smallest id. Events with fewer than two such publishers have nothing to compare and give none.
    """
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    rich = reports.select(key, "publisher", "id", n.cast("long").alias("n_words")).where(F.col("n_words") >= least)
    one = first_rows(rich, [key, "publisher"], [F.desc("n_words"), F.asc("id")])
    return one.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n >= 2").drop("_n")


def material_change(tokens: Column, known: Column) -> Column:
    """Whether a headline's words say something that none of the known headlines' word sets says."""

    def same(k: Column) -> Column:
        shared, fresh = F.size(F.array_intersect(tokens, k)), F.size(F.array_except(tokens, k))
        return (F.size(k) > 0) & ((F.coalesce(dice(tokens, k), F.lit(0.0)) >= 0.60) | ((shared >= 3) & (fresh <= 1) & (fresh / F.size(tokens) < 0.35)))

    return (F.size(tokens) > 0) & ~F.exists(known, same)


def updated(reports: DataFrame, key: str, now: int, window: int = 86_400) -> DataFrame:
    """(key, updated): whether a report (key, at, title) of the last ``window`` seconds says something that none before it said.

    An event whose reports all fall inside the window is new, not updated. The known headlines of an event are its distinct word sets.
    """
    t = reports.where(F.col("at") <= now + 300).select(key, (F.col("at") >= now - window).alias("fresh"), F.array_sort(F.array_distinct(words(F.col("title")))).alias("t"))
    known = t.where("NOT fresh").groupBy(key).agg(F.collect_set("t").alias("known"))
    new = t.where("fresh").select(key, "t").distinct().join(known, key).groupBy(key).agg(F.bool_or(material_change(F.col("t"), F.col("known"))).alias("said"))
    return t.select(key).distinct().join(new, key, "left").select(key, F.coalesce("said", F.lit(False)).alias("updated"))
