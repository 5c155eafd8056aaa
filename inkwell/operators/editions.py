"""What places a story in an edition: its kind of content, how sure each lane is of it, how well it fits a reader's profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_phrase, padded_phrase, words

# Phrases, address parts and title beginnings of each kind of content, and how sure they are.
INVESTIGATION = ["special report", "deep dive", "exclusive investigation", "an investigation by", "months long investigation", "documents reveal", "inside how"]
EXPLAINER = ["explainer", "explained", "how it works", "why it matters", "what to know", "what you need to know", "everything you need to know", "guide to", "q&a"]
OPINION = ["opinion", "editorial", "commentary", "op ed", "columnist", "my view", "letters to the editor", "perspective", "viewpoint", "analysis and opinion"]
ADDRESSES = {"investigation": r"/investigation|/special-report", "explainer": "/explainer", "opinion": "/opinion|/editorial|/commentisfree"}
SURE = {"investigation": 0.85, "explainer": 0.80, "opinion": 0.85}
OPINION_IN_SUMMARY = 0.72


def content_kind(title: Column, summary: Column, category: Column, link: Column) -> Column:
    """struct(kind, confidence) of a report by its headline, summary, section and address; null where nothing tells it. Nulls count as empty."""
    title, summary, category, link = (F.coalesce(c, F.lit("")) for c in (title, summary, category, link))
    raw, low, in_title, in_summary = F.lower(F.concat_ws(" ", title, summary, category, link)), F.lower(title), padded_phrase(title), padded_phrase(summary)
    both = lambda phrases: any_phrase(in_title, phrases) | any_phrase(in_summary, phrases)
    said = lambda kind, sure=None: F.struct(F.lit(kind).alias("kind"), F.lit(sure or SURE[kind]).alias("confidence"))
    found = lambda kind: raw.rlike(ADDRESSES[kind])
    return (
        F.when(found("investigation") | low.startswith("investigation:") | both(INVESTIGATION), said("investigation"))
        .when(found("explainer") | both(EXPLAINER) | low.startswith("explainer:") | (low.startswith("how ") & title.contains("?")), said("explainer"))
        .when(found("opinion") | F.lower(category).contains("opinion") | any_phrase(in_title, OPINION) | any_phrase(padded_phrase(category), OPINION), said("opinion"))
        .when(any_phrase(in_summary, OPINION), said("opinion", OPINION_IN_SUMMARY))
    )


def reading_minutes(texts: list[Column], words_per_minute: float = 200.0) -> Column:
    """Minutes to read the longest of a story's texts."""
    count = lambda t: F.size(F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w != ""))
    counts = [count(t) for t in texts]
    return (F.greatest(*counts) if len(counts) > 1 else counts[0]) / words_per_minute


def _held(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def lead_confidence(reports: Column, score: Column) -> Column:
    return F.least(F.lit(1.0), 0.30 + F.least(F.lit(1.0), reports / 3.0) * 0.45 + _held(score) * 0.25)


def in_motion_confidence(updated: Column, moving: Column, grouping: Column, publishers: Column) -> Column:
    return F.when(~(updated & moving), 0.30).when((grouping >= 0.70) | (publishers >= 3), 0.88).otherwise(0.75)


def deep_read_confidence(kind_confidence: Column, minutes: Column) -> Column:
    return F.greatest(F.coalesce(kind_confidence, F.lit(0.0)), F.when(minutes >= 12, 0.88).when(minutes >= 8, 0.75).otherwise(0.0))


def your_beat_confidence(starred: Column, affinity: Column, match: Column) -> Column:
    return F.greatest(F.when(starred, 0.90).otherwise(0.0), F.when(affinity, 0.78).otherwise(0.0), F.when(match >= 0.50, F.least(F.lit(0.95), 0.55 + match * 0.40)).otherwise(0.0))


def outside_confidence(novelty: Column, score: Column) -> Column:
    return F.when((novelty < 0.60) | (score < 0.35), 0.25).otherwise(F.least(F.lit(0.92), 0.45 + novelty * 0.30 + score * 0.20))


def interest(stories: DataFrame, profiles: DataFrame) -> DataFrame:
    """(reader, id, match, novelty) of stories (reader, id, entities, title, category) against ``profiles`` (reader, kind, key, weight).

    ``kind`` is entity, keyword or category. The entity signal is the weight of the story's entities over 1.15 of the heaviest
    (two at least); the keyword signal is that of its title's words over 0.3 of the heaviest for each (three at least); a category's
    share counts up to 0.18. The larger of the first two counts 0.75, the smaller 0.15. Readers without a profile match nothing and
    find nothing new. Stories meet a profile by equal keys, a row a key; ids have to be distinct for a reader.
    """
    heaviest = profiles.groupBy("reader").agg(
        *(F.max(F.when(F.col("kind") == k, F.col("weight"))).alias(f"top_{k}") for k in ("entity", "keyword")), F.sum(F.when(F.col("kind") == "category", F.col("weight"))).alias("all_category"), F.count("*").alias("n_known")
    )
    title = F.array_distinct(words(F.coalesce("title", F.lit(""))))
    keys = F.concat(
        F.transform(F.array_distinct(F.coalesce("entities", F.array().cast("array<string>"))), lambda e: F.struct(F.lit("entity").alias("kind"), e.alias("key"))),
        F.transform(title, lambda w: F.struct(F.lit("keyword").alias("kind"), w.alias("key"))),
        F.array(F.struct(F.lit("category").alias("kind"), F.lower(F.coalesce("category", F.lit(""))).alias("key"))),
    )
    met = stories.select("reader", "id", F.explode(keys).alias("k")).select("reader", "id", "k.*").join(profiles, ["reader", "kind", "key"])
    sums = met.groupBy("reader", "id").agg(*(F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0.0)).alias(f"w_{k}") for k in ("entity", "keyword", "category")))
    s = stories.select("reader", "id", F.size(title).alias("n_words")).join(sums, ["reader", "id"], "left").join(heaviest, "reader", "left").na.fill(0.0, [f"w_{k}" for k in ("entity", "keyword", "category")])
    most = lambda k: F.greatest(F.lit(1.0), F.coalesce(f"top_{k}", F.lit(0.0)))
    by_entity = F.least(F.lit(1.0), F.col("w_entity") / F.greatest(F.lit(2.0), most("entity") * 1.15))
    by_word = F.least(F.lit(1.0), F.col("w_keyword") / F.greatest(F.lit(2.0), F.greatest(F.lit(3.0), F.col("n_words").cast("double")) * most("keyword") * 0.30))
    by_class = F.least(F.lit(0.18), F.col("w_category") / F.greatest(F.lit(1.0), F.coalesce("all_category", F.lit(0.0))) * 0.45)
    match = F.when(F.col("n_known").isNull(), 0.0).otherwise(_held(F.greatest(by_entity, by_word) * 0.75 + F.least(by_entity, by_word) * 0.15 + by_class))
    return s.select("reader", "id", match.alias("match"), F.when(F.col("n_known").isNull(), 0.0).otherwise(_held(1 - match)).alias("novelty"))
