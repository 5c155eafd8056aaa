"""Attributed quotes and their voices, and timelines of the dates that reports state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, words
from .windows import first_rows

NAME = r"\p{Lu}[\p{L}'’-]+(?:\s+\p{Lu}[\p{L}'’-]+){0,3}"
SAID = r"(?:said|says|told|added|adds|stated|warned|argued)"
QUOTE = r"[“\"]([^“”\"]{15,600})[”\"]"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Entries of a timeline at most, and distinct days that it needs.
ENTRIES, DAYS = 8, 2


def attributed(text: Column) -> Column:
    """(speaker, quote) of every quote in a text that a name before or after it is given with."""
    after, before = rf"{QUOTE}[,.]?\s+{SAID}\s+({NAME})", rf"({NAME})\s+{SAID}(?:\s+\w+)?[,:]?\s+{QUOTE}"
    found = lambda p, s, q: F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(s)).alias("speaker"), F.regexp_extract_all(text, F.lit(p), F.lit(q)).alias("quote"))
    told = rf"{QUOTE}[,.]?\s+({NAME})\s+{SAID}"
    both = F.concat(found(after, 2, 1), found(told, 2, 1), found(before, 1, 2))
    return F.array_distinct(F.transform(both, lambda x: F.struct(F.regexp_replace(x["speaker"], r"\s+", " ").alias("speaker"), F.btrim(F.rtrim(x["quote"]), F.lit(" ,")).alias("quote"))))


def voices(reports: DataFrame, key: str) -> DataFrame:
    """(key, voice, quote, n_reports): distinct quotes of each voice from reports (key, id, text).

    A surname alone is the voice of the one full name of the event that ends in it; with none or several such names it stays itself.
    A quote counts once a voice, by its words, however many reports carry it; its first form in order is shown.
    """
    q = reports.select(key, "id", F.explode(attributed(F.col("text"))).alias("x")).select(key, "id", "x.speaker", "x.quote")
    q = q.withColumns({"last": F.substring_index("speaker", " ", -1), "full": F.instr("speaker", " ") > 0})
    names = q.where("full").groupBy(key, "last").agg(F.count_distinct("speaker").alias("n"), F.min("speaker").alias("only")).where("n = 1").select(key, "last", "only")
    named = q.join(names, [key, "last"], "left").withColumn("voice", F.when(F.col("full"), F.col("speaker")).otherwise(F.coalesce("only", "speaker")))
    g = named.groupBy(key, "voice", F.array_join(words(F.col("quote")), " ").alias("said"))
    return g.agg(F.min("quote").alias("quote"), F.count_distinct("id").alias("n_reports")).select(key, "voice", "quote", "n_reports")


def _month(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name))
    return F.when(at > 0, F.lpad(at.cast("string"), 2, "0"))


def stated_date(sentence: Column, published: Column) -> Column:
    """The day that a sentence states, given its publication: a date in figures or words, the first of a range, or one told from the publication.

    'yesterday', 'today' and 'tomorrow' count from the publication, 'on Monday' is the latest Monday up to it. Null for none.
    """
    months = "(" + "|".join(MONTHS) + ")"
    part = lambda p, k: F.regexp_extract(sentence, p, k)
    iso = F.nullif(part(r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.lit(""))
    dmy, mdy, span = rf"(?i)\b(\d{{1,2}})\s+{months}\s+(\d{{4}})\b", rf"(?i)\b{months}\s+(\d{{1,2}}),\s+(\d{{4}})\b", rf"(?i)\b(\d{{1,2}})\s*(?:-|–|to)\s*\d{{1,2}}\s+{months}\s+(\d{{4}})\b"
    made = lambda p, d, m, y: F.concat_ws("-", F.nullif(part(p, y), F.lit("")), _month(part(p, m)), F.lpad(F.nullif(part(p, d), F.lit("")), 2, "0"))
    plain = F.coalesce(iso, F.when(sentence.rlike(span), made(span, 1, 2, 3)), F.when(sentence.rlike(dmy), made(dmy, 1, 2, 3)), F.when(sentence.rlike(mdy), made(mdy, 2, 1, 3)))
    low = F.lower(sentence)
    day = F.to_date(published)
    named = F.regexp_extract(low, r"\bon (" + "|".join(WEEKDAYS) + r")\b", 1)
    back = F.pmod(F.weekday(day) - (F.array_position(F.array(*map(F.lit, WEEKDAYS)), named).cast("int") - 1), F.lit(7))
    told = F.when(low.rlike(r"\byesterday\b"), F.date_sub(day, 1)).when(low.rlike(r"\btoday\b"), day).when(low.rlike(r"\btomorrow\b"), F.date_add(day, 1)).when(named != "", F.date_sub(day, back))
    return F.coalesce(plain.try_cast("date"), told)


def timeline(reports: DataFrame, key: str) -> DataFrame:
    """(key, day, sentence, publishers): what happened when, from reports (key, id, publisher, published, text).

    Sentences of a day that are the same words are one entry, told by so many publishers; of a day the entry with most
    publishers stands, then the earliest published. ENTRIES days at most, those with most publishers; an event that states
    fewer than DAYS distinct days has no timeline.
    """
    s = reports.select(key, "id", "publisher", "published", F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("i", "sentence"))
    s = s.withColumn("day", stated_date(F.col("sentence"), F.col("published"))).where("day IS NOT NULL")
    g = s.groupBy(key, "day", F.array_join(words(F.col("sentence")), " ").alias("said")).agg(F.count_distinct("publisher").alias("publishers"), F.min(F.struct("published", "id", "i", "sentence")).alias("first"))
    one = first_rows(g, [key, "day"], [F.desc("publishers"), F.asc("first")])
    kept = first_rows(one, [key], [F.desc("publishers"), F.asc("day")], ENTRIES)
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(F.col("_n") >= DAYS).select(key, "day", F.col("first.sentence").alias("sentence"), "publishers")
