"""Date, decay and scale functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of time zones, those of RFC 822 among them, and their offsets.
ZONES = {"BST": "+0100", "IST": "+0530", "CET": "+0100", "CEST": "+0200", "EET": "+0200", "EEST": "+0300", "WET": "+0000", "WEST": "+0100", "MSK": "+0300", "JST": "+0900", "KST": "+0900", "HKT": "+0800", "SGT": "+0800", "AEST": "+1000", "AEDT": "+1100", "ACST": "+0930", "AWST": "+0800", "NZST": "+1200", "NZDT": "+1300", "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}

# Formats in Spark's pattern letters, in the order in which they are tried.
PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mmXXX",
    "d MMM yyyy HH:mm:ss XX", "d MMM yyyy HH:mm XX", "d MMM yyyy, HH:mm:ss XX", "d-MMM-yyyy HH:mm:ss XX",
    "yyyy-MM-dd HH:mm:ss XX", "yyyy-MM-dd HH:mm:ss", "MMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy",
)

# How texts that a group of the patterns can read begin, and how the group's patterns do. No text begins in two of these ways.
SHAPES = ((r"^[+-]?[0-9]+-[0-9]", "yyyy-"), (r"^[+-]?[0-9]+[ -][A-Za-z]", "d[ -]MMM"), (r"^[A-Za-z]+ [+-]?[0-9]", "MMM "))


def feed_date(raw: Column) -> Column:
    """The time a feed states, or null. Zone-less forms are UTC; a wrong weekday doesn't matter."""
    text = F.regexp_replace(F.btrim(raw), r"^[A-Za-z]+,\s*", "")
    zones = F.create_map(*[x for k, v in ZONES.items() for x in (F.lit(k), F.lit(v))])
    last = F.regexp_extract(text, r" ([A-Z]{2,4})$", 1)
    text = F.when(F.element_at(zones, last).isNotNull(), F.concat(F.regexp_replace(text, r" [A-Z]{2,4}$", " "), F.element_at(zones, last))).otherwise(text)
    # Dates in words whose year has two digits are of this century.
    text = F.regexp_replace(text, r"^([A-Za-z]+ +\d{1,2},|\d{1,2} +[A-Za-z]+) +(\d\d)(?= |$)", "$1 20$2")
    usable = F.when((F.length(text) > 0) & (F.octet_length(text) <= 512), text)
    # The text is named once, and a pattern is tried only on what begins as it does: a failed try costs an exception.
    tried = lambda t: F.coalesce(*(F.when(t.rlike(shape), F.coalesce(*(F.try_to_timestamp(t, F.lit(p)) for p in PATTERNS if re.match(starts, p)))) for shape, starts in SHAPES))
    return F.get(F.transform(F.array(usable), tried), 0)


def retry_seconds(header: Column, now: Column) -> Column:
    """Retry-After as seconds from now: a number, or an HTTP date; null where neither or past."""
    number = F.when(F.btrim(header).rlike(r"^\d{1,9}$"), F.btrim(header).try_cast("long"))
    until = F.unix_timestamp(feed_date(F.when(number.isNull(), header))) - F.unix_timestamp(now)
    return F.coalesce(number, F.get(F.filter(F.array(until), lambda s: s > 0), 0))  # the date is read once


def backoff_seconds(failures: Column) -> Column:
    """Ten minutes, doubled for each further failure, six hours at most."""
    return F.least(F.lit(6 * 3600), F.lit(600) * F.pow(F.lit(2), F.least(failures, F.lit(40)) - 1)).cast("long")


def recency_weight(age_days: Column) -> Column:
    # Weights of stories up to 2, 7, 14 and 30 days old, and older.
    return F.when(age_days < 2, 1.0).when(age_days < 7, 0.7).when(age_days < 14, 0.4).when(age_days < 30, 0.2).otherwise(0.1)


def half_life_alpha(elapsed: Column, half_life: float) -> Column:
    return -F.expm1(-F.log(F.lit(2.0)) * elapsed / half_life)


def decay(elapsed: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -elapsed / half_life)


def saturating(raw: Column, scale: float = 25.0) -> Column:
    """0 to 100, of a raw sum: 100 (1 - exp(-raw / scale))."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * (1 - F.exp(-raw / scale))))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def known_date(published: Column, now: Column) -> Column:
    """A publication more than a quarter of an hour ahead is unknown."""
    return F.when(published <= now + F.expr("INTERVAL 15 MINUTES"), published)


def edition_start(now: Column, hour: int) -> Column:
    """When the edition current at ``now`` was due: this day's edition hour (UTC), or the day before's until then."""
    due = F.date_trunc("day", now) + F.make_dt_interval(hours=F.lit(min(23, max(0, hour))))
    return F.when(due <= now, due).otherwise(due - F.expr("INTERVAL 1 DAY"))


def next_edition(now: Column, hour: int) -> Column:
    return edition_start(now, hour) + F.expr("INTERVAL 1 DAY")


def edition_is_current(selected: Column, now: Column, hour: int) -> Column:
    """A stored edition stays while it was selected at or after the one now due, and not later than now."""
    return (selected >= edition_start(now, hour)) & (selected <= now)


def window_start(now: Column, days: int = 30) -> Column:
    """The first day (UTC midnight) of the ``days`` that end with the day of ``now``."""
    return F.date_sub(F.to_date(now), days - 1)


def age_text(at: Column, now: Column) -> Column:
    """'Just now' in the first minute, minutes and hours in the first day, then month and day, with the year if it is another one; no date: 'Date unavailable'."""
    age = F.unix_seconds(now) - F.unix_seconds(at)
    day = F.concat(F.date_format(at, "MMM"), F.lit(" "), F.dayofmonth(at))
    return (
        F.when(at.isNull(), "Date unavailable").when(age < 60, "Just now").when(age < 3600, F.concat(F.floor(age / 60), F.lit(" min. ago")))
        .when(age < 86_400, F.concat(F.floor(age / 3600), F.lit(" hr. ago"))).when(F.year(at) == F.year(now), day).otherwise(F.concat(day, F.lit(", "), F.year(at)))
    )


def coverage_text(stories: Column, publishers: Column) -> Column:
    """Counts with their nouns: '3 stories · 1 publisher'."""
    return F.concat(stories, F.when(stories == 1, " story · ").otherwise(" stories · "), publishers, F.when(publishers == 1, " publisher").otherwise(" publishers"))
