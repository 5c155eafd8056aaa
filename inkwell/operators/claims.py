"""Checks of a claim against the source it cites: who speaks, what is quoted, what was done, what is denied or left uncertain.

Each claim is held against the source's sentence that shares most words with it, in the row itself: nothing is shuffled.
Sentences are cut into reported clauses of speaker, reporting verb and content by the verbs' places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded_words, sentences
from .quantities import quantities, stated_dates, unsupported_dates, unsupported_quantities

# Cue words of the checks.
REPORTING = ("said", "says", "told", "tells", "called", "calls", "asked", "asks", "spoke", "speaks", "stated", "states", "declared", "declares", "shouted", "wrote", "writes", "explained", "explains", "added", "adds", "warned", "warns", "remarked", "hailed", "promised", "promises", "announced", "announces", "claimed", "claims", "alleged", "alleges", "insisted", "insists", "argued", "argues", "reported", "reports", "accused", "accuses", "denied", "denies", "acknowledged", "acknowledges", "confirmed", "confirms", "according")
ROLES = ("spokesperson", "spokesman", "spokeswoman", "minister", "ministry", "president", "official", "officials", "office", "police", "prosecutor", "prosecutors", "army", "military", "government", "commander", "governor", "mayor", "chief", "director", "agency", "court", "judge", "authorities", "department", "council", "union", "unions", "organisers", "organizers")
NOT_NAMES = ("the", "a", "an", "he", "she", "they", "it", "we", "i", "you", "this", "that", "these", "those", "his", "her", "their", "its", "our", "my", "your", "in", "on", "at", "but", "and", "after", "before", "when", "while", "as", "for", "with", "by", "from", "of", "to", "if", "there", "some", "many", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december")
NEGATING = ("not", "no", "never", "neither", "nor", "none", "cannot", "refused", "denied", "rejected", "не", "ні", "ніколи", "жоден", "відмовився", "відхилив", "заперечив")
ATTRIBUTING = ("announced", "said", "stated", "claimed", "reported", "according to")
HEDGING = ("may", "might", "could", "reportedly", "allegedly", "alleged", "possibly", "probably", "likely", "suspected", "appears", "apparently", "suggests", "believed")
FIRST_PERSON = ("i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves")
UNQUOTED_FIRST_PERSON = ("we", "We", "our", "Our", "ours", "us", "my", "My", "me", "myself", "ourselves")
CONTESTED = r"in order to|feared|sought to|\b(destroyed|\d+.*targets (had been|were) destroyed|intercepted)\b|ceasing operations|closing its operations|ended its duties"
ACTIONS = r"(?i)\b(arrest|detain|charge|indict|convict|sentence|jail|imprison|summon|kill|wound|injure|resign|dismiss|expel|deport|execute|sue)(?:s|d|ed|es|ing|led)?\b"
DOUBLE, SINGLE = r"[\"“]([^\"”]+)[\"”]", r"(?<![\p{L}\p{N}])['‘]([^'’]+)['’](?![\p{L}\p{N}])"
#: Words on either side of a reporting verb where its speaker is sought; wider where a dropped speaker is.
REACH, WIDE = 4, 6
#: Words that a claim copies from a quotation before it passes for the claim's own.
COPIED = 8


def cased_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def negation_words(text: Column) -> Column:
    """Folded words, contractions of "not" spelled out."""
    return folded_words(F.regexp_replace(text, "(?i)n['’]t\\b", " not"))


def quotations(text: Column) -> Column:
    """What stands between double quotes, then between single ones that are no apostrophes."""
    return F.concat(F.regexp_extract_all(text, F.lit(DOUBLE), F.lit(1)), F.regexp_extract_all(F.regexp_replace(text, DOUBLE, " "), F.lit(SINGLE), F.lit(1)))


def outside_quotations(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, DOUBLE, " "), SINGLE, " ")


def _names_a_speaker(w: Column) -> Column:
    low = F.lower(w)
    return low.isin(*ROLES) | (w.rlike(r"^\p{Lu}") & ~low.isin(*NOT_NAMES) & ~low.isin(*REPORTING))


def reporting_construction(ws: Column) -> Column:
    """Whether words (with their case) hold a reporting verb and someone it can point at."""
    return F.exists(ws, lambda w: F.lower(w).isin(*REPORTING)) & F.exists(ws, _names_a_speaker)


def reported_speakers(ws: Column, reach: int = REACH) -> Column:
    """Lower-cased names and roles within ``reach`` words before each reporting verb, or after it where none is before or the verb is "according"."""
    at = F.filter(F.transform(ws, lambda w, i: F.when(F.lower(w).isin(*REPORTING), i)), lambda i: i.isNotNull())

    def of(i: Column) -> Column:
        before = F.filter(F.slice(ws, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), _names_a_speaker)
        after = F.filter(F.slice(ws, i + 2, F.lit(reach)), _names_a_speaker)
        return F.when((F.lower(F.get(ws, i)) == "according") | (F.size(before) == 0), after).otherwise(before)

    return F.array_distinct(F.transform(F.flatten(F.transform(at, of)), F.lower))


def closest_sentence(claim: Column, source: Column) -> Column:
    """The source's sentence that shares most distinct words with the claim, the first of equals; the source itself if it has none."""
    mine = F.array_distinct(folded_words(claim))
    best = F.array_max(F.transform(sentences(source), lambda s, i: F.struct(F.size(F.array_intersect(mine, folded_words(s))).alias("n"), (-i).alias("i"), s.alias("s"))))
    return F.coalesce(best["s"], source)


def _padded(ws: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))


def claim_failures(df: DataFrame, id_cols: list[str], claim: str, source: str, tolerance: float = 0.0) -> DataFrame:
    """(ids, closest, failures): the source's closest sentence, and by name what speaks against each claim, in a fixed order.

    quantity, date: a figure or day that the source does not state (in any unit, within ``tolerance``). negation: denied on
    one side only. hedge: uncertain in the source only. speaker: someone else speaks. attribution: a speaker the source does not know.
    dropped_attribution: a contested statement without the speaker it came from. detached_quotation: speech without a
    speaker. misquoted: a reporting clause moved into quotation marks. quotation_as_fact: eight words of a quotation as
    the claim's own. action: a legal or physical act that the source does not report. Null texts count as empty; a
    claim without words fails nothing.
    """
    c, s = F.coalesce(F.col(claim), F.lit("")), F.coalesce(F.col(source), F.lit(""))
    # In steps, so that each part is worked out once a row.
    at = df.select(*id_cols, c.alias("_c"), s.alias("_s")).select("*", closest_sentence(F.col("_c"), F.col("_s")).alias("closest"))
    at = at.select("*", cased_words(F.col("_c")).alias("_cw"), cased_words(F.col("closest")).alias("_nw"), negation_words(F.col("_c")).alias("_cn"), negation_words(F.col("closest")).alias("_nn"), quotations(F.col("_c")).alias("_cq"), quotations(F.col("_s")).alias("_sq"))
    at = at.select("*", reported_speakers(F.col("_cw")).alias("_cs"), reported_speakers(F.col("_nw")).alias("_ns"), reported_speakers(F.col("_nw"), WIDE).alias("_ws"), _padded(folded_words(F.col("_c"))).alias("_cp"), _padded(folded_words(F.col("_s"))).alias("_sp"))
    at = at.withColumn("_ps", F.when(F.size("_ns") == 0, reported_speakers(cased_words(F.col("_s")))).otherwise(F.col("_ns")))
    denied = lambda ws: F.exists(ws, lambda w: w.isin(*NEGATING))
    unsure = lambda ws: F.exists(ws, lambda w: w.isin(*HEDGING))
    reporting = reporting_construction(F.col("_cw"))
    who = F.regexp_extract("_c", r"(?i)^(.*?)\b(?:" + "|".join(ATTRIBUTING) + r")\b", 1)
    entity = F.array_join(F.slice(folded_words(who), F.greatest(F.size(folded_words(who)) - 2, F.lit(1)), 3), " ")
    lower = F.transform("_cw", F.lower)
    quoted_first_person = F.exists("_cq", lambda q: F.exists(folded_words(q), lambda w: w.isin(*FIRST_PERSON)))
    outside = cased_words(outside_quotations(F.col("_c")))
    detached = F.when(F.size("_cq") == 0, F.exists("_cw", lambda w: w.isin(*UNQUOTED_FIRST_PERSON)) & (F.size("_cs") == 0)).otherwise((F.size(outside) == 0) | (quoted_first_person & ~reporting_construction(outside)))
    moved = F.exists("_cq", lambda q: reporting_construction(cased_words(q)) & ~F.exists("_sq", lambda p: _padded(folded_words(p)).contains(_padded(folded_words(q)))))
    copied = lambda q: F.exists(F.sequence(F.lit(1), F.greatest(F.size(q) - (COPIED - 1), F.lit(1))), lambda i: (F.size(q) >= COPIED) & F.col("_cp").contains(_padded(F.slice(q, i, F.lit(COPIED)))))
    acts = lambda t: F.transform(F.regexp_extract_all(t, F.lit(ACTIONS), F.lit(1)), F.lower)
    figures = F.col("_c").rlike("[0-9]")  # a claim without a digit states no quantity and no date
    tests = {
        "quantity": figures & (F.size(unsupported_quantities(quantities(F.col("_c")), quantities(F.col("_s")), tolerance)) > 0),
        "date": figures & (F.size(unsupported_dates(stated_dates(F.col("_c")), stated_dates(F.col("_s")))) > 0),
        "negation": denied(F.col("_cn")) != denied(F.col("_nn")),
        "hedge": unsure(F.col("_nn")) & ~unsure(F.col("_cn")),
        "speaker": (F.size("_cs") > 0) & ~F.arrays_overlap("_cs", "_ps"),
        "attribution": (entity != "") & ~F.col("_sp").contains(F.concat(F.lit(" "), entity, F.lit(" "))),
        "dropped_attribution": F.lower("_c").rlike(CONTESTED) & (F.size("_ws") > 0) & ~(reporting & F.arrays_overlap(lower, "_ws")),
        "detached_quotation": detached,
        "misquoted": moved,
        "quotation_as_fact": (F.size("_cq") == 0) & ~reporting & F.exists("_sq", lambda q: copied(folded_words(q))),
        "action": F.size(F.array_except(acts(F.col("_c")), acts(F.col("_s")))) > 0,
    }
    failures = F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda k: k.isNotNull())
    return at.select(*id_cols, "closest", F.when(F.size("_cw") > 0, failures).otherwise(F.array().cast("array<string>")).alias("failures"))
