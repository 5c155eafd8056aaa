"""Word, phrase and shingle functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased words of letters and numbers; diacritics count."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def _folding() -> tuple[str, str]:
    """Latin letters with diacritics and their bare forms, from the Unicode decompositions."""
    plain = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base != chr(code):
            plain[chr(code)] = base
    return "".join(plain), "".join(plain.values())


def folded(text: Column) -> Column:
    """Lower case without Latin diacritics or combining marks."""
    marked, bare = _folding()
    return F.lower(F.translate(F.regexp_replace(text, r"\p{Mn}", ""), marked, bare))


def folded_words(text: Column) -> Column:
    return F.filter(F.split(folded(text), NOT_WORD), lambda w: w != "")


def phrase(text: Column) -> Column:
    return F.array_join(words(text), " ")


def padded_phrase(text: Column) -> Column:
    """The phrase between single spaces: containment of padded phrases is whole-word containment."""
    return F.concat(F.lit(" "), phrase(text), F.lit(" "))


def plain_phrase(raw: str) -> str:
    """The phrase of a parameter, on the driver."""
    return " ".join("".join(c if c.isalnum() else " " for c in raw.lower()).split())


def has_phrase(padded: Column, raw: str) -> Column:
    return padded.contains(f" {plain_phrase(raw)} ")


def any_phrase(padded: Column, raws: list[str]) -> Column:
    found = F.lit(False)
    for raw in raws:
        found = found | has_phrase(padded, raw)
    return found


def like_escaped(raw: str) -> str:
    """A parameter with LIKE's wildcards escaped by a backslash."""
    return raw.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def sentences(text: Column) -> Column:
    """Sentences cut after a full stop, question or exclamation mark before white space, and at line ends."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.btrim(s)), lambda s: s != "")


def shingles(tokens: Column, width: int) -> Column:
    """Distinct runs of ``width`` tokens, joined by spaces; none where there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (width - 1)), lambda i: F.array_join(F.slice(tokens, i, width), " "))
    return F.when(F.size(tokens) >= width, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; null where both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def containment(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(0))


def dice(a: Column, b: Column) -> Column:
    return 2 * F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)), F.lit(0))


def cosine_of_sets(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.sqrt(F.size(F.array_distinct(a)) * F.size(F.array_distinct(b))), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Model tokens of a text: 1.3 a word and 0.5 a punctuation mark; mostly non-ASCII text counts half its characters."""
    n = F.length(text)
    n_words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    punctuation = F.length(text) - F.length(F.regexp_replace(text, r"[\p{P}]", ""))
    foreign = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.when(foreign > 0.3 * n, F.ceil(n / 2)).otherwise(F.ceil(1.3 * n_words + 0.5 * punctuation)).cast("long")


# Number words.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")


def digits_for_number_words(tokens: Column) -> Column:
    """Words with number words up to twenty as digits."""
    known = F.create_map(*[x for i, w in enumerate(NUMBER_WORDS) for x in (F.lit(w), F.lit(str(i)))])
    return F.transform(tokens, lambda w: F.coalesce(F.element_at(known, w), w))


def slug(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.array_join(folded_words(name), "-"))
