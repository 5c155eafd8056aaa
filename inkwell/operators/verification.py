"""Checks of derived text against its sources: grounding, numbers, negation, hedges, notes, citations, sentence diffs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import padded_phrase, sentences, words

# Cue words of the checks.
NEGATIONS = ("no", "not", "never", "none", "without", "nor", "cannot", "denied", "neither")
HEDGES = ("may", "might", "could", "reportedly", "allegedly", "possibly", "likely", "suggests", "appears", "about", "around")
SCHEDULED = r"\b(scheduled|will be held|is set for|takes place|due on)\b"
EXPECTED = r"\b(expected to|plans to|is likely to|will)\b"
CONDITIONAL = r"\b(if|unless|could|might|provided that)\b"
FORECASTS = r"\b(forecast|outlook|should buy|should sell|price target|we recommend|is expected to)\b"
FINANCIAL = r"[$€£%]|\b(percent|million|billion|revenue|profit|shares)\b"
#: Cells of a sentence diff's table at most; longer pairs are compared as sets, in order.
CELLS = 4_000_000


def quote_grounded(claim: Column, source: Column) -> Column:
    """Whether the claim's words stand in the source in their order; a claim without words is not grounded."""
    p = padded_phrase(claim)
    return (F.length(p) > 2) & padded_phrase(source).contains(p)


def numbers(text: Column) -> Column:
    """Distinct numbers as written, thousands commas dropped."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(""))))


def unsupported_numbers(claim: Column, source: Column) -> Column:
    return F.array_except(numbers(claim), numbers(source))


def has_any(tokens: Column, cues: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, cues)))


def closest_sentences(df: DataFrame, id_cols: list[str], claim: str, source: str) -> DataFrame:
    """(ids, claim, closest, shared): the source's sentence that shares most words with the claim, the first of equals.

    Claims or sources without words give no row.
    """
    rows = df.select(*id_cols, claim, F.array_distinct(words(F.col(claim))).alias("_c"), F.posexplode(sentences(F.col(source))).alias("_i", "_s"))
    rows = rows.withColumn("shared", F.size(F.array_intersect("_c", words(F.col("_s"))))).where("shared > 0")
    best = F.max_by(F.struct(F.col("_s").alias("closest"), "shared"), F.struct("shared", (-F.col("_i")).alias("i")))
    return rows.groupBy(*id_cols).agg(F.first(claim).alias(claim), best.alias("b")).select(*id_cols, claim, "b.closest", "b.shared")


def fidelity(df: DataFrame, id_cols: list[str], claim: str, source: str) -> DataFrame:
    """Each claim with its closest sentence and what speaks against it: negation_flip, hedge_dropped."""
    near = closest_sentences(df, id_cols, claim, source)
    c, s = words(F.col(claim)), words(F.col("closest"))
    flip = has_any(c, NEGATIONS) != has_any(s, NEGATIONS)
    dropped = has_any(s, HEDGES) & ~has_any(c, HEDGES)
    return near.select(*id_cols, "closest", "shared", flip.alias("negation_flip"), dropped.alias("hedge_dropped"))


def forward_kind(sentence: Column) -> Column:
    """scheduled, expected or conditional; null for a sentence that looks nowhere ahead. A condition outranks the rest."""
    low = F.lower(sentence)
    return F.when(low.rlike(CONDITIONAL), "conditional").when(low.rlike(SCHEDULED), "scheduled").when(low.rlike(EXPECTED), "expected")


def thematic(sentence: Column) -> Column:
    """A fact with a financial or quantitative marker and no forecast or advice."""
    low = F.lower(sentence)
    return low.rlike(FINANCIAL) & ~low.rlike(FORECASTS)


def note_place(text: Column, selected: Column, prefix: Column, suffix: Column) -> Column:
    """The place (from 1) where a note's quote stands, null where it doesn't.

    A place with both neighbours is best, then one with the prefix or the suffix, then the first.
    """
    at = lambda before, after, shift: F.nullif(F.instr(text, F.concat(before, selected, after)), F.lit(0)) + shift
    none, pad = F.lit(""), F.length(prefix)
    return F.when(F.length(selected) > 0, F.coalesce(at(prefix, suffix, pad), at(prefix, none, pad), at(none, suffix, F.lit(0)), at(none, none, F.lit(0))))


def citation_match(quote: Column, block: Column, least: float = 0.6) -> Column:
    """Whether a block holds a quote, or enough of its distinct words."""
    q = F.array_distinct(words(quote))
    return quote_grounded(quote, block) | (F.coalesce(F.size(F.array_intersect(q, words(block))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0)) >= least)


def sanitized(text: Column) -> Column:
    """Text without marks that could pass for a prompt's delimiters or roles."""
    bare = F.regexp_replace(text, r"(?i)</?\s*(system|assistant|user|instructions?|source|untrusted)\b[^>]*>|<\|[^|>]*\|>", " ")
    bare = F.regexp_replace(bare, r"`{3,}|#{3,}|-{4,}|={4,}", " ")
    return F.btrim(F.regexp_replace(bare, r"[ \t]+", " "))


def tone(sentiment: Column, adverse: Column, discount: float = 0.5) -> Column:
    """A text's tone: the negative sentiment of reports on adverse events counts only in part."""
    return F.when(adverse & (sentiment < 0), sentiment * discount).otherwise(sentiment)


def diff_sentences(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """(kind, sentence) along a longest common subsequence: unchanged, retracted, added."""
    if len(old) * len(new) > CELLS:
        left, right = set(old), set(new)
        return [("unchanged" if s in right else "retracted", s) for s in old] + [("added", s) for s in new if s not in left]
    best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i in range(len(old) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(new) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if old[i] == new[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(old) or j < len(new):
        if i < len(old) and j < len(new) and old[i] == new[j]:
            out.append(("unchanged", old[i]))
            i, j = i + 1, j + 1
        elif j == len(new) or (i < len(old) and best[i + 1][j] >= best[i][j + 1]):
            out.append(("retracted", old[i]))
            i += 1
        else:
            out.append(("added", new[j]))
            j += 1
    return out


def sentence_diff(df: DataFrame, id_cols: list[str], old: str, new: str) -> DataFrame:
    """(ids, n_unchanged, n_added, n_retracted): the sentence diff of each row's two texts; null counts as empty."""
    rows = df.select(*id_cols, *(sentences(F.coalesce(F.col(c), F.lit(""))).alias(f"_{k}") for k, c in enumerate((old, new))))
    n = len(id_cols)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            made = [[k for k, _ in diff_sentences(x, y)] for x, y in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
            counts = [pa.array([m.count(k) for m in made], pa.int64()) for k in ("unchanged", "added", "retracted")]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *counts], [*id_cols, "n_unchanged", "n_added", "n_retracted"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*id_cols).dtypes)
    return rows.mapInArrow(batches, schema + ", n_unchanged long, n_added long, n_retracted long")
