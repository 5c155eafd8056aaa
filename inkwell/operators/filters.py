"""Predicates of the library: search grammar, muting, binders, sections, scopes and pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_phrase, like_escaped, padded_phrase
from ..functions.urls import covers


@dataclass
class SearchSpec:
    """A parsed query: operators, and free terms of which some are phrases."""

    source: str | None = None
    category: str | None = None
    is_read: bool | None = None
    is_saved: bool | None = None
    terms: list[str] = field(default_factory=list)
    phrases: set[int] = field(default_factory=set)


def parse_search(raw: str) -> SearchSpec:
    """``source:x category:y is:read is:unread is:saved "a phrase" term``; ``source:ft``, or ``ft`` alone, is short for the Financial Times."""
    spec = SearchSpec()
    for quoted, token in re.findall(r'("[^"]*"?)|([^\s"]+)', raw):
        low = token.lower()
        if quoted:
            if term := quoted.replace('"', "").strip().lower():
                spec.phrases.add(len(spec.terms))
                spec.terms.append(term)
        elif low == "ft" or low.startswith("source:"):
            name = low.removeprefix("source:")
            spec.source = "financial times" if name == "ft" else name
        elif low.startswith("category:"):
            spec.category = low[9:]
        elif low in ("is:read", "is:unread"):
            spec.is_read = low == "is:read"
        elif low == "is:saved":
            spec.is_saved = True
        else:
            spec.terms.append(low)
    return spec


def latest_tokens(tokens: list[str]) -> list[str]:
    """Of several tokens for one field the last one counts; free text stays in order."""
    last = {t.split(":", 1)[0].lower(): i for i, t in enumerate(tokens) if ":" in t}
    return [t for i, t in enumerate(tokens) if ":" not in t or last[t.split(":", 1)[0].lower()] == i]


def matches(spec: SearchSpec, text: Column, source: Column, category: Column | None = None, is_read: Column | None = None, is_saved: Column | None = None) -> Column:
    """All of a query's conditions: source and category by substring, terms by substring, phrases as whole words."""
    tests = [F.lit(True)]
    if spec.source:
        tests.append(F.lower(source).contains(spec.source))
    if spec.category and category is not None:
        tests.append(F.replace(F.lower(category), F.lit(" "), F.lit("-")).contains(spec.category.replace(" ", "-")))
    if spec.is_read is not None and is_read is not None:
        tests.append(F.coalesce(is_read, F.lit(False)) == spec.is_read)
    if spec.is_saved is not None and is_saved is not None:
        tests.append(F.coalesce(is_saved, F.lit(False)) == spec.is_saved)
    padded = padded_phrase(text)
    for i, term in enumerate(spec.terms):
        tests.append(any_phrase(padded, [term]) if i in spec.phrases else F.lower(text).contains(term))
    return reduce(lambda a, b: a & b, tests)


def muted_hosts(df: DataFrame, host_col: str, rules: list[str]) -> Column:
    """Whether a row's host is one of the rules' or below one; the rules are a parameter."""
    return F.coalesce(reduce(lambda a, b: a | b, (covers(F.lit(r), F.col(host_col)) for r in rules), F.lit(False)), F.lit(False))


def muted_topics(text: Column, rules: list[str]) -> Column:
    return F.coalesce(any_phrase(padded_phrase(text), rules), F.lit(False))


@dataclass
class Binder:
    """A saved filter: any category, any publisher, any or all included words, none of the excluded."""

    categories: list[str] = field(default_factory=list)
    publishers: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    include_all: bool = False
    exclude: list[str] = field(default_factory=list)

    def condition(self, text: Column, source: Column, category: Column) -> Column:
        low = F.lower(text)
        like = lambda w: low.like("%" + like_escaped(w.lower()) + "%")
        tests = [F.lit(True)]
        if self.categories:
            tests.append(F.lower(category).isin([c.lower() for c in self.categories]))
        if self.publishers:
            tests.append(F.lower(source).isin([p.lower() for p in self.publishers]))
        if self.include:
            join = (lambda a, b: a & b) if self.include_all else (lambda a, b: a | b)
            tests.append(reduce(join, map(like, self.include)))
        tests += [~like(w) for w in self.exclude]
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def page_after(df: DataFrame, value: str, id_col: str, cursor: tuple | None, limit: int) -> DataFrame:
    """A page ordered by (value descending, id): the rows after the cursor's."""
    if cursor is not None:
        v, i = cursor
        df = df.where((F.col(value) < v) | ((F.col(value) == v) & (F.col(id_col) > i)))
    return df.orderBy(F.desc(value), F.asc(id_col)).limit(limit)
