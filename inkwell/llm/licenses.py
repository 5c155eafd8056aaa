"""Licence scans: an Aho-Corasick automaton finds notices and tags, a shunting-yard parser reads expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, text_or_empty

# The phrases of the contract and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Further notice phrases (as words) and their labels.
NOTICES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

# Identifiers of licence expressions and the labels used here; others keep their own lower-case name.
IDENTIFIERS = {"apache-2.0": "apache-2", "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2", "mpl-2.0": "mpl-2", "agpl-3.0": "agpl-3", "agpl-3.0-only": "agpl-3", "cc-by-nc-4.0": "cc-by-nc", "cc-by-sa-4.0": "cc-by-sa", "cc-by-4.0": "cc-by"}

TAG = "spdx-license-identifier:"
_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*|[()]")
_RANK = {"or": 1, "and": 2, "with": 3}
#: Bytes of words stay (A-Z as a-z), all others become a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: infix and/or/with (with binds tightest, or loosest) to postfix. Stops at what can't follow."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # an operand or "(" is due
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if operand:
            if word == "(":
                stack.append(word)
            elif word in _RANK or word == ")":
                break
            else:
                out.append(word)
                operand = False
        elif word == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif word in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        else:
            break  # two operands in a row: the expression has ended
    while stack:
        if (op := stack.pop()) != "(":
            out.append(op)
    return out


def labels_of(postfix: list[str]) -> frozenset[str]:
    """All labels of an expression: its licences, those under ``with`` joined to the exception's name."""
    stack: list[frozenset[str]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append(frozenset([IDENTIFIERS.get(token, token)]))
            continue
        if len(stack) < 2:
            break
        right, left = stack.pop(), stack.pop()
        stack.append(frozenset(f"{x} with {min(right)}" for x in left) if token == "with" else left | right)
    return stack[0] if stack else frozenset()


def satisfied(postfix: list[str], allowed: set[str]) -> bool:
    """Whether an expression holds when just the ``allowed`` labels may be used.

    ``or`` needs one side, ``and`` both, ``with`` the licence joined to the exception's name. An operator
    without its operands ends the evaluation.
    """
    stack: list[tuple[bool, frozenset[str]]] = []
    for token in postfix:
        if token not in _RANK:
            name = IDENTIFIERS.get(token, token)
            stack.append((name in allowed, frozenset([name])))
            continue
        if len(stack) < 2:
            break
        (right, right_names), (left, left_names) = stack.pop(), stack.pop()
        if token == "with":
            names = frozenset(f"{x} with {min(right_names)}" for x in left_names)
            stack.append((bool(names) and names <= allowed, names))
        else:
            stack.append(((left or right) if token == "or" else (left and right), left_names | right_names))
    return bool(stack) and stack[0][0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES)):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    found.make_automaton()
    return found


def scan(text: str, found: ahocorasick.Automaton) -> dict:
    """Words, phrase places and labels of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_FOLD).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, base, more = [], set(), set()
    counted = place = 0  # words that start before the character ``counted``
    for end, (kind, label, length) in found.iter(line):
        if kind == "base":
            start = end - length + 1
            if start >= counted:
                place += line.count(" ", counted, start)
                counted, here = start, place
            else:  # a longer phrase that began before
                here = place - line.count(" ", start, counted)
            places.append(here)
            base.add(label)
        else:
            more.add(label)
    tagged: list[str] = []
    named: set[str] = set()
    low = raw.lower().decode("utf-8", "surrogatepass")
    at = low.find(TAG)
    while at >= 0:
        at += len(TAG)
        stop = low.find("\n", at)
        if postfix := to_postfix(low[at : stop if stop >= 0 else len(low)]):
            tagged.append(" ".join(postfix))
            named |= labels_of(postfix)
        at = low.find(TAG, at)
    names = base | more | named
    doubt = 0.1 ** len(base) * 0.3 ** len(more - base) * (0.05 if tagged else 1.0)
    return {"n_words": len(words), "places": places, "base": base, "labels": names, "score": 0.0 if not names else 1.0 - doubt, "expressions": tagged}


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence labels of every whole text.

    Returns (id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions), the
    last being the text's tagged expressions in postfix order, for ``satisfied``. Null and empty texts
    have no words, no labels and score 0; ids may repeat or be null.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for b in it:
            rows = [scan(t.as_py(), found) for t in b.column(1)]
            yield pa.RecordBatch.from_pydict({
                "id": b.column(0),
                "n_words": pa.array([r["n_words"] for r in rows], pa.int64()),
                "n_base": pa.array([len(r["places"]) for r in rows], pa.int64()),
                "first_word": pa.array([min(r["places"], default=None) for r in rows], pa.int64()),
                "last_word": pa.array([max(r["places"], default=None) for r in rows], pa.int64()),
                "base_labels": pa.array([",".join(sorted(r["base"])) for r in rows], pa.string()),
                "labels": pa.array([",".join(sorted(r["labels"])) for r in rows], pa.string()),
                "score": pa.array([r["score"] for r in rows], pa.float64()),
                "expressions": pa.array([r["expressions"] for r in rows], pa.list_(pa.string())),
            })

    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"
    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(batches, schema)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    return scan_documents(documents(spark, sf_dir)).drop("expressions").withColumnRenamed("id", "doc_id")
