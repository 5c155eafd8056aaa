"""Kinds of content, lane confidences and interest on planted stories."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators.editions import content_kind, interest, reading_minutes

CASES = [
    ("Investigation: x", "", "", "", ("investigation", 0.85)), ("A deep-dive", None, None, None, ("investigation", 0.85)), ("x", "documents reveal", "", "", ("investigation", 0.85)),
    ("Police launch investigation", "", "", "", None), ("x", "", "", "https://a/Special-Report/1", ("investigation", 0.85)), ("What to know", "", "", "", ("explainer", 0.80)), ("How do bees fly?", "", "", "", ("explainer", 0.80)),
    ("How bees fly", "", "", "", None), ("x", "", "Opinion", "", ("opinion", 0.85)), ("Op-Ed: x", "", "", "", ("opinion", 0.85)), ("x", "an editorial", "", "", ("opinion", 0.72)), ("x", "", "", "https://a/opinions/", ("opinion", 0.85)), (None, None, None, None, None),
]


@pytest.mark.parametrize("title,summary,category,link,want", CASES)
def test_content_kind(spark, title, summary, category, link, want):
    df = spark.createDataFrame([(title, summary, category, link)], "t string, s string, c string, l string")
    got = df.select(content_kind(*(F.col(c) for c in "tscl"))).first()[0]
    assert (got if got is None else tuple(got)) == want


def test_reading_minutes(spark):
    df = spark.createDataFrame([("a b " * 100, None), (None, "  "), ("x", "y " * 400)], "a string, b string")
    assert [r[0] for r in df.select(reading_minutes([F.col("a"), F.col("b")])).collect()] == [1.0, 0.0, 2.0]


def test_interest_equals_a_plain_reading(spark):
    r = random.Random(18)
    profiles = {(u, kind, f"{kind[0]}{k}"): float(r.randint(1, 9)) for u in range(5) for kind in ("entity", "keyword", "category") for k in range(6) if r.random() < 0.6}
    stories = [(u, 100 * u + k, [f"e{r.randrange(9)}" for _ in range(r.randrange(4))], " ".join(f"k{r.randrange(9)}" for _ in range(r.randrange(8))), r.choice([None, "C1", "c3"])) for u in range(7) for k in range(12)]
    want = {}
    for u, i, entities, title, category in stories:
        own = {(kind, key): w for (v, kind, key), w in profiles.items() if v == u}
        if not own:
            want[i] = (0.0, 0.0)
            continue
        top = lambda kind: max([1.0, *(w for (k, _), w in own.items() if k == kind)])  # noqa: E731, B023
        ws = set(title.split())
        e = min(1.0, sum(own.get(("entity", x), 0) for x in set(entities)) / max(2.0, top("entity") * 1.15))
        w = min(1.0, sum(own.get(("keyword", x), 0) for x in ws) / max(2.0, max(3.0, len(ws)) * top("keyword") * 0.3))
        c = min(0.18, own.get(("category", (category or "").lower()), 0) / max(1.0, sum(x for (k, _), x in own.items() if k == "category")) * 0.45)
        m = min(1.0, max(e, w) * 0.75 + min(e, w) * 0.15 + c)
        want[i] = (round(m, 9), round(1 - m, 9))
    p = spark.createDataFrame([(u, kind, key, w) for (u, kind, key), w in profiles.items()], "reader long, kind string, key string, weight double")
    s = spark.createDataFrame(stories, "reader long, id long, entities array<string>, title string, category string")
    assert {x.id: (round(x.match, 9), round(x.novelty, 9)) for x in interest(s, p).collect()} == want
