"""Pair rules, fragments, stories, event maintenance and shown indexes on planted cases."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import events as ev
from inkwell.operators import matching as m
from inkwell.operators.merging import forwarded
from inkwell.operators.ranking import limited
from inkwell.operators.series import displayed, halved_counters, smoothed

HOUR = 3600


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_forwarding_ends_and_circles(spark):
    chain = [(1, 2), (2, 3), (3, 4)]
    circle = [(10, 11), (11, 10), (20, 21), (21, 22), (22, 20), (25, 22), (24, 25), (30, 30)]
    got = dict(rows(forwarded(spark.createDataFrame(chain + circle, "id long, merged_into long"))))
    assert got == {1: 4, 2: 4, 3: 4, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20, 25: 20, 24: 20, 30: 30}
    assert rows(forwarded(spark.createDataFrame([], "id long, merged_into long"))) == []


def test_long_chains_forward(spark):
    n = 300
    got = dict(rows(forwarded(spark.createDataFrame([(i, i + 1) for i in range(n)], "id long, merged_into long"))))
    assert got == dict.fromkeys(range(n), n)


def plain_shown(days: dict[int, float], day: int) -> int:
    window = sorted(d for d in days if day - 7 < d <= day)
    mean = days[window[0]]
    for d in window[1:]:
        mean = 0.25 * days[d] + 0.75 * mean
    rises = 0
    for a, b in reversed(list(itertools.pairwise(window))):
        if b - a > 1 or days[b] <= days[a]:
            break
        rises += 1
    return min(100, max(0, int(mean + 0.5) + min(9, 3 * rises)))


def test_shown_index_over_gaps(spark):
    rng = random.Random(3)
    days = {d: float(rng.randrange(100)) for d in range(80) if rng.random() < 0.7}
    days |= {100 + k: 10.0 * k for k in range(6)} | {120: 5.0}
    data = [("w", d, v) for d, v in days.items()] + [("w", 200, None)]
    df = spark.createDataFrame(data, "s string, n int, v double").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")))
    got = {(r.day.toordinal()): r.shown for r in displayed(df, ["s"], "day", "v").collect()}
    base = 738886  # 2024-01-01
    assert got == {base + d: plain_shown(days, d) for d in days}


def test_folds_against_plain_loops(spark):
    rng = random.Random(5)
    data = [(k, t, rng.randrange(3) > 0, rng.random() * 9) for k in range(4) for t in range(700 if k == 0 else 40)]
    df = spark.createDataFrame(data, "k int, t long, ok boolean, l double")
    want = {}
    for k, _, ok, lat in data:
        a, s, x = want.get(k, (0.0, 0.0, 0.0))
        h = 0.5 if a >= 200 else 1.0
        want[k] = (a * h + 1, s * h + ok, x * h + ok * lat)
    got = {r.k: (r.attempts, r.successes, r.latency) for r in halved_counters(df, ["k"], "t", "ok", "l").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    passed, recent = set(), []
    for t in range(700):
        if sum(x > t - 50 for x in recent) < 3:
            recent = [t, *recent][:3]
            passed.add(t)
    assert {r.id for r in limited(df.where("k = 0").select("k", "t", F.col("t").alias("id")), ["k"], "t", ((3, 50),)).collect()} == passed
    series = [("s", 1, 4.0), ("s", 2, None), ("s", 3, 8.0), ("z", 1, None), ("z", 2, 1.0)]
    made = {(r.k, r.d): r.smoothed for r in smoothed(spark.createDataFrame(series, "k string, d int, v double"), ["k"], "d", "v").collect()}
    assert made == {("s", 1): 4.0, ("s", 2): None, ("s", 3): 5.0, ("z", 1): None, ("z", 2): 1.0}


@pytest.mark.parametrize(("title", "act"), [
    ("Leaders agree on a treaty", "agreement"), ("Minister steps down after rally", "unknown"), ("Minister steps down", "personnel"), ("Police open fire", "attack"),
    ("Court strikes down the law", "ruling"), ("Two dead and crews rescued", "rescue"), ("Three injured", "casualties"), ("Prices go up", "unknown"), ("Ferry sank", "crash"),
])
def test_act_classes(spark, title, act):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(m.act_class(m.words(F.col("t")), F.col("t"))).first()[0] == act


def test_acts_that_conflict(spark):
    cases = {("vote", "protest"): True, ("attack", "crash"): False, ("casualties", "attack"): False, ("casualties", "agreement"): True, ("rescue", "casualties"): False, ("unknown", "vote"): False, ("vote", "vote"): False, ("sanction", "rescue"): True}
    df = spark.createDataFrame(list(cases), "a string, b string")
    assert {(r.a, r.b): r.c for r in df.select("a", "b", m.acts_conflict(F.col("a"), F.col("b")).alias("c")).collect()} == cases


def report(i, **given):
    base = dict.fromkeys(m.SETS, []) | {"id": i, "at": 100 * HOUR, "lang": "en", "publisher": f"p{i}", "series": None, "act": "unknown", "names": ["Alvarez", "Belgrano"], "keywords": ["flood", "bridge", "rescue"]}
    return base | given


REPORT = "id long, at long, lang string, publisher string, series string, act string, " + ", ".join(f"{c} array<string>" for c in m.SETS)


def frame(spark, reports):
    cols = [c.split(" ")[0] for c in REPORT.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in reports], REPORT)


@pytest.mark.parametrize(("rule", "a", "b", "pair"), [
    ("unknownDate", {"at": None}, {}, {}), ("language", {"lang": "de"}, {}, {}), ("timeGap", {"at": 150 * HOUR}, {}, {}), ("period", {"periods": ["q1"]}, {"periods": ["q2"]}, {}),
    ("year", {"years": ["2023"]}, {"years": ["2024"]}, {}), ("weekday", {"weekdays": ["monday"]}, {"weekdays": ["friday"]}, {}), ("calendarDay", {"days": ["3 may"]}, {"days": ["4 may"]}, {}),
    ("edition", {"series": "brief", "publisher": "x", "editions": ["morning"]}, {"series": "brief", "publisher": "x", "editions": ["evening"]}, {}),
    ("calendarDay", {"series": "deals", "publisher": "x", "at": 80 * HOUR}, {"series": "deals", "publisher": "x"}, {}),
    ("namedStorm", {"storms": ["Ana"]}, {"storms": ["Bea"]}, {}), ("titleNumbers", {"title_numbers": ["3"]}, {"title_numbers": ["4"]}, {}), ("places", {"countries": ["peru"]}, {"countries": ["chile"]}, {}),
    ("headlinePlaces", {"title_places": ["Lima"]}, {"title_places": ["Cusco"]}, {}), ("excluded", {}, {}, {"excluded": True}), ("differentAct", {"act": "vote"}, {"act": "protest"}, {}),
    ("semanticDivergence", {}, {}, {"cosine": 0.3}), (None, {}, {}, {}), (None, {"lang": None}, {}, {"cosine": 0.9}),
])
def test_each_conflict_rule(spark, rule, a, b, pair):
    pairs = spark.createDataFrame([(1, 2, pair.get("excluded"), pair.get("cosine"))], "a long, b long, excluded boolean, cosine double")
    got = m.assess(pairs, frame(spark, [report(1, **a), report(2, **b)])).first()
    assert got.conflict == rule and (got.level == "match") == (rule is None)


def test_levels(spark):
    reports = [report(1), report(2), report(3, names=["Alvarez", "Castro", "Duarte", "Estevez"], keywords=["flood", "elder", "river", "crowd"]), report(4, names=[], keywords=["other"]), report(5, names=["Zapata"], keywords=["flood", "bridge", "rescue"])]
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5)], "a long, b long")
    got = {r.b: r.level for r in m.assess(pairs, frame(spark, reports)).collect()}
    assert got == {2: "match", 3: "borderline", 4: "none", 5: "borderline"} or got == {2: "match", 3: "compatible", 4: "none", 5: "borderline"}
    rescued = m.assess(spark.createDataFrame([(1, 3, 0.8)], "a long, b long, cosine double"), frame(spark, reports)).first()
    assert rescued.level == "match" and rescued.score == 0.8


def test_fragments_merge_only_where_all_cross_pairs_fit(spark):
    reports = [report(1), report(2), report(3, lang="de"), report(4), report(9, names=["Nobody", "Else"], keywords=["market", "prices"])]
    members = spark.createDataFrame([(1, 1, 100 * HOUR), (2, 2, 100 * HOUR), (2, 3, 100 * HOUR), (4, 4, 101 * HOUR), (9, 9, 100 * HOUR)], "event long, id long, at long")
    terms = spark.createDataFrame([(i, t) for i in (1, 2, 3, 4) for t in ("Alvarez", "flood")] + [(9, "market"), (9, "Nobody")], "id long, term string")
    assert rows(m.merge_fragments(members, frame(spark, reports), terms)) == [(4, 1)]  # event 2 holds a report in another language


def test_stories_and_earlier_events(spark):
    reports = [report(i, names=["Alvarez", "Belgrano"] if i < 40 else [f"N{i}", "Common"], at=(i // 10) * 10 * HOUR) for i in range(10, 160)]
    members = spark.createDataFrame([(i // 10, i, (i // 10) * 10 * HOUR) for i in range(10, 160)], "event long, id long, at long")
    names = spark.createDataFrame([(r["id"], n) for r in reports for n in r["names"]], "id long, term string")
    links = m.story_links(members, frame(spark, reports), names, share=0.5)
    assert rows(links) == [(1, 2), (1, 3), (2, 3)]
    assert rows(m.stories(members, links)) == [(1, 1), (2, 1), (3, 1)]
    singles = spark.createDataFrame([(500, 20 * HOUR)], "id long, at long")
    both = frame(spark, [*reports, report(500, at=20 * HOUR)])
    named = names.unionByName(spark.createDataFrame([(500, "Alvarez"), (500, "Belgrano")], "id long, term string"))
    offered = spark.createDataFrame([(500, 1, 0.8), (500, 2, 0.9), (500, 3, 0.1), (500, 7, 0.9)], "id long, event long, cosine double")
    assert rows(m.attach_singles(singles, members, offered, both, named)) == [(500, 1)]
    placed = frame(spark, [r | {"countries": ["peru"] if r["id"] < 40 else ["chile"]} for r in reports])
    actors = spark.createDataFrame([(r["id"], "ana") for r in reports if r["id"] < 50], "id long, actor string")
    assert rows(m.earlier_related(members, placed, actors).select("event", "related")) == [(2, 1), (3, 1), (3, 2)]


def state(spark):
    events = spark.createDataFrame([(e, 1, None, None) for e in (1, 2, 3, 4)], "event long, version long, merged_into long, seen_version long")
    members = spark.createDataFrame([(a, a // 10, 1) for a in (10, 11, 12, 20, 21, 30)], "article long, event long, joined_version long")
    return ev.State(events, members, spark.createDataFrame([], "a long, b long, include boolean, at long"))


def seen(s):
    held = {}
    for r in s.members.collect():
        held.setdefault(r.event, set()).add(r.article)
    return held, {r.event: (r.version, r.merged_into) for r in s.events.collect()}


def orders(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_event_maintenance(spark):
    s = state(spark)
    held, e = seen(ev.create(s, orders(spark, [(9, 10), (9, 99)], "event long, article long")))
    assert held == {1: {11, 12}, 2: {20, 21}, 3: {30}, 9: {10, 99}} and e[9] == (1, None) and e[1] == (2, None) and e[2] == (1, None)
    held, e = seen(ev.add(s, orders(spark, [(2, 30), (2, 20), (77, 10)], "event long, article long")))
    assert held == {1: {10, 11, 12}, 2: {20, 21, 30}} and e[2] == (2, None) and e[3] == (2, None) and e[1] == (1, None)
    held, e = seen(ev.remove(s, orders(spark, [(3, 30), (2, 10)], "event long, article long")))
    assert held == {1: {10, 11, 12}, 2: {20, 21}} and e[3] == (2, None) and e[2] == (1, None)
    held, e = seen(ev.split(s, orders(spark, [(1, 8, 10), (2, 9, 20), (2, 9, 21), (3, 7, 30)], "source long, event long, article long")))
    assert held == {8: {10}, 1: {11, 12}, 2: {20, 21}, 3: {30}} and e[1] == (2, None) and e[8] == (1, None) and 9 not in e and 7 not in e


def test_event_merges_and_verdicts(spark):
    s = state(spark)
    none = "absorbed long, survivor long, absorbed_version long, survivor_version long"
    once = ev.merge(s, orders(spark, [(2, 1, 1, 1), (4, 3, None, None)], none))
    held, e = seen(once)
    assert held == {1: {10, 11, 12, 20, 21}, 3: {30}} and e == {1: (2, None), 2: (2, 1), 3: (1, None), 4: (2, 3)}
    held, e = seen(ev.merge(once, orders(spark, [(1, 3, None, None)], none)))
    assert held == {3: {10, 11, 12, 20, 21, 30}} and e[2][1] == 3 and e[1][1] == 3 and e[3][0] == 2  # forwards stay one step deep
    held, e = seen(ev.merge(once, orders(spark, [(1, 3, 1, 1)], none)))
    assert held[1] == {10, 11, 12, 20, 21}  # event 1 has changed since version 1
    s2 = ev.include(s, orders(spark, [(3, 2)], "source long, target long"), 7)
    assert rows(s2.verdicts) == [(20, 30, True, 7), (21, 30, True, 7)] and {r.event: r.seen_version for r in s2.events.collect()}[2] == 2
    s3 = ev.separate(s2, orders(spark, [(2, 30)], "event long, article long"), 8)
    assert rows(s3.verdicts) == [(20, 30, False, 8), (21, 30, False, 8)] and seen(s3)[0][2] == {20, 21}
    assert seen(ev.include(s, orders(spark, [(3, 2)], "source long, target long"), 7, size=2))[0][3] == {30}


def test_regrouping_of_an_event(spark):
    members = spark.createDataFrame([(1, a, a) for a in (1, 2, 3, 4)], "event long, article long, at long")
    fit = lambda a, b, level="match", conflict=None: (1, a, b, 0.9, level, 1, conflict)
    pairs = [fit(1, 2), fit(3, 4), fit(1, 3, "none", "language"), fit(2, 3), fit(1, 4, "none", "language"), fit(2, 4)]
    df = spark.createDataFrame(pairs, "event long, a long, b long, score double, level string, specific int, conflict string")
    parts = ev.regrouped(members, df)
    assert {r.article: r.part for r in parts.collect()} == {1: 0, 2: 0, 3: 1, 4: 1}
    s = ev.State(spark.createDataFrame([(1, 1, None, None)], "event long, version long, merged_into long, seen_version long"), members.select("article", "event", F.lit(1).cast("long").alias("joined_version")), state(spark).verdicts)
    held, e = seen(ev.apply_regrouping(s, parts, lambda event, part: event * 100 + part))
    assert held == {1: {1, 2}, 101: {3, 4}} and e[1] == (2, None)


def test_facts_by_cues_and_figures(spark):
    from inkwell.operators.casualties import classify_facts

    facts = [(1, "At least 12 people were killed in an airstrike, officials denied a ceasefire."), (2, "Hundreds of residents were displaced by flooding as talks resumed."), (3, "No troops crossed the border."), (4, None)]
    got = {r.event: (r.type, r.deaths, r.affected) for r in classify_facts(spark.createDataFrame(facts, "event long, quote string")).collect()}
    assert got == {1: ("armedConflict", 12, 0), 2: ("disaster", 0, 200), 3: (None, 0, 0), 4: (None, 0, 0)}


@pytest.mark.parametrize("text,deaths,affected", [
    ("At least 12 people were killed and 30 injured", 12, 30), ("killing at least 1,200", 1200, 0), ("wounding more than 40 others", 0, 40), ("The death toll rose to 350 on Monday", 350, 0), ("The toll. It rose to 350", 0, 0),
    ("hundreds of people have been displaced", 0, 200), ("hundreds of thousands were killed", 200, 0), ("3.5 million people reportedly displaced", 0, 3_500_000), ("2024 killed", 0, 0), ("2,024 killed", 2024, 0), ("0.5 dead", 0, 0),
    ("12, people killed", 0, 0), ("12 more young civilians were now missing", 0, 12), ("12 young old civilians missing", 0, 0), ("5 soldiers and 7 police officers died", 7, 0), ("a12 dead", 0, 0), ("12th dead", 0, 0), ("killed up to 5 thousand", 5000, 0), ("", 0, 0), (None, 0, 0),
])
def test_figures_of_planted_passages(spark, text, deaths, affected):
    from inkwell.operators.casualties import figures

    assert tuple(spark.createDataFrame([(text,)], "t string").select(figures("t")).first()[0]) == (deaths, affected)
