"""Wire classes, representatives, request waves and frozen editions against plain versions and planted rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkwell.operators.fetching import cooldowns, fetch_waves, paused
from inkwell.operators.linkage import credits, distinct_representatives, reprint_classes, similar_sets, wire_attribution, wire_classes
from inkwell.operators.storage import frozen
from inkwell.streaming.events import shared_folder


def sentence(seed, n=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_wire_classes_hold_copies_near_texts_and_titles(spark):
    long, other = sentence(1), sentence(2)
    rows = [
        (1, "First title of this one report", long), (2, "Another name for it", long), (3, None, long + " with a tail"),  # equal and near texts
        (4, "Six words make up this title", sentence(3)), (5, "six words make up THIS title!", sentence(4)),  # equal titles
        (6, "Four words only here", sentence(5)), (7, "Four words only here", sentence(6)),  # too short a title
        (8, "One", "short text"), (9, "Two", "short text"),  # too few shingles
        (10, "a b c d e f g h i j", other), (11, "a b c d e f g h i k", sentence(7)), (12, "a b c d e f g h i j k", sentence(8)),  # 10 of 11 words; 9 of 11
        (13, None, None), (14, None, None), (15, "", ""),
        (None, "First title of this one report", long),
    ]
    df = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], "id long, title string, text string, group string, n int")
    got = {r.id: r.group for r in wire_classes(df.drop("group", "n"), "id", "text", "title").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: None, 7: None, 8: None, 9: None, 10: 10, 11: 10, 12: 10, 13: None, 14: None, 15: None}
    assert wire_classes(df.limit(0), "id", "text", "title").collect() == []


def test_copies_of_a_report_have_its_wire(spark):
    text = sentence(9, 150)
    rows = [(1, "A", text), (2, "B", text), (3, "C", "(AP) " + sentence(10, 120)), (4, "D", sentence(11, 120)), (5, "E", "brief")]
    df = spark.createDataFrame(rows, "id long, publisher string, text string").withColumn("title", F.lit(None).cast("string"))
    groups = wire_classes(df, "id", "text", "title")
    made = wire_attribution(df.join(groups, "id").select(F.col("id").alias("article"), "group", "publisher", credits(F.col("text")).alias("credits"), F.size(F.split("text", " ")).alias("n_words")))
    assert {r.article: (r.wire, r.origin) for r in made.collect()} == {1: ("copy:1", "unattributed:1"), 2: ("copy:1", "unattributed:1"), 3: ("wire:ap", "agency:ap"), 4: ("report:4", "D"), 5: (None, None)}


@pytest.mark.parametrize("similar", [0.9, 0.5, 1.0])
def test_similar_sets_equal_all_pairs(spark, similar):
    r = random.Random(13)
    sets = {}
    for k in range(140):
        base = [f"x{j}" for j in range(r.randint(5, 12))]
        w = {("y" + str(r.randrange(3)) if r.random() < 0.08 else x) for x in base}
        sets.setdefault(tuple(sorted(w)), k)
    rows = [(k, list(w)) for w, k in sets.items()]
    want = {(min(a, b), max(a, b)) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) >= similar * len(set(x) | set(y))}
    assert {tuple(p) for p in similar_sets(spark.createDataFrame(rows, "id long, w array<string>"), similar).collect()} == want


def plain_reprints(rows):
    """Anchors by comparing every two reports of an event in order."""
    out, by = {}, defaultdict(list)
    for e, i, title, text, _ in rows:
        if e is not None:
            by[e].append((i, (title or "").strip().lower(), " ".join((text or "").lower().split())))
    for reports in by.values():
        anchors = []
        for i, t, p in sorted(reports):
            for j, u, q in anchors:
                x, y = set(p.split(" ")[:80]), set(q.split(" ")[:80])
                if p and q and ((len(p[:250]) >= 100 and p[:250] == q[:250]) or (t == u and len(x & y) / len(x | y) > 0.65)):
                    out[i] = j
                    break
            else:
                out[i] = i
                anchors.append((i, t, p))
    return out


def planted_reports():
    r, rows, i = random.Random(14), [], 0
    for event in range(12):
        texts = [sentence(100 * event + k, r.choice([8, 30, 60])) for k in range(4)]
        for _ in range(r.randint(1, 25)):
            t = r.choice(texts)
            w = t.split()
            for _ in range(r.choice([0, 0, 1, 5, 12])):
                w[r.randrange(len(w))] = f"z{r.randrange(99)}"
            rows.append((event, i, r.choice(["One title", "one  title", "Other", None]), r.choice(["", " "]) + "  ".join(w).upper(), r.randrange(5)))
            i += 1
    return rows + [(12, i, None, None, 3), (12, i + 1, None, "", 9), (12, i + 2, "", " ", None), (None, i + 3, "x", "y", 1)]


def test_reprint_classes_equal_a_plain_reading(spark):
    rows = planted_reports()
    df = spark.createDataFrame(rows, "event long, id long, title string, text string, quality long").repartition(5)
    want = plain_reprints(rows)
    assert {x.id: x.anchor for x in reprint_classes(df).collect()} == want and len(set(want.values())) < len(want)
    best, quality = defaultdict(dict), {i: q for _, i, _, _, q in rows}
    for e, i, *_ in rows:
        if e is not None:
            own = best[e].setdefault(want[i], i)
            if (quality[i] if quality[i] is not None else -1, -i) > (quality[own] if quality[own] is not None else -1, -own):
                best[e][want[i]] = i
    shown = {(e, k + 1, i) for e, classes in best.items() for k, (_, i) in enumerate(sorted(classes.items(), key=lambda c: (-(quality[c[1]] if quality[c[1]] is not None else -1), c[0]))[:5])}
    assert {tuple(x) for x in distinct_representatives(df).collect()} == shown


def test_an_event_of_too_many_different_reports_raises(spark):
    df = spark.createDataFrame([(1, k, f"t{k}", sentence(k)) for k in range(6)], "event long, id long, title string, text string")
    with pytest.raises(Exception, match="more than 5 reports"):
        reprint_classes(df, members=5).collect()


def test_waves_equal_a_queue(spark):
    """A queue that starts the first feed whose host is below its limit, until all places are taken."""
    r = random.Random(15)
    feeds = [(r.randrange(4), f"h{r.choice([0, 0, 0, r.randrange(9)])}", k, r.randrange(100), r.choice([None, None, 40, 90])) for k in range(300)]
    refusals = [(r.randrange(4), f"h{r.randrange(9)}", r.randrange(50), r.randrange(60)) for _ in range(12)]
    now, want, until = 60, {}, defaultdict(int)
    for f, h, at, wait in refusals:
        until[f, h] = max(until[f, h], at + wait)
    for f in range(4):
        active, started = defaultdict(int), []
        for due, feed, host, retry in sorted((d, k, h, t) for g, h, k, d, t in feeds if g == f and d <= now):
            if max(until[f, host], retry or 0) <= now and active[host] < 2 and len(started) < 6:
                active[host] += 1
                started.append(feed)
        want |= {(f, k): n + 1 for n, k in enumerate(started)}
    df = spark.createDataFrame(feeds, "fetcher int, host string, feed int, due int, retry_at int")
    waits = cooldowns(spark.createDataFrame(refusals, "fetcher int, host string, at int, wait int"))
    assert {(x.fetcher, x.feed): x.place for x in fetch_waves(df, waits, now).collect()} == want
    waiting = {x.feed: x.until for x in paused(df, waits, now).where("until IS NOT NULL").collect()}
    assert waiting == {k: max(until[f, h], t or 0) for f, h, k, d, t in feeds if max(until[f, h], t or 0) > now}


def test_first_writer_of_an_edition_wins(spark):
    root = shared_folder(spark, "test-editions")
    made = lambda rows: spark.createDataFrame(rows, "day string, n int, _key0 int")
    assert sorted(map(tuple, frozen(made([("2024-01-01", 1, 0), ("a/b: c", 2, 0), (None, 9, 0)]), root, "day").collect())) == [("2024-01-01", 1, 0), ("a/b: c", 2, 0)]
    second = frozen(made([("2024-01-01", 100, 1), ("2024-01-01", 101, 1), ("2024-01-02", 3, 1)]), root, "day")
    assert sorted(map(tuple, second.collect())) == [("2024-01-01", 1, 0), ("2024-01-02", 3, 1), ("a/b: c", 2, 0)]
    assert sorted(map(tuple, frozen(made([]), root, "day").collect())) == sorted(map(tuple, second.collect()))


def test_a_writer_that_comes_second_reads_the_first(spark, monkeypatch):
    """Both runs find the edition free; the one whose rename comes second leaves it as it is."""
    from inkwell.operators import storage

    root = shared_folder(spark, "test-race")
    df = spark.createDataFrame([("e", 1)], "day string, n int")
    real = storage.uuid.uuid4

    def late():
        monkeypatch.setattr(storage.uuid, "uuid4", real)
        frozen(spark.createDataFrame([("e", 7)], "day string, n int"), root, "day")  # another run freezes in between
        return real()

    monkeypatch.setattr(storage.uuid, "uuid4", late)
    assert [tuple(r) for r in frozen(df, root, "day").collect()] == [("e", 7)]


def test_shortlists_equal_a_plain_reading(spark):
    """Every pair scored by hand: time, language, open events, ties, the limit."""
    import math

    from inkwell.operators.shortlist import headline_terms, shortlists

    r = random.Random(17)
    vocabulary = ["Alpha", "beta1", "Gamma", "delta", "epsilon", "Zeta", "the", "eta", "Omega"]
    rows = [(k, r.randrange(0, 400_000), r.choice(["en", "fr", None]), " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 14))), r.choice([None, r.randrange(-200_000, 400_000)])) for k in range(120)] + [(120, 5, None, None, None)]
    df = spark.createDataFrame(rows, "id long, at long, lang string, text string, active long")
    probes = df.select("id", "at", "lang", headline_terms(F.col("text")).alias("terms"))
    cut = {i: (t or "").lower().split() for i, _, _, t, _ in rows}
    mean, df_of = sum(map(len, cut.values())) / len(cut), defaultdict(int)
    for w in cut.values():
        for x in set(w):
            df_of[x] += 1
    want = set()
    for i, at, lang, text, _ in rows:
        named = [w for w in (text or "").split() if len(w) >= 4]
        terms = list(dict.fromkeys(w.lower() for w in [*(w for w in named if w[0].isupper()), *(w for w in named if not w[0].isupper())]))[:8]
        found = []
        for j, bt, other, _, active in rows:
            if i != j and abs(at - bt) <= 172_800 and (lang is None or other is None or lang == other) and (active is None or active >= at - 259_200):
                held = [t for t in terms if t in cut[j]]
                if held:
                    n = len(cut[j])
                    score = sum(math.log(1 + (len(cut) - df_of[t] + 0.5) / (df_of[t] + 0.5)) * cut[j].count(t) * 2.2 / (cut[j].count(t) + 1.2 * (0.25 + 0.75 * n / mean)) for t in held)
                    found.append((-round(score, 6), j))
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(sorted(found)[:5])}
    got = {(x.a, x.b, x.place) for x in shortlists(probes, df, limit=5).collect()}
    assert got == want and len(want) > 200


def test_headline_terms(spark):
    from inkwell.operators.shortlist import headline_terms

    df = spark.createDataFrame([("the quiet Harbour of Lund was quiet 2024 a1b2",), (" ".join(f"word{k}" for k in range(12)),), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(headline_terms(F.col("t"))).collect()] == [["harbour", "lund", "quiet", "a1b2"], [f"word{k}" for k in range(8)], None, []]
