"""Faults that reviews of larger or odd tables found, on small planted tables."""

import datetime as dt
import time

import duckdb
from pyspark.sql import functions as F

from inkwell.operators import index
from inkwell.operators import matching as m
from inkwell.operators.storage import shared_root
from inkwell.queries import ORACLE_SQL, QUERIES

from .oracle import connect, difference
from .test_events import frame, report, rows


def differs(spark, folder, name, **tables):
    """What a query and its SQL make different of planted tables."""
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/spark-{table}")
        duckdb.sql(f"COPY (SELECT * FROM '{folder}/spark-{table}/*.parquet') TO '{folder}/{table}.parquet' (FORMAT parquet)")
    con = connect(str(folder))
    con.execute("SET threads = 1")
    return difference(QUERIES[name](spark, str(folder)), con, ORACLE_SQL[name])


def test_event_lead_title_takes_the_first_of_equal_lines(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, n)
    lines = [(1, 20, at(2), 1), (1, 10, at(2), 1), (2, 10, None, 1), (2, 20, at(3), 1), (3, 99, at(1), 1), (3, 20, at(2), 2), (4, 30, at(1), 1), (4, 10, at(2), 1)]
    li = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_shipdate timestamp, l_linenumber int")
    parts = spark.createDataFrame([(10, "a"), (20, "b"), (30, None)], "p_partkey long, p_name string")
    assert differs(spark, tmp_path, "event_lead_title", lineitem=li, part=parts) == ""


def test_event_representatives_follow_reprints_of_reprints(spark, tmp_path):
    words = [f"w{k}" for k in range(100)]
    # each text shares nine tenths of its words with the one before it, and the first and last too few
    texts = ["Same. " + " ".join(words[10 * k : 10 * k + 60]) for k in range(4)]
    rows = [(51 + 3 * k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(70, "Other\x0bvertical. " + "x " * 70, "en", "s", 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert differs(spark, tmp_path, "event_representatives", documents=docs) == ""


def test_earlier_events_write_no_pairs_of_reports(spark, monkeypatch):
    sizes = []
    for name in ("checkpointed", "written"):
        inner = getattr(m, name)
        monkeypatch.setattr(m, name, lambda df, *a, inner=inner: (lambda made: (sizes.append(made.count()), made)[1])(inner(df, *a)))
    reports = [report(i, countries=["peru"], at=(i // 100) * 10) for i in range(300)]
    members = spark.createDataFrame([(i // 100, i, (i // 100) * 10) for i in range(300)], "event long, id long, at long")
    actors = spark.createDataFrame([(i, f"actor{i % 2}") for i in range(300)], "id long, actor string")
    assert rows(m.earlier_related(members, frame(spark, reports), actors)) == [(1, 0, 10_000), (2, 0, 10_000), (2, 1, 10_000)]
    assert max(sizes) <= 300


def test_story_links_take_every_line_and_orders_far_apart(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    # orders 1 and 900 have the parts and days of two lines each in common, which repeat a number; others fill the table
    lines = [(o, p, at(d), 1, "R", "F") for o in (1, 900) for p, d in ((7, 3), (7, 3))] + [(10 + k, 20 + k, at(5 * k), 1, "R", "F") for k in range(60)]
    li = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_shipdate timestamp, l_linenumber int, l_returnflag string, l_linestatus string")
    assert differs(spark, tmp_path, "story_links", lineitem=li) == ""
    assert (1, 900) in rows(QUERIES["story_links"](spark, str(tmp_path)))


def test_story_links_assess_only_what_may_agree(spark, monkeypatch):
    seen = []
    inner = m.assess
    monkeypatch.setattr(m, "assess", lambda pairs, reports: (seen.append(pairs.count()), inner(pairs, reports))[1])
    # forty events of five reports share two names, one report of each late: no two events have reports of one time but by the first
    members = [(e, 10 * e + k, e * 40 * 3600 + k) for e in range(40) for k in range(5)]
    reports = [report(i, names=["Alvarez", "Belgrano"], at=at) for _, i, at in members]
    names = spark.createDataFrame([(i, n) for _, i, _ in members for n in ("Alvarez", "Belgrano")], "id long, term string")
    assert rows(m.story_links(spark.createDataFrame(members, "event long, id long, at long"), frame(spark, reports), names, share=2.0)) == []
    assert seen == [0]


def test_index_shuffles_no_words(spark, monkeypatch):
    """Words are grouped where their documents are read: what the one range shuffle reads has a row a word and document, in chunks too."""
    monkeypatch.setattr(index, "CHUNK", 5)
    docs = [(1, "a b a. C a", "b a"), (2, None, ""), (3, "", "Ünder the the"), (4, "one two three four five six one", "one"), (4, "one", None)]
    df = spark.createDataFrame(docs, "id long, text string, note string")
    path = f"{shared_root(spark)}/index-test"
    made = index.build(df, "id", ["text", "note"], path)
    assert spark.read.parquet(f"{path}/grouped").count() == 3 + 2 + 6 + 1
    got = {(r.term, r.id): (r.stem, r.tf, [p % index.FIELD + 100 * (p // index.FIELD) for p in r.positions]) for r in made.postings.collect()}
    assert got["a", 1] == ("a", 4, [0, 2, 4, 101]) and got["b", 1] == ("b", 2, [1, 100]) and got["the", 3] == ("the", 2, [101, 102])
    assert got["one", 4] == ("on", 4, [0, 0, 6, 100]) and len(got) == 11


def test_links_are_sought_again_for_merged_events_only(spark):
    r = frame(spark, [report(i) for i in range(1, 5)])
    members = r.select(F.col("id").alias("event"), "id", "at")
    terms = r.select(F.col("id").alias("event"), F.explode("names").alias("term"))
    every = {tuple(p) for p in m.fragment_links(members, r, terms).collect()}
    some = {tuple(p) for p in m.fragment_links(members, r, terms, spark.createDataFrame([(2,)], "event long")).collect()}
    assert every and some == {p for p in every if 2 in p}


def test_similar_titles_write_no_pairs(spark):
    from inkwell.operators.linkage import set_pairs

    # every two sets share four frequent words and are far from similar
    sets = spark.createDataFrame([(i, ["w", "x", "y", "z", *(f"{c}{i // 2}" for c in "abcdefgh")]) for i in range(200)], "id long, w array<string>")
    made = set_pairs(sets, 0.9)
    assert sorted(tuple(p) for p in made.collect()) == [(i, i + 1, 12, 12, 12) for i in range(0, 200, 2)]
    assert "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()  # no shuffle that makes pairs distinct


def test_trailing_origins_without_a_type_have_no_row(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    lines = [(1, at(0), 7, "a"), (2, at(0), None, "a"), (3, at(3600), 8, "a"), (4, at(3601), 7, "a"), (5, at(7300), 7, "a"), (6, at(9), 7, None), (7, None, 7, "a"), (8, at(3601), 7, "b"), (9, at(90_000), None, "b"), (10, at(3600), 8, "a")]
    events = spark.createDataFrame(lines, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    assert not differs(spark, tmp_path, "trailing_origins", events=events)


def test_cues_of_long_passages_are_found_in_time(spark):
    from inkwell.operators.casualties import has_cue

    text = F.concat(F.lit(" "), F.repeat(F.lit("considerable disagreements "), 15_000), F.lit("never a coup "), F.lit("the old coup "))
    began = time.perf_counter()
    assert spark.range(1).select(has_cue(text, "coup|riot"), has_cue(F.lit(" no coup "), "coup"), has_cue(F.lit(" coup failed "), "coup", True)).first()[:] == (True, False, False)
    assert time.perf_counter() - began < 6


def test_answers_that_are_no_dates_cost_no_tries(spark):
    from inkwell.functions.dates import feed_date, retry_seconds

    forms = ["2024-05-01", "1 May 2024", "01-May-2024 00:00:00 +0000", "May 1, 2024", "2024-05-01T00:00Z", "1 May 24", "may 1, 2024", "2024", "later", " 1", "1  May 2024", "Wed, 01 May 2024 00:00:00 GMT"]
    day = dt.datetime(2024, 5, 1)
    got = spark.createDataFrame([(s,) for s in forms], "s string").select("s", F.unix_seconds(feed_date(F.col("s"))).alias("t")).collect()
    assert [r.s for r in got if r.t is None] == ["2024", "later", " 1", "1  May 2024"]
    assert {r.t for r in got if r.t is not None} == {int(day.replace(tzinfo=dt.timezone.utc).timestamp())}
    began = time.perf_counter()
    waits = spark.range(0, 100_000, 1, 1).select(retry_seconds(F.when(F.col("id") % 2 == 0, "later").otherwise("Fri, 01 May 2024 00:00:00 GMT"), F.timestamp_seconds(F.lit(0))).alias("w"))
    assert waits.where("w > 0").count() == 50_000
    assert time.perf_counter() - began < 10


def test_claims_without_a_digit_are_not_searched_for_figures(spark):
    from inkwell.operators.claims import claim_failures

    df = spark.createDataFrame([(1, "The port closed.", "The port closed on 3 May 2024."), (2, "It weighed 5 kg.", "It weighed 6 kg."), (3, "In 2023 it closed.", "It closed on 3 May 2024.")], "id long, c string, s string")
    made = claim_failures(df, ["id"], "c", "s")
    assert {r.id: [k for k in r.failures if k in ("quantity", "date")] for r in made.collect()} == {1: [], 2: ["quantity"], 3: ["date"]}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("[0-9]) AND") >= 2


def test_figures_are_sought_once_a_text(spark):
    """quantity_fidelity searches each text once for quantities and once for each form of a date (it was five and three times, and anew for each figure of the claim)."""
    plan = QUERIES["quantity_fidelity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all") <= 10


def test_lanes_weigh_a_few_stories_only(spark, monkeypatch):
    """However many stories an edition has, a bounded number of them are ranked together; the lanes are those of ranking all."""
    from inkwell.operators import ranking

    made = []
    monkeypatch.setattr(ranking, "written", lambda df, label: made.append(df) or df)
    k = F.col("id")
    s = spark.range(20_000).select((k % 2).alias("edition"), "id", ((k * 7919) % 1009 / 1009).alias("score"), ((k * 31) % 77 / 77).alias("motion"), ((k * 17) % 91 / 91).alias("deep"), ((k * 13) % 50 / 50).alias("beat"), ((k * 11) % 33 / 33).alias("outside"))
    s = s.select("*", (k % 3 == 0).alias("lead_ok"), (k % 6 < 3).alias("motion_ok"), (k < 4).alias("deep_ok"), (k % 5 == 0).alias("beat_ok"), (k % 3 == 0).alias("outside_ok"))
    got = {(r.edition, r.id): r.lane for r in ranking.lanes(s).collect()}
    held, want = s.collect(), {}
    for edition in (0, 1):
        left = [r for r in held if r.edition == edition]
        for name, ok, score, least, most in ranking.LANES:
            fit = sorted((r for r in left if r[ok]), key=lambda r: (-r[score], r.id))
            for r in fit[:most] if len(fit) >= least else []:
                want[edition, r.id] = name
            left = [r for r in left if (edition, r.id) not in want]
        want.update({(edition, r.id): "latest" for r in left})
    assert got == want and made[0].count() <= 2 * sum(max(x[3:]) + sum(y[4] for y in ranking.LANES[:n]) for n, x in enumerate(ranking.LANES))


def test_only_shingles_that_meet_are_written(spark, monkeypatch):
    """near_dup_shingles writes no shingle that a single text has, and wire classes count a text's shingles without spreading them."""
    from inkwell.operators import linkage

    seen, exploded, plain, spread = [], [], linkage.written, linkage.shingle_rows
    monkeypatch.setattr(linkage, "written", lambda df, label: seen.append((label, plain(df, label))) or seen[-1][1])
    monkeypatch.setattr(linkage, "shingle_rows", lambda *a, **k: exploded.append(1) or spread(*a, **k))
    text = lambda n, k=0: " ".join(f"w{n}x{i}" for i in range(40)) + f" end{k}"
    docs = spark.createDataFrame([(1, text(1), ""), (2, text(1, 5), ""), (3, text(3), ""), (4, text(4), ""), (5, text(4), ""), (6, "few words", "")], "id long, text string, title string")
    assert rows(linkage.wire_classes(docs, "id", "text", "title")) == rows(spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 4), (5, 4), (6, None)], "id long, group long"))
    shingles = [df for label, df in seen if "shingles" in label]
    assert len(exploded) == 1 and len(shingles) == 1 and shingles[0].count() == 2 * 33


def test_shortlists_count_words_where_texts_are_read(spark, tmp_path):
    """event_candidates sorts no word of a text but inside its row: nothing is sorted or held for a term's reports; rows are those of the SQL, repeats, capitals, empty and single words among them."""
    plan = QUERIES["event_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ShuffledHashJoin" in plan
    # the one join that may sort has the probes' terms on one side and words with their counts on the other
    assert plan.count("SortMergeJoin") <= 1 and plan.count("HashAggregate(keys=[a#") == 2
    texts = ["Storm hits Lund. storm STORM storm", "Storm hits harbour! lund lund", "", "Lund", "a b c. lund", "Storm", "éclair Éclair storm. 2024 storms", "\n", "storm storm lund lund lund harbour", "x"] * 60
    docs = spark.createDataFrame([(k * 7 % 600, t, ("en", "fr")[k % 5 == 0], "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert differs(spark, tmp_path, "event_candidates", documents=docs) == ""


def test_postings_are_each_texts_words_and_counts(spark):
    from collections import Counter

    from inkwell.operators.shortlist import _postings

    made = {1: ["b", "a", "b", "b", "c"], 2: [], 3: ["z"], 4: ["é", "e", "é"], 5: ["w%d" % (k % 700) for k in range(5000)]}
    cut = spark.createDataFrame([(k, 60, "en", None, w) for k, w in made.items()], "id long, at long, lang string, active long, w array<string>")
    got = {(r.id, r.term, r.tf, r.length) for r in _postings(cut).collect()}
    assert got == {(k, t, n, len(w)) for k, w in made.items() for t, n in Counter(w).items()}


def test_shortlists_post_no_report_of_a_closed_event(spark, monkeypatch):
    """A report whose event was closed to every probe near it is counted in the frequencies, but its words are not dealt; one at the edge is a candidate."""
    from inkwell.operators import shortlist

    made, plain = [], shortlist._postings
    monkeypatch.setattr(shortlist, "_postings", lambda cut: made.append(cut) or plain(cut))
    edge = 400_000 - shortlist.WINDOW - shortlist.LIFETIME
    docs = spark.createDataFrame([(1, 400_000, "alpha", edge), (2, 400_000, "alpha", edge - 1), (3, 400_000 - shortlist.WINDOW, "alpha", None)], "id long, at long, text string, active long").withColumn("lang", F.lit("en"))
    probes = docs.select("id", "at", "lang", F.array(F.lit("alpha")).alias("terms"))
    got = {(r.a, r.b) for r in shortlist.shortlists(probes, docs).collect()}
    assert got == {(3, 1), (1, 3), (2, 3)} and rows(made[0].select("id")) == rows(docs.where("id <> 2").select("id"))


def test_a_filter_on_shingles_splits_no_text_for_each_shingle(spark):
    """Wire classes keep texts by their number of shingles: that filter has to stay above the words, or each shingle would split its text anew."""
    from inkwell.operators.linkage import shingle_rows, shingle_sets

    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(17))), (2, "too few words"), (3, None), (4, "")], "id long, text string")
    for made, want in ((shingle_sets(docs, "id", "text").where(F.size("s") >= 10).select("id"), [(1,)]), (shingle_rows(docs, "id", "text").select("id", "n").where("n >= 10").distinct(), [(1, 10)])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1 and rows(made) == want
    long = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20_000)))], "id long, text string")
    began = time.perf_counter()
    assert shingle_sets(long, "id", "text").where(F.size("s") >= 10).count() == 1
    assert time.perf_counter() - began < 10


def test_story_links_leave_events_without_a_couple_in_most_reports(spark, monkeypatch):
    """Only events meet of which two thirds of the first reports have one couple of names; nothing is written for the rest."""
    made, plain = [], m.written
    monkeypatch.setattr(m, "written", lambda df, label: made.append((label, plain(df, label))) or made[-1][1])
    # a hundred events of four reports, each of another couple of names, and three events that agree in two of two or three of three
    lines = [(e, 10 * e + k, 1000 * k, [f"a{k}", f"b{e}"]) for e in range(100) for k in range(4)] + [(200, 2000, 0, ["a1", "z"]), (200, 2001, 0, ["a1", "z"]), (201, 2010, 5, ["a1", "z"]), (202, 2020, 5, ["a1", "z"]), (202, 2021, 5, ["a1", None])]
    members = spark.createDataFrame(lines, "event long, id long, at long, names array<string>")
    reports = frame(spark, [report(i, names=[n for n in names if n], at=at, lang=None, publisher=None) for _, i, at, names in lines])
    assert rows(m.story_links(members, lambda events: reports.join(members.select("id", "event"), "id").join(events, "event", "left_semi").drop("event"), share=2.0)) == [(200, 201)]
    kept = {label: df for label, df in made}
    assert rows(kept["story-keys"].select("event")) == [(200,), (201,)] and kept["story-reports"].count() == 3


def test_story_links_are_those_of_all_cross_pairs(spark):
    """Reports of one to four names, some missing: links equal those of judging every two events."""
    import itertools
    import random

    draw = random.Random(7)
    lines = [(e, 10 * e + k, draw.randrange(3) * 100_000, sorted(draw.sample("abcde", draw.randint(1, 4)))) for e in range(60) for k in range(draw.choice((1, 1, 2, 3, 7)))]
    reports = [report(i, names=names, at=at, keywords=["flood"] if i % 7 else ["storm"]) for _, i, at, names in lines]
    names = spark.createDataFrame([(i, n) for _, i, _, names in lines for n in [*names, None]], "id long, term string")
    first = {e: sorted((at, i, set(names)) for x, i, at, names in lines if x == e)[:5] for e in range(60)}
    agrees = lambda a, b: abs(a[0] - b[0]) <= 129_600 and len(a[2] & b[2]) >= 2 and (a[1] % 7 > 0) == (b[1] % 7 > 0)
    want = [(x, y) for x, y in itertools.combinations(range(60), 2) if 3 * sum(agrees(a, b) for a in first[x] for b in first[y]) >= 2 * len(first[x]) * len(first[y])]
    got = m.story_links(spark.createDataFrame([line[:3] for line in lines], "event long, id long, at long"), frame(spark, reports), names, share=2.0)
    assert len(want) > 50 and sorted(tuple(r) for r in got.collect()) == want


def test_earlier_events_meet_in_blocks(spark, monkeypatch):
    """Events of an actor and week are judged block by block, not pair by pair; rows equal those of judging every two events."""
    import random

    made, plain, draw = [], m.written, random.Random(5)
    monkeypatch.setattr(m, "written", lambda df, label: made.append(plain(df, label)) or made[-1])
    week = 7 * 86_400
    lines = [(e, 10 * e + k, draw.randrange(5 * week)) for e in range(150) for k in range(draw.choice((1, 1, 2, 5)))]
    words = {i: draw.sample(["a", "b", "c", "d", 'e"'], draw.randint(0, 4)) * draw.randint(1, 2) for _, i, _ in lines}
    places = {i: draw.sample(["peru", "lund", "oslo"], draw.randint(0, 2)) for _, i, _ in lines}
    who = {i: draw.choice(["x", "y", "z", None]) for _, i, _ in lines}
    reports = frame(spark, [report(i, keywords=words[i], countries=places[i][:1], local_places=places[i][1:]) for _, i, _ in lines])
    members, actors = spark.createDataFrame(lines, "event long, id long, at long"), spark.createDataFrame(list(who.items()), "id long, actor string")
    of = {e: [i for x, i, _ in lines if x == e] for e in range(150)}
    at = {e: min(t for x, _, t in lines if x == e) for e in of}
    close = lambda a, b: len({*words[a]} & {*words[b]}) >= 2
    most = lambda x, y: 3 * sum(any(close(a, b) for b in of[y]) for a in of[x]) >= 2 * len(of[x])
    share = lambda x, y, held: bool({p for i in of[x] for p in held(i)} & {p for i in of[y] for p in held(i)})
    want = []
    for x in of:
        found = [y for y in of if 0 < at[x] - at[y] <= week and share(x, y, lambda i: [who[i]] if who[i] else []) and share(x, y, places.get) and most(x, y) and most(y, x)]
        agree = {y: sum(close(a, b) for a in of[x] for b in of[y]) for y in found}
        want += [(x, y, agree[y]) for y in sorted(found, key=lambda y: (-agree[y], -at[y], y))[:3]]
    for block, kinds in ((2048, 1024), (4, 3)):
        monkeypatch.setattr(m, "BLOCK", block)
        monkeypatch.setattr(m, "KINDS", kinds)
        assert sorted(tuple(r) for r in m.earlier_related(members, reports, actors).collect()) == sorted(want)
    assert len(want) > 60 and made[0].count() <= 18 < made[1].count()


def test_fragments_merge_until_no_link_is_left(spark, monkeypatch):
    """One event takes another a round: thirty-three of one event take more than thirty rounds, and none of them is an error."""
    rounds = []

    def all_pairs(now, reports, terms, of=None):
        rounds.append(1)
        events = now.select("event").distinct()
        return events.toDF("x").join(events.toDF("y"), F.col("x") < F.col("y"))

    monkeypatch.setattr(m, "fragment_links", all_pairs)
    members = spark.range(33).select((F.col("id") + 7).alias("event"), F.col("id"), F.lit(0).cast("long").alias("at"))
    terms = spark.createDataFrame([(0, "a")], "id long, term string")
    assert rows(m.merge_fragments(members, None, terms)) == rows(spark.range(8, 40).select("id", F.lit(7).cast("long"))) and len(rounds) == 33
