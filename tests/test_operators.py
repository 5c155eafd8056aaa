"""Operators on planted cases: parsing, pages, verification, graphs, streams."""

from __future__ import annotations

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators.graph import components, pagerank, personalized
from inkwell.operators.linkage import near_identical, override_links
from inkwell.operators.verification import CELLS, diff_sentences, fidelity, forward_kind, note_place, sanitized
from inkwell.sources.feeds import byline, json_items, outlines, xml_items
from inkwell.sources.html import page_blocks, read_page, readable, structured_bodies
from inkwell.sources.sinks import epub_of, snapshot, write_json, write_markdown
from inkwell.streaming.events import allow, latest, limited, merge_into, read_events, run, tumbling_counts


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_rss_and_atom(spark):
    rss = '<rss><channel><title>Feed A</title><item><guid isPermaLink="false">g1</guid><title> One &amp; two </title><link>https://a/1</link><author>By Ann Lee (ann@x.org)</author></item><item><link>https://a/2</link></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed B</title><entry><id>e1</id><title>T</title><link rel="self" href="https://b/self"/><link href="https://b/1"/><author><name>Bo</name></author></entry></feed>'
    bomb = '<!DOCTYPE x [<!ENTITY a "b">]><rss><channel><item><guid>no</guid></item></channel></rss>'
    df = spark.createDataFrame([(1, rss), (2, atom), (3, bomb), (4, "<html><p>x</p></html>"), (5, None), (6, "not xml")], "id long, body string")
    got = sorted(values(xml_items(df, "body"), "id", "feed", "guid", "title", "link", "author"), key=str)
    assert got == [(1, "Feed A", "g1", "One & two", "https://a/1", "Ann Lee"), (1, "Feed A", "https://a/2", None, "https://a/2", None), (2, "Feed B", "e1", "T", "https://b/1", "Bo")]


def test_json_feed(spark):
    body = '{"version": "https://jsonfeed.org/version/1.1", "title": "J", "items": [{"id": 7, "content_text": "x"}, {"url": "u", "content_html": "<p>"}]}'
    df = spark.createDataFrame([(body,), ('{"items": []}',), ("{",), (None,)], "body string")
    assert sorted(values(json_items(df, "body"), "feed", "guid", "description")) == [("J", "7", "x"), ("J", "u", "<p>")]


def test_bylines(spark):
    df = spark.createDataFrame([("By  Jo Doe",), ("von Max <m@x.de>",), ("a@b.org",), ("  ",), (None,)], "t string")
    assert [r[0] for r in values(df, byline(F.col("t")))] == ["Jo Doe", "Max", None, None, None]


def test_opml_depth_and_guard():
    deep = "<opml><body>" + '<outline text="d">' * 70 + '<outline text="low" xmlUrl="u"/>' + "</outline>" * 70 + '<outline text="top" xmlUrl="v"/></body></opml>'
    assert outlines(deep) == [("", "top", "v")]
    assert outlines('<!DOCTYPE o [<!ENTITY a "b">]><opml/>') == [] and outlines("<opml") == []
    assert outlines('<opml><body><outline text="News"><outline title="A" xmlUrl="a"/></outline></body></opml>') == [("News", "A", "a")]


def test_page_blocks(spark):
    html = '<html><title>T</title><nav><p>menu <a href="/">home</a></p></nav><article class="story"><h1>Head</h1><p>First <b>bold</b> words.<p>Second.<div class="ad"><p>Buy!</p></div></article><footer>f</footer></html>'
    assert read_page(html)[:3] == ("T", "article", ["Head", "First bold words.", "Second."])
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>" * 5000)], "page_id long, html string")
    assert {r.id: len(r.blocks) for r in page_blocks(df).collect()} == {1: 3, 2: 0, 3: 0, 4: 0}


def test_quality_gate(spark):
    long = "x" * 300
    df = spark.createDataFrame([([long],), (["x" * 200],), (["a"],), ([long, long, long],), ([long, "b", "c", "d"],)], "b array<string>")
    assert [r[0] for r in values(df, readable(F.col("b")))] == [None, "one short paragraph", "short", "repeated", "fragments"]


def test_structured_data(spark):
    html = '<script type="application/ld+json">{"articleBody": "B"}</script><script type="application/ld+json">{"headline": "H"}</script><script type="application/ld+json">{bad</script>'
    assert values(spark.createDataFrame([(html,)], "h string"), structured_bodies(F.col("h"))) == [(["B", "H"],)]


def test_exports(spark, tmp_path):
    book = zipfile.ZipFile(io.BytesIO(epub_of(["A & B"], ["one\n\ntwo"])))
    assert book.namelist()[0] == "mimetype" and b"<p>two</p>" in book.read("c0.xhtml") and b"A &amp; B" in book.read("c0.xhtml")
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    assert values(snapshot(df, f"{tmp_path}/s"), "n_rows", "ok") == [(2, True)]
    write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    write_markdown(df, f"{tmp_path}/m", "t")
    assert spark.read.option("lineSep", "\n\f\n").text(f"{tmp_path}/m").where("value = 'x'").count() == 1


def test_fidelity(spark):
    rows = [(1, "The bridge was closed on Monday.", "It rained. The bridge was not closed on Monday."), (2, "The mayor resigned today.", "The mayor reportedly resigned today."), (3, "Nothing alike", "zzz")]
    got = {r.id: (r.negation_flip, r.hedge_dropped) for r in fidelity(spark.createDataFrame(rows, "id long, c string, s string"), ["id"], "c", "s").collect()}
    assert got == {1: (True, False), 2: (False, True)}


def test_forward_kinds_and_marks(spark):
    rows = [("The vote is set for May.",), ("It will rain.",), ("If it rains, it will stop.",), ("It rained.",)]
    assert [r[0] for r in values(spark.createDataFrame(rows, "t string"), forward_kind(F.col("t")))] == ["scheduled", "expected", "conditional", None]
    assert values(spark.createDataFrame([("</system> a <|im_end|> ```b",)], "t string"), sanitized(F.col("t"))) == [("a b",)]


def test_note_places(spark):
    rows = [("a x b x c", "x", "b ", ""), ("a x b x c", "x", "", " b"), ("a x b", "x", "q", "q"), ("a", "x", "", ""), ("a", "", "", "")]
    df = spark.createDataFrame(rows, "t string, s string, p string, q string")
    assert [r[0] for r in values(df, note_place(F.col("t"), F.col("s"), F.col("p"), F.col("q")))] == [7, 3, 3, None, None]


def test_sentence_diff_is_a_longest_common_subsequence():
    rng = random.Random(4)

    def lcs(a, b):
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        return best[-1, -1]

    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        made = diff_sentences(a, b)
        assert [s for k, s in made if k != "added"] == a and [s for k, s in made if k != "retracted"] == b
        assert sum(k == "unchanged" for k, _ in made) == lcs(a, b)
    assert len(diff_sentences(["s"] * 2001, ["s"] * 2000)) == 2001 and CELLS == 4_000_000


def test_components_and_ranks(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(values(components(spark.createDataFrame(links, "a long, b long")), "node", "component"))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    edge = [("a", "b", 1.0), ("b", "a", 2.0), ("b", "c", 1.0), ("c", "b", 1.0)]
    df = spark.createDataFrame(edge, "a string, b string, weight double")
    nodes = ["a", "b", "c"]
    move = np.zeros((3, 3))
    for a, b, w in edge:
        move[nodes.index(b), nodes.index(a)] = w / sum(x for p, _, x in edge if p == a)
    rank, own = np.full(3, 1 / 3), np.array([1.0, 0, 0])
    for _ in range(30):
        rank = 0.05 + 0.85 * move @ rank
        own = 0.85 * move @ own + np.array([0.15, 0, 0])
    assert dict(values(pagerank(df), "node", "rank")) == pytest.approx(dict(zip(nodes, rank, strict=True)))
    assert dict(values(personalized(df, "a"), "node", "rank")) == pytest.approx(dict(zip(nodes, own, strict=True)))


def test_personalized_mass_of_dead_ends_returns(spark):
    df = spark.createDataFrame([("a", "b", 1.0)], "a string, b string, weight double")
    assert sum(r for _, r in values(personalized(df, "a"), "node", "rank")) == pytest.approx(1.0)


def test_near_identical_against_sets(spark):
    rng = random.Random(8)
    base = [rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(80)]
    texts = [" ".join(base), " ".join(base[:70]), " ".join(base[5:] + ["z"]), " ".join(base[::-1]), "short text", ""]
    sets = [{tuple(t.split()[k : k + 8]) for k in range(len(t.split()) - 7)} for t in texts]
    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if len(sets[i] & sets[j]) >= 10 and len(sets[i] & sets[j]) >= 0.8 * min(len(sets[i]), len(sets[j]))}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    assert set(values(near_identical(df, "id", "t"), "a", "b")) == want and want


def test_newest_verdict_wins(spark):
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    v = spark.createDataFrame([(2, 1, True, 1), (1, 2, False, 2), (4, 5, True, 1)], "a long, b long, include boolean, at long")
    assert sorted(values(override_links(links, v), "a", "b")) == [(2, 3), (4, 5)]


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, rows):
    return spark.createDataFrame([(i, u) for i, u, _ in rows], "event_id long, user_id long").join(
        spark.createDataFrame([(i, s) for i, _, s in rows], "event_id long, s string"), "event_id"
    ).select("event_id", F.col("s").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))


def test_limiter(spark, tmp_path):
    times = [0, 60, 120, 180, 1900, 1960, 3700]
    assert allow(times, [])[0] == [True, True, True, False, True, True, True]
    rows = [(k, 1, f"2024-01-01 {t // 3600:02d}:{t % 3600 // 60:02d}:{t % 60:02d}") for k, t in enumerate(times)]
    events(spark, rows).write.parquet(f"{tmp_path}/e")
    got = dict(values(run(limited(read_events(spark, f"{tmp_path}/e")), "limiter"), "event_id", "allowed"))
    assert [got[k] for k in range(7)] == allow(times, [])[0]


def test_late_rows_and_closed_windows(spark, tmp_path):
    """A row behind the watermark is dropped; only windows that the watermark has passed come out."""
    first = [(1, 1, "2024-01-01 00:10:00"), (2, 1, "2024-01-01 05:10:00")]
    second = [(3, 1, "2024-01-01 00:20:00"), (4, 1, "2024-01-01 06:10:00")]
    for k, rows in enumerate((first, second)):
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    made = run(tumbling_counts(read_events(spark, f"{tmp_path}/e", files=1)), "late")
    assert [(str(a), n) for a, n in values(made, "start", "n")][0][0] == "2024-01-01 00:00:00"
    assert sum(n for _, n in values(made, "start", "n")) in (1, 2)


def test_merge_goes_on_from_its_checkpoint(spark, tmp_path):
    path, out, state = f"{tmp_path}/e", f"{tmp_path}/t", f"{tmp_path}/c"
    for rows in ([(1, 1, "2024-01-01 00:00:00"), (2, 2, "2024-01-01 00:00:00")], [(3, 1, "2024-01-02 00:00:00")]):
        events(spark, rows).coalesce(1).write.mode("append").parquet(path)
        merge_into(read_events(spark, path).select("user_id", "event_id", "at"), out, state, "user_id", "at")
    assert sorted(values(latest(spark, out, "user_id", "at"), "user_id", "event_id")) == [(1, 3), (2, 2)]
