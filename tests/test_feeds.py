"""Planted feeds and pages: vocabularies, bases, media, encodings, limits; bodies from script state."""

import json

import pytest

from inkwell.sources.hydration import longest_body, page_bodies
from inkwell.sources.xmlfeeds import COLUMNS, decoded, feed_items, parsed_feeds, repaired

SPACES = 'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:media="http://search.yahoo.com/mrss/" xmlns:v="urn:v"'


def item(body, address="https://a.example/x/feed.xml", **kw):
    rows = feed_items(body, address)
    return [dict(zip(COLUMNS, r)) for r in rows]


def rss(inner, more=""):
    return f'<rss version="2.0" {SPACES} {more}><channel><title> Feed </title>{inner}</channel></rss>'


def only(inner, more=""):
    (row,) = item(rss(f"<item>{inner}</item>", more))
    return row


def test_fields_of_an_item():
    row = only('<title> A &amp; B </title><title>second</title><guid>7</guid><link>/p/1</link><pubDate>d1</pubDate><dc:date>d2</dc:date><description><![CDATA[<b>x</b>]]></description><dc:creator>By Ann</dc:creator><category>one</category><category>two</category><content:encoded>&lt;p&gt;body&lt;/p&gt;</content:encoded>')
    assert row == {"feed": "Feed", "guid": "7", "title": "A & B", "link": "https://a.example/p/1", "published": "d1", "description": "<b>x</b>", "content": "<p>body</p>", "author": "By Ann", "category": "one", "image": None}


def test_the_first_field_with_text_counts():
    row = only("<title> </title><title>real</title><guid></guid><guid>9</guid><dc:date>only</dc:date>")
    assert (row["title"], row["guid"], row["published"]) == ("real", "9", "only")


def test_foreign_elements_and_sources_set_nothing():
    row = only("<v:box><title>no</title><guid>no</guid><media:content url='no.jpg' width='5'/></v:box><title>yes</title>")
    assert row["title"] == "yes" and row["image"] is None and row["guid"] is None
    (row,) = item('<feed xmlns="http://www.w3.org/2005/Atom"><entry><source><title>other</title><id>no</id></source><title>own</title><id>i</id></entry></feed>')
    assert (row["title"], row["guid"], row["feed"]) == ("own", "i", None)


def test_links_and_bases():
    assert only("<guid>https://g.example/1</guid>")["link"] == "https://g.example/1"
    assert only('<guid isPermaLink="false">https://g.example/1</guid>')["link"] is None
    assert only('<link>p</link>', 'xml:base="https://b.example/one/"')["link"] == "https://b.example/one/p"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom" xml:base="https://b.example/one/"><entry xml:base="two/"><link rel="self" href="s"/><link href="p"/><link href="q"/><updated>u</updated></entry></feed>'
    assert item(atom)[0]["link"] == "https://b.example/one/two/p" and item(atom)[0]["guid"] == item(atom)[0]["link"] and item(atom)[0]["published"] == "u"


def test_media():
    assert only('<enclosure url="a.mp3" type="audio/mpeg"/><enclosure url="b" type="image/png"/>')["image"].endswith("/b")
    assert only('<media:thumbnail url="t"/><media:content url="c.jpg"/>')["image"].endswith("/t")
    assert only('<media:group><media:content url="s.jpg" width="10"/><media:content url="l.jpg" width="900"/><media:content url="m.jpg" width="100%"/></media:group>')["image"].endswith("/l.jpg")
    assert only('<media:content url="v.mp4" medium="video"/>')["image"] is None and only('<media:content url="" width="4"/>')["image"] is None
    assert only("".join(f'<media:content url="{k}.jpg" width="{k}"/>' for k in range(20)))["image"].endswith("/7.jpg")


def test_atom_content_and_rdf():
    (row,) = item('<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><author><name>Ann</name><email>x</email></author><category term="t"/><content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p class="a">x &amp; y</p></div></content></entry></feed>')
    assert (row["content"], row["author"], row["category"]) == ('<div><p class="a">x &amp; y</p></div>', "Ann", "t")
    rows = item('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel><title>R</title></channel><item><title>a</title></item><item><title>b</title></item></rdf:RDF>')
    assert [(r["feed"], r["title"]) for r in rows] == [("R", "a"), ("R", "b")]


@pytest.mark.parametrize("body", ["", "<html><body/></html>", "<rss>", "<rss version='2.0'/>", '<!DOCTYPE x [<!ENTITY a "b">]>' + rss("<item><title>&a;</title></item>"), rss("<item>" + "<v:a>" * 80 + "</v:a>" * 80 + "</item>"), "not xml"])
def test_what_is_no_feed_gives_nothing(body):
    assert feed_items(body) == []


def test_at_most_500_items():
    assert len(feed_items(rss("<item><title>x</title></item>" * 600))) == 500


def test_encodings():
    text = "Grüße – naïve"
    assert decoded(text.encode()) == text and decoded(b"\xef\xbb\xbf" + text.encode()) == text and decoded(b"\xff\xfe" + text.encode("utf-16-le")) == text
    assert decoded(text.encode("cp1252")) == text
    assert decoded('<?xml version="1.0" encoding="iso-8859-2"?>ě'.encode("iso-8859-2")).endswith("ě") and decoded("привет".encode("koi8-r"), "koi8-r") == "привет"
    assert decoded(b"\x81\x8d") == "\x81\x8d"


@pytest.mark.parametrize("text", ["Grüße – naïve", "“quoted” … €5", "привет мир", "日本語", "ça été", "Ångström"])
def test_letters_are_set_right(text):
    for broken in (text.encode().decode("latin-1"), "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())):
        assert repaired(f"a {broken} b") == f"a {text} b"
    assert repaired(text) == text  # what is right stays
    assert repaired("Â 100 Ã sein") == "Â 100 Ã sein"


def test_parsed_feeds_keep_rows_apart(spark):
    body = rss("<item><title>one</title><dc:creator>By  Ann (a@b.org)</dc:creator></item><item><title>two</title></item>")
    df = spark.createDataFrame([(1, body.encode(), "x"), (1, body.encode(), "x"), (2, None, "x"), (3, b"junk", "x"), (None, body.encode(), "x")], "id long, body binary, title string")
    rows = parsed_feeds(df, "id", "body").collect()
    assert sorted((str(r.id), r.pos, r.title, r.author) for r in rows) == sorted([(k, p, t, a) for k in ("1", "1", "None") for p, t, a in ((0, "one", "Ann"), (1, "two", None))])


LONG = "A sentence stands here. " * 40


def page(state, linked=None):
    script = f'<script type="application/ld+json">{json.dumps({"articleBody": linked})}</script>' if linked else ""
    return f'<html>{script}<script id="__NEXT_DATA__" type="application/json">{state if isinstance(state, str) else json.dumps(state)}</script></html>'


def test_bodies_from_state(spark):
    deep = {"a": [{"b": {"body": LONG}}, {"content": LONG + "more. "}]}
    nested = {"body": LONG}
    for _ in range(20):
        nested = {"x": nested}
    rows = [
        (1, page(deep), LONG + "more. "), (2, page(deep, "teaser"), LONG + "more. "), (3, page({"body": "short. text"}, "teaser"), "teaser"), (4, page(deep, LONG + LONG), LONG + LONG),
        (5, page("{broken"), None), (6, page({"body": "x" * 700}), None), (7, page(nested), None), (8, "<p>no state</p>", None), (9, None, None), (10, page({"other": LONG}), None),
        (11, page({"body": ["x"], "content": 5, "contentHtml": LONG}), LONG),
    ]
    made = page_bodies(spark.createDataFrame([(k, h, "x") for k, h, _ in rows], "id long, html string, body string"), "id", "html")
    assert {r.id: r.body for r in made.collect()} == {k: b for k, _, b in rows}
    assert longest_body([{"body": LONG}] * 100) == LONG and longest_body([0] * 64 + [{"body": LONG}]) is None
