"""Feeds as columns of text: RSS, RDF and Atom by ``from_xml``, JSON Feed by ``from_json``, OPML outlines."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of what is read.
MAX_BODY, GUARDED, MAX_ITEMS = 10_000_000, 65_536, 500
MAX_DEPTH, MAX_OUTLINES = 64, 20_000

_ITEM = "struct<guid:string,title:string,link:string,pubDate:string,description:string,author:string>"
_FEED = f"title string, channel struct<title:string,item:array<{_ITEM}>>, item array<{_ITEM}>, entry array<struct<id:string,title:string,updated:string,published:string,summary:string,author:struct<name:string>,link:array<struct<_href:string,_rel:string>>>>"
_JSON = "title string, version string, items array<struct<id:string,url:string,title:string,content_text:string,content_html:string,date_published:string,author:struct<name:string>,authors:array<struct<name:string>>>>"


def safe_xml(body: Column) -> Column:
    """Bodies within the size limit that declare no entities or attribute lists."""
    return (F.length(body) <= MAX_BODY) & ~F.left(body, F.lit(GUARDED)).rlike(r"(?i)<!(ENTITY|ATTLIST)")


def byline(text: Column) -> Column:
    """An author's name without its introduction, mail address and surplus white space; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)^\s*(by|von|par|por)\s+", ""), r"\s*[<(][^<>()]*@[^<>()]*[>)]|\S+@\S+\s*", "")
    return F.nullif(F.btrim(F.regexp_replace(bare, r"\s+", " ")), F.lit(""))


def xml_items(df: DataFrame, body: str) -> DataFrame:
    """A row for each item of the feeds in ``body``: df's other columns, feed, guid, title, link, published, description, author.

    Unsafe or malformed bodies, and XML that is no feed, give no rows.
    """
    keep = [c for c in df.columns if c != body]
    read = df.where(safe_xml(F.col(body))).select(*keep, F.from_xml(F.col(body), _FEED, {"mode": "PERMISSIVE"}).alias("x"))
    made = lambda i, author: F.struct(
        F.coalesce(i.guid, i.link).alias("guid"), F.btrim(i.title).alias("title"), i.link.alias("link"), i.pubDate.alias("published"), i.description.alias("description"), byline(author).alias("author")
    )
    rss = F.transform(F.coalesce("x.channel.item", "x.item"), lambda i: made(i, i.author))

    def entry(i: Column) -> Column:
        own = F.filter(i.link, lambda k: F.coalesce(k._rel, F.lit("alternate")) == "alternate")
        return F.struct(i.id.alias("guid"), F.btrim(i.title).alias("title"), F.get(own, 0)._href.alias("link"), F.coalesce(i.published, i.updated).alias("published"), i.summary.alias("description"), byline(i.author["name"]).alias("author"))

    items = F.coalesce(rss, F.transform("x.entry", entry))
    out = read.select(*keep, F.coalesce("x.channel.title", "x.title").alias("feed"), F.explode(F.slice(items, 1, MAX_ITEMS)).alias("i"))
    return out.select(*keep, "feed", "i.*")


def json_items(df: DataFrame, body: str) -> DataFrame:
    """A row for each of the first 500 items of the JSON Feeds in ``body``; integer ids are read as text."""
    keep = [c for c in df.columns if c != body]
    read = df.where(F.length(body) <= MAX_BODY).select(*keep, F.from_json(body, _JSON).alias("x")).where(F.col("x.version").contains("jsonfeed.org/version/"))
    out = read.select(*keep, F.col("x.title").alias("feed"), F.explode(F.slice("x.items", 1, MAX_ITEMS)).alias("i"))
    author = F.coalesce(F.get("i.authors", 0)["name"], F.col("i.author.name"))
    return out.select(*keep, "feed", F.coalesce("i.id", "i.url").alias("guid"), "i.title", F.col("i.url").alias("link"), F.col("i.date_published").alias("published"), F.coalesce("i.content_text", "i.content_html").alias("description"), byline(author).alias("author"))


def outlines(body: str) -> list[tuple[str, str, str]]:
    """(folder path, title, url) of an OPML text; nothing for unsafe, malformed or too deep ones."""
    if len(body) > MAX_BODY or "<!ENTITY" in body[:GUARDED].upper():
        return []
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return []
    out: list[tuple[str, str, str]] = []
    stack = [(x, ()) for x in reversed(root.findall("./body/outline"))]
    while stack and len(out) < MAX_OUTLINES:
        node, path = stack.pop()
        name = (node.get("title") or node.get("text") or "").strip()
        if url := (node.get("xmlUrl") or "").strip():
            out.append(("/".join(path), name, url))
        if len(path) < MAX_DEPTH:
            stack += [(x, path if url else (*path, name)) for x in reversed(node.findall("outline"))]
    return out


def opml_outlines(df: DataFrame, id_col: str, body: str) -> DataFrame:
    """(id, folder, title, url): the feeds of each OPML text with their folder paths."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(i, *o) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for o in outlines(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), *[pa.string()] * 3])], ["id", "folder", "title", "url"])

    return df.select(F.col(id_col).cast("long").alias("id"), body).mapInArrow(batches, "id long, folder string, title string, url string")


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def opml(feeds: DataFrame, group: str, folder: str, title: str, url: str) -> DataFrame:
    """(group, opml): an OPML text for each group's feeds (group is a user or library: its feeds are few), folders in order."""
    line = F.concat(F.lit('<outline type="rss" text="'), escaped(F.col(title)), F.lit('" xmlUrl="'), escaped(F.col(url)), F.lit('"/>'))
    inner = feeds.groupBy(group, folder).agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("lines"))
    whole = F.concat(F.lit('<outline text="'), escaped(F.col(folder)), F.lit('">'), "lines", F.lit("</outline>"))
    body = F.array_join(F.array_sort(F.collect_list(whole)), "")
    return inner.groupBy(group).agg(F.concat(F.lit('<opml version="2.0"><body>'), body, F.lit("</body></opml>")).alias("opml"))
