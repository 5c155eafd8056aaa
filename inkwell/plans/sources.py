"""Queries over feeds, outlines, pages and exports. Feeds are made from documents, so that SQL knows what they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.feeds import byline, escaped, json_items, opml, opml_outlines, xml_items
from ..sources.html import hrefs, page_blocks, plain_text, readable, structured_bodies
from ..sources.sinks import epub_volumes, markdown, snapshot
from ..sources.tables import articles, table
from ..streaming.events import shared_folder

ITEMS = r"""SELECT doc_id::VARCHAR AS guid, source AS feed, nullif(trim(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), ' '), '') AS title FROM documents"""


def _plain_title():
    return F.btrim(F.regexp_replace("text", "[^A-Za-z0-9 ]", ""))


@query(ITEMS)
def rss_items(spark, sf_dir):
    """Items of RSS feeds, a feed for each document."""
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), escaped(c), F.lit(f"</{n}>"))
    item = F.concat(F.lit("<item>"), tag("guid", F.col("doc_id").cast("string")), tag("title", _plain_title()), F.lit("</item>"))
    feeds = table(spark, sf_dir, "documents").select(F.concat(F.lit('<rss version="2.0"><channel>'), tag("title", F.col("source")), item, F.lit("</channel></rss>")).alias("body"))
    return xml_items(feeds, "body").select("guid", "feed", F.nullif("title", F.lit("")).alias("title"))


@query(ITEMS)
def atom_items(spark, sf_dir):
    """The same as Atom entries."""
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), escaped(c), F.lit(f"</{n}>"))
    entry = F.concat(F.lit("<entry>"), tag("id", F.col("doc_id").cast("string")), tag("title", _plain_title()), F.lit('<link rel="alternate" href="https://x.example/1"/></entry>'))
    feeds = table(spark, sf_dir, "documents").select(F.concat(F.lit("<feed>"), tag("title", F.col("source")), entry, F.lit("</feed>")).alias("body"))
    return xml_items(feeds, "body").select("guid", "feed", F.nullif("title", F.lit("")).alias("title"))


@query("SELECT doc_id::VARCHAR AS guid, source AS feed, text AS description FROM documents")
def json_feed_items(spark, sf_dir):
    """S3: whole texts through JSON Feed."""
    items = F.array(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("content_text")))
    feeds = table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.col("source").alias("title"), items.alias("items"))).alias("body"))
    return json_items(feeds, "body").select("guid", "feed", "description")


PLAIN = r"trim(regexp_replace(regexp_replace({}, '[^\\p{{L}}\\p{{N}} ]', ' ', 'g'), ' +', ' ', 'g'), ' ')"


def made_feeds(spark, sf_dir):
    """(feed_no, kind, body): feeds of ten documents each as bytes: RSS in UTF-8, RDF, Atom with a base address, and RSS whose letters were read as Windows-1252 once."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 10").alias("feed_no"), F.btrim(F.regexp_replace(F.regexp_replace("text", r"[^\p{L}\p{N} ]", " "), " +", " ")).alias("text"), F.regexp_replace("source", r"[^\p{L}\p{N}]", "").alias("source"))
    d = d.where("text <> ''").withColumn("kind", F.expr("feed_no % 4"))
    number = F.col("doc_id").cast("string")
    tag = lambda n, c, more="": F.concat(F.lit(f"<{n}{more}>"), c, F.lit(f"</{n}>"))
    media = F.concat(F.lit('<media:group><media:content url="small.jpg" width="10"/><media:content url="big'), number, F.lit('.jpg" width="200%"/><media:content url="wide'), number, F.lit('.jpg" width="300"/></media:group><vendor:x xmlns:vendor="urn:v"><title>not this</title></vendor:x>'))
    broken = lambda c: F.when(F.col("kind") == 3, F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")).otherwise(c)
    rss = F.concat(F.lit("<item>"), tag("guid", number, ' isPermaLink="false"'), tag("title", broken(F.left("text", F.lit(80)))), tag("link", F.concat(F.lit("/a/"), number)), media, tag("dc:creator", F.concat(F.lit("By "), "source")), tag("content:encoded", F.col("text")), F.lit("</item>"))
    atom = F.concat(F.lit("<entry>"), tag("id", number), F.lit("<source><title>other</title></source>"), tag("title", F.left("text", F.lit(80))), F.lit('<link rel="self" href="/s"/><link href="../a/'), number, F.lit('"/>'), media, tag("author", tag("name", F.col("source"))), tag("content", F.concat(F.lit('<p xmlns="http://www.w3.org/1999/xhtml">'), "text", F.lit("</p>")), ' type="xhtml"'), F.lit("</entry>"))
    spaces = ' xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:media="http://search.yahoo.com/mrss/"'
    item = F.when(F.col("kind") == 2, atom).otherwise(rss)
    each = d.select("feed_no", "kind", "doc_id", item.alias("item"))
    # ten items a feed at most
    grouped = each.groupBy("feed_no", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"]), "").alias("items"))
    name = F.concat(F.lit("<title>feed "), F.col("feed_no").cast("string"), F.lit("</title>"))
    body = (
        F.when(F.col("kind") == 1, F.concat(F.lit(f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"{spaces}><channel>'), name, F.lit("</channel>"), "items", F.lit("</rdf:RDF>")))
        .when(F.col("kind") == 2, F.concat(F.lit(f'<feed xmlns="http://www.w3.org/2005/Atom" xml:base="https://f.example/deep/feed/"{spaces}>'), name, "items", F.lit("</feed>")))
        .otherwise(F.concat(F.lit(f'<?xml version="1.0"?><rss version="2.0"{spaces}><channel>'), name, "items", F.lit("</channel></rss>")))
    )
    return grouped.select("feed_no", "kind", F.encode(body, "UTF-8").alias("body"), F.lit("https://f.example/deep/index.xml").alias("address"))


@query(f"""WITH d AS (SELECT doc_id, doc_id // 10 AS feed_no, {PLAIN.format("text")} AS text, regexp_replace(source, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS source FROM documents), k AS (SELECT *, feed_no % 4 AS kind FROM d WHERE text <> '')
SELECT doc_id::VARCHAR AS guid, 'feed ' || feed_no AS feed, trim(left(text, 80), ' ') AS title, CASE WHEN kind = 2 THEN 'https://f.example/deep/a/' ELSE 'https://f.example/a/' END || doc_id AS link, CASE WHEN kind = 2 THEN '<p>' || text || '</p>' ELSE text END AS content, source AS author,
       CASE WHEN kind = 2 THEN 'https://f.example/deep/feed/wide' ELSE 'https://f.example/deep/wide' END || doc_id || '.jpg' AS image FROM k""".replace("\\\\", "\\"))
def feed_items(spark, sf_dir):
    """Whole documents through RSS, RDF and Atom as bytes: namespaces, base addresses, media groups, foreign elements, repaired letters."""
    from ..sources.xmlfeeds import parsed_feeds

    return parsed_feeds(made_feeds(spark, sf_dir), "feed_no", "body", "address").select("guid", "feed", "title", "link", "content", "author", "image")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 'user ' || user_id END AS author FROM events")
def bylines(spark, sf_dir):
    """authors' names as feeds write them."""
    name = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    kinds = [F.concat(F.lit("By  "), name), F.concat(name, F.lit(" (a@b.org)")), F.concat(F.lit(" "), name, F.lit("\n")), F.lit("a@b.org")]
    raw = F.coalesce(*(F.when(F.col("event_id") % 4 == k, c) for k, c in enumerate(kinds)))
    return table(spark, sf_dir, "events").select("event_id", byline(raw).alias("author"))


@query("SELECT s_suppkey % 7 AS id, 'nation ' || s_nationkey AS folder, s_name AS title, 'https://f.example/' || s_suppkey AS url FROM supplier")
def opml_roundtrip(spark, sf_dir):
    """Feeds of users written as OPML and read again."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7).alias("user"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("folder"), "s_name", F.concat(F.lit("https://f.example/"), F.col("s_suppkey").cast("string")).alias("url"))
    return opml_outlines(opml(s, "user", "folder", "s_name", "url"), "user", "opml")


@query()
def html_blocks(spark, sf_dir):
    """Each page's best container, its blocks, link density and quality verdict."""
    made = page_blocks(table(spark, sf_dir, "pages").select("page_id", "html"))
    return made.select(F.col("id").alias("page_id"), "title", "container", F.size("blocks").alias("n_blocks"), F.round("density", 6).alias("density"), readable(F.col("blocks")).alias("rejected"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::INT AS n_links, len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1)))::INT AS n_distinct FROM pages""")
def html_links(spark, sf_dir):
    """Links of each page."""
    return table(spark, sf_dir, "pages").select("page_id", F.size(hrefs(F.col("html"))).alias("n_links"), F.size(F.array_distinct(hrefs(F.col("html")))).alias("n_distinct"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_text(spark, sf_dir):
    """All text of each page by built-in functions."""
    return table(spark, sf_dir, "pages").select("page_id", plain_text(F.col("html")).alias("text"))


@query("SELECT doc_id, text AS body FROM documents WHERE text NOT LIKE '%<%' AND length(text) > 0")
def jsonld_bodies(spark, sf_dir):
    """Article bodies from JSON-LD scripts; the pages are made from documents."""
    d = table(spark, sf_dir, "documents").where("text NOT LIKE '%<%' AND length(text) > 0")
    page = F.concat(F.lit('<html><script type="application/ld+json">'), F.to_json(F.struct(F.col("text").alias("articleBody"))), F.lit("</script><p>x</p></html>"))
    return d.select("doc_id", F.get(structured_bodies(page), 0).alias("body"))


@query("""WITH d AS (SELECT doc_id, text FROM documents WHERE text NOT LIKE '%<%' AND length(text) > 0)
SELECT doc_id, CASE WHEN length(text) >= 600 AND contains(text, '. ') THEN text ELSE 'teaser' END AS body FROM d""")
def page_state_bodies(spark, sf_dir):
    """Bodies from script state, deep in it, where JSON-LD has but a teaser; the pages are made from documents."""
    from ..sources.hydration import page_bodies

    d = table(spark, sf_dir, "documents").where("text NOT LIKE '%<%' AND length(text) > 0")
    state = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.lit("x").alias("body"), F.col("text").alias("contentHtml"))).alias("blocks"), F.lit(1).alias("n")).alias("page")).alias("props")))
    page = F.concat(F.lit('<html><script type="application/ld+json">{"articleBody": "teaser"}</script><script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script></html>"))
    return page_bodies(d.select("doc_id", page.alias("html")), "doc_id", "html").select(F.col("id").alias("doc_id"), "body")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_rows(spark, sf_dir):
    """A JSON column's members as rows."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-10') SELECT event_id FROM e WHERE n <= 2""")
def due_fetches(spark, sf_dir):
    """Due fetches, two a host."""
    from pyspark.sql import Window

    due = table(spark, sf_dir, "events").where("ts <= TIMESTAMP_NTZ '2024-01-10'")
    n = F.row_number().over(Window.partitionBy(F.col("user_id") % 40).orderBy("ts", "event_id"))
    return due.withColumn("n", n).where("n <= 2").select("event_id")


@query("""WITH e AS (SELECT event_id AS feed, event_id % 7 AS fetcher, user_id % 40 AS host, epoch(ts)::BIGINT AS due, event_type, CASE WHEN event_id % 11 = 0 THEN epoch(ts)::BIGINT + 864000 END AS retry_at FROM events),
w AS (SELECT fetcher, host, max(due + 3600 * (1 + feed % 400)) AS until FROM e WHERE event_type = 'error' AND due <= 1704844800 GROUP BY 1, 2),
o AS (SELECT e.* FROM e LEFT JOIN w USING (fetcher, host) WHERE due <= 1704844800 AND coalesce(until, 0) <= 1704844800 AND coalesce(retry_at, 0) <= 1704844800),
h AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY fetcher, host ORDER BY due, feed) <= 2)
SELECT fetcher, feed, row_number() OVER (PARTITION BY fetcher ORDER BY due, feed)::INT AS place FROM h QUALIFY place <= 6""")
def fetch_waves(spark, sf_dir):
    """What seven fetchers start at once: two a host, six in all, without hosts that cool down and feeds that wait."""
    from ..operators import fetching

    now = 1_704_844_800
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("feed"), (F.col("event_id") % 7).alias("fetcher"), (F.col("user_id") % 40).alias("host"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("due"), "event_type")
    refused = e.where(f"event_type = 'error' AND due <= {now}").select("fetcher", "host", F.col("due").alias("at"), (3600 * (1 + F.col("feed") % 400)).alias("wait"))
    feeds = e.withColumn("retry_at", F.when(F.col("feed") % 11 == 0, F.col("due") + 864_000))
    return fetching.fetch_waves(feeds, fetching.cooldowns(refused), now)


@query(r"""SELECT doc_id AS id, '---' || chr(10) || 'source: "' || source || '"' || chr(10) || 'lang: "' || lang || '"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || regexp_extract(text, '^[^.!?\n]*') || chr(10) || chr(10) || text || chr(10) AS markdown FROM documents""")
def markdown_export(spark, sf_dir):
    """Articles as Markdown with front matter."""
    return articles(spark, sf_dir).select("id", markdown(F.col("title"), F.col("body"), {"source": F.col("source"), "lang": F.col("lang")}).alias("markdown"))


@query("SELECT source, count(*)::BIGINT AS n_documents FROM documents GROUP BY 1")
def epub_contents(spark, sf_dir):
    """EPUB volumes of each source."""
    made = epub_volumes(articles(spark, sf_dir), "source", "id", "title", "body")
    return made.groupBy("source").agg(F.sum("n_documents").alias("n_documents"))


@query("SELECT count(*)::BIGINT AS n_rows, true AS ok FROM orders")
def snapshot_check(spark, sf_dir):
    """A table written and compared with what reads back."""
    return snapshot(table(spark, sf_dir, "orders"), shared_folder(spark, "snapshot"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def saved_index(spark, sf_dir):
    """The saved articles that a search index takes."""
    saved = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(saved, "doc_id", "left_semi")
