"""Library pages, filters, counts and scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import padded_phrase, words
from ..functions.urls import canonical_url, is_document_url, link_host
from ..operators.filters import Binder, matches, muted_hosts, muted_topics, page_after, parse_search
from ..registry import query
from ..sources.tables import ARTICLES_SQL, articles, table

DUPLICATES_SQL = "duplicates AS (SELECT id FROM (SELECT id, min(id) OVER (PARTITION BY body) AS keep FROM articles) WHERE id <> keep)"


def visible(spark, sf_dir):
    """Articles but for later copies of one text."""
    a = articles(spark, sf_dir)
    # Texts are compared by digest, so the wide column isn't shuffled.
    digest = a.select("id", F.sha2("body", 256).alias("digest"))
    keep = digest.groupBy("digest").agg(F.min("id").alias("keep"))
    hidden = digest.join(keep, "digest").where("id <> keep").select("id")
    return a.join(hidden, "id", "left_anti")


@query(f"""WITH {ARTICLES_SQL}, {DUPLICATES_SQL}
SELECT id, source, lang, published FROM articles WHERE id NOT IN (SELECT id FROM duplicates) ORDER BY published DESC, id LIMIT 50""")
def visible_latest_page(spark, sf_dir):
    """The newest page of articles that no earlier copy hides."""
    return page_after(visible(spark, sf_dir).select("id", "source", "lang", "published"), "published", "id", None, 50)


@query(f"""WITH {ARTICLES_SQL}, {DUPLICATES_SQL}
SELECT id, source, published FROM articles
WHERE id NOT IN (SELECT id FROM duplicates) AND (published < 1704067200 + 9000 OR (published = 1704067200 + 9000 AND id > 150))
ORDER BY published DESC, id LIMIT 25""")
def keyset_page_2(spark, sf_dir):
    """K2: the page after a cursor."""
    return page_after(visible(spark, sf_dir).select("id", "source", "published"), "published", "id", (1704067200 + 9000, 150), 25)


@query(f"""WITH {ARTICLES_SQL}
SELECT id, source FROM articles
WHERE contains(lower(source), 'src1') AND contains(' ' || array_to_string(list_filter(string_split_regex(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ', ' of the ')
  AND contains(lower(body), 'tion')""".replace("\\\\", "\\"))
def filter_operators(spark, sf_dir):
    """A parsed query of operators, a term and a phrase."""
    a = articles(spark, sf_dir)
    return a.where(matches(parse_search('source:src1 "of the" tion'), F.col("body"), F.col("source"))).select("id", "source")


HOST_SQL = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '^www\.', '')"


@query(f"""SELECT page_id, {HOST_SQL} AS host FROM pages
WHERE NOT ({HOST_SQL} = 'news1.example.com' OR {HOST_SQL} LIKE '%.site2.example.com' OR {HOST_SQL} = 'site2.example.com' OR {HOST_SQL} LIKE '%.news1.example.com')""")
def mute_host(spark, sf_dir):
    """Pages whose host no rule covers."""
    pages = table(spark, sf_dir, "pages").select("page_id", link_host(F.col("url")).alias("host"))
    return pages.where(~muted_hosts(pages, "host", ["news1.example.com", "site2.example.com"]))


@query("""WITH p AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS padded FROM documents)
SELECT doc_id FROM p WHERE NOT (contains(padded, ' under the mit license ') OR contains(padded, ' all rights reserved '))""".replace("\\\\", "\\"))
def mute_topic(spark, sf_dir):
    """Documents without a muted phrase as whole words."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.where(~muted_topics(F.col("text"), ["under the MIT License", "All rights reserved"])).select("doc_id")


@query("""WITH p AS (SELECT ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS padded FROM documents),
r(rule) AS (VALUES ('mit license'), ('apache license'), ('of the'), ('zebra crossing'))
SELECT rule, count(padded)::BIGINT AS n FROM r LEFT JOIN p ON contains(padded, ' ' || rule || ' ') GROUP BY rule""".replace("\\\\", "\\"))
def muted_rule_counts(spark, sf_dir):
    """how many documents each rule mutes, zero included; one pass over the documents."""
    rules = ["mit license", "apache license", "of the", "zebra crossing"]
    padded = table(spark, sf_dir, "documents").select(padded_phrase(F.col("text")).alias("p"))
    counts = padded.agg(*(F.count_if(F.col("p").contains(f" {r} ")).alias(f"c{i}") for i, r in enumerate(rules)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"c{i}").alias("n")) for i, r in enumerate(rules)))))


def _binder(name, binder, where):
    def run(spark, sf_dir):
        d = table(spark, sf_dir, "documents")
        return d.where(binder.condition(F.col("text"), F.col("source"), F.col("lang"))).select("doc_id", "source", "lang")

    run.__name__, run.__doc__ = name, "F8: a binder's documents."
    query(f"SELECT doc_id, source, lang FROM documents WHERE {where}")(run)


_binder("smart_binder_any", Binder(categories=["EN", "fr"], include=["tion", "100%"]), "lower(lang) IN ('en', 'fr') AND (contains(lower(text), 'tion') OR contains(lower(text), '100%'))")
_binder("smart_binder_all", Binder(publishers=["src1", "src2", "src3"], include=["the", "tion"], include_all=True), "source IN ('src1', 'src2', 'src3') AND contains(lower(text), 'the') AND contains(lower(text), 'tion')")
_binder("smart_binder_exclude", Binder(categories=["en"], exclude=["###", "license_"]), "lang = 'en' AND NOT contains(lower(text), '###') AND NOT contains(lower(text), 'license_')")


# Fixed values for the example: section keywords.
SECTIONS = {"Licensing": ["license", "licensed under", "rights reserved"], "Contact": ["mail", "call"]}


@query("""WITH p AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS padded FROM documents)
SELECT doc_id, 'Licensing' AS section FROM p WHERE contains(padded, ' license ') OR contains(padded, ' licensed under ') OR contains(padded, ' rights reserved ')
UNION ALL SELECT doc_id, 'Contact' FROM p WHERE contains(padded, ' mail ') OR contains(padded, ' call ')""".replace("\\\\", "\\"))
def section_predicate(spark, sf_dir):
    """documents by section, from keyword phrases."""
    p = table(spark, sf_dir, "documents").select("doc_id", padded_phrase(F.col("text")).alias("p"))
    hit = [F.when(F.exists(F.array(*map(F.lit, keys)), lambda k: F.col("p").contains(F.concat(F.lit(" "), k, F.lit(" ")))), F.lit(s)) for s, keys in SECTIONS.items()]
    return p.select("doc_id", F.explode(F.array_compact(F.array(*hit))).alias("section"))


@query("""WITH feed AS (SELECT DISTINCT l_suppkey AS feed, l_orderkey AS id FROM lineitem), hidden AS (SELECT s_suppkey AS feed FROM supplier WHERE s_acctbal < 0)
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'
  OR EXISTS (SELECT 1 FROM feed WHERE id = o_orderkey AND feed NOT IN (SELECT feed FROM hidden))
  OR NOT EXISTS (SELECT 1 FROM feed WHERE id = o_orderkey)""")
def collection_scope(spark, sf_dir):
    """Items of hidden feeds stay out unless kept by state, in another feed, or in none."""
    feed = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("feed"), F.col("l_orderkey").alias("id"))
    hidden = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("feed"), F.lit(True).alias("hidden"))
    seen = feed.join(hidden, "feed", "left").groupBy("id").agg(F.bool_and(F.coalesce("hidden", F.lit(False))).alias("all_hidden"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    joined = orders.join(seen, F.col("o_orderkey") == F.col("id"), "left")
    return joined.where((F.col("o_orderstatus") == "P") | ~F.coalesce("all_hidden", F.lit(False))).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND epoch(o_orderdate) BETWEEN epoch(TIMESTAMP '1995-03-01') AND epoch(TIMESTAMP '1996-03-01')""")
def folder_scope_window(spark, sf_dir):
    """Members of a folder by semi join, inside a time window."""
    folder = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf_dir, "orders").where("o_orderdate BETWEEN timestamp'1995-03-01' AND timestamp'1996-03-01'")
    return orders.join(folder, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("""SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-20 00:15:00' THEN floor(epoch(ts))::BIGINT END AS known FROM events""")
def future_date_clamp(spark, sf_dir):
    """dates over a quarter of an hour past now are unknown."""
    from ..functions.dates import known_date

    e = table(spark, sf_dir, "events")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return e.select("event_id", F.unix_seconds(known_date(F.col("ts"), now).cast("timestamp")).alias("known"))


@query(f"""SELECT page_id, coalesce(nullif({HOST_SQL}, ''), 'unknown') AS publisher FROM pages""")
def publisher_name(spark, sf_dir):
    """publisher from the link's host, else the given source."""
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(link_host(F.col("url")), F.lit("unknown")).alias("publisher"))


@query(r"""WITH p AS (SELECT page_id, trim(url) AS u FROM pages),
q AS (SELECT page_id, u, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
  regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(u, '(#.*)$', 1) AS frag FROM p),
r AS (SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ('ref','rss_source','feedburner','fbclid','gclid','mc_cid','mc_eid','yclid','igshid')) AS kept FROM q)
SELECT page_id, CASE WHEN lower(scheme) = 'http' THEN 'https' ELSE scheme END || '://' || host || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || frag AS canonical FROM r""")
def canonical_url_pages(spark, sf_dir):
    """Canonical addresses."""
    return table(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical"))


@query(r"""SELECT page_id, (regexp_matches(url, '^https?://[^/?#]+') AND (regexp_matches(url, '^https?://[^/?#]+/*[^/?#]') OR regexp_matches(url, '^https?://[^/?#]+[^?#]*\?[^#]'))) AS is_document FROM pages""")
def document_urls(spark, sf_dir):
    """Whether an address names a document."""
    return table(spark, sf_dir, "pages").select("page_id", is_document_url(F.col("url")).alias("is_document"))


@query("""SELECT count(*)::BIGINT AS total, (count(*) FILTER (WHERE o_orderstatus = 'F'))::BIGINT AS saved, (count(*) FILTER (WHERE o_orderpriority = '1-URGENT'))::BIGINT AS urgent FROM orders""")
def library_counts(spark, sf_dir):
    """A1: conditional counts in one pass."""
    o = table(spark, sf_dir, "orders")
    return o.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("saved"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS reports FROM lineitem WHERE l_returnflag = 'N')
SELECT count(DISTINCT CASE WHEN reports >= 2 THEN 'story:' || l_orderkey ELSE 'article:' || l_partkey END)::BIGINT AS cards FROM r""")
def unread_story_count(spark, sf_dir):
    """A2: distinct cards; an event with two or more reports is one card."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", "l_partkey")
    # Per event: its number of reports, and the one part where it has one. No window over raw rows is needed.
    per = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_partkey").alias("part"))
    card = F.when(F.col("n") >= 2, F.concat(F.lit("story:"), "l_orderkey")).otherwise(F.concat(F.lit("article:"), "part"))
    return per.agg(F.count_distinct(card).alias("cards"))


@query("""WITH e AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
SELECT count(*)::BIGINT AS stories, (count(*) FILTER (WHERE parts >= 2))::BIGINT AS grouped FROM e""")
def list_totals(spark, sf_dir):
    """A3: stories and grouped events under a filter."""
    e = table(spark, sf_dir, "lineitem").where("l_quantity > 10").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("parts"))
    return e.agg(F.count("*").alias("stories"), F.count_if(F.col("parts") >= 2).alias("grouped"))


@query("""WITH w AS (SELECT unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS word FROM documents)
SELECT word, count(*)::BIGINT AS n FROM w GROUP BY word HAVING count(*) >= 20""".replace("\\\\", "\\"))
def spelling_vocab(spark, sf_dir):
    """How often each word occurs."""
    w = table(spark, sf_dir, "documents").select(F.explode(words(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).where("n >= 20")
