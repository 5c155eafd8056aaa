"""Identity queries: keys, aliases, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import backoff_seconds, feed_date, retry_seconds
from ..functions.text import digits_for_number_words, folded_words, phrase, sentences, slug, token_estimate, words
from ..functions.urls import canonical_url, feed_key, link_host
from ..registry import query
from ..sources.tables import articles, table


@query(r"""SELECT doc_id, 'fp_' || left(sha256(lower(trim(regexp_extract(text, '^[^.!?\n]*'))) || '|' || lower(trim(source)) || '|' || (1704067200 + doc_id * 60)), 16) AS fingerprint FROM documents""")
def content_fingerprint(spark, sf_dir):
    """The fallback key of title, source and time."""
    a = articles(spark, sf_dir)
    raw = F.concat_ws("|", F.lower(F.btrim("title")), F.lower(F.btrim("source")), F.col("published").cast("string"))
    return a.select(F.col("id").alias("doc_id"), F.concat(F.lit("fp_"), F.left(F.sha2(raw, 256), F.lit(16))).alias("fingerprint"))


@query()
def article_identity(spark, sf_dir):
    """Scoped GUID, else address, else fingerprint."""
    p = table(spark, sf_dir, "pages")
    guid = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("guid-"), F.col("page_id")))
    feed = F.concat(F.lit("https://"), link_host(F.col("url")), F.lit("/feed"))
    framed = F.concat(F.octet_length(feed).cast("string"), F.lit(":"), feed, guid)
    return p.select("page_id", F.coalesce(F.concat(F.lit("feed-guid:"), F.sha2(framed, 256)), F.nullif(canonical_url(F.col("url")), F.lit(""))).alias("identity"))


@query()
def feed_keys(spark, sf_dir):
    """Subscription keys."""
    return table(spark, sf_dir, "pages").select("page_id", feed_key(F.col("url")).alias("key"))


@query("""WITH a AS (SELECT 'host:' || (l_suppkey % 70) AS value, l_orderkey % 100 AS target FROM lineitem) SELECT value, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target, count(DISTINCT target)::BIGINT AS n FROM a GROUP BY 1""")
def alias_resolution(spark, sf_dir):
    """An alias resolves only where it has one target."""
    a = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("host:"), F.col("l_suppkey") % 70).alias("value"), (F.col("l_orderkey") % 100).alias("target"))
    g = a.groupBy("value").agg(F.count_distinct("target").alias("n"), F.min("target").alias("low"))
    return g.select("value", F.when(F.col("n") == 1, F.col("low")).alias("target"), "n")


@query("SELECT doc_id AS duplicate, keep AS survivor FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS keep FROM documents) WHERE doc_id <> keep")
def reconciliation(spark, sf_dir):
    """Duplicates and their survivors; the group-by combines hot texts before the shuffle."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    keep = d.groupBy("h").agg(F.min("doc_id").alias("survivor"), F.count("*").alias("n")).where("n > 1").select("h", "survivor")
    return d.join(keep, "h").where("doc_id <> survivor").select(F.col("doc_id").alias("duplicate"), "survivor")


@query(r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, len(w)::INT AS n, md5(array_to_string(w, ' ')) AS head FROM t""")
def folded_titles(spark, sf_dir):
    """Words with diacritics folded."""
    w = folded_words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n"), F.md5(F.array_join(w, " ")).alias("head"))


@query(r"""SELECT c_custkey, 'person:' || array_to_string(list_filter(string_split_regex(strip_accents(lower(c_name)), '[^\p{L}\p{N}]+'), lambda x: x <> ''), '-') AS slug FROM customer""")
def entity_slugs(spark, sf_dir):
    """T3."""
    return table(spark, sf_dir, "customer").select("c_custkey", slug(F.lit("person"), F.col("c_name")).alias("slug"))


@query()
def token_estimates(spark, sf_dir):
    """Estimated tokens, sentences, and number words as digits."""
    d = table(spark, sf_dir, "conversations")
    return d.select("conv_id", "turn", token_estimate(F.col("text")).alias("tokens"), F.size(sentences(F.col("text"))).alias("sentences"), F.array_join(digits_for_number_words(words(F.col("text"))), " ").alias("normal"))


#: How feeds write a time, by number: Spark's pattern, what follows it, and how far from UTC it is.
WRITTEN = (
    ("'Fri, 'dd MMM yyyy HH:mm:ss", " GMT", 0), ("d MMM yy HH:mm", " +0200", 7200), ("yyyy-MM-dd'T'HH:mm:ss", "Z", 0), ("yyyy-MM-dd'T'HH:mm:ss'.250'", "+01:00", 3600), ("MMM d, yyyy", "", None),
    ("yyyy-MM-dd", "", None), ("'Mon, 'd MMM yyyy HH:mm:ss", " CET", 3600), ("'soon'", "", None), ("d-MMM-yyyy HH:mm:ss", " -0500", -18000), ("yyyy-MM-dd HH:mm:ss", "", 0), ("d MMM yyyy", "", None),
)


@query("""WITH e AS (SELECT event_id, epoch(date_trunc('minute', ts))::BIGINT AS at_, (event_id % 11)::INT AS k FROM events)
SELECT event_id, CASE WHEN k = 7 THEN NULL WHEN k IN (4, 5, 10) THEN at_ - at_ % 86400 ELSE at_ - [0, 7200, 0, 3600, 0, 0, 3600, 0, -18000, 0, 0][k + 1] END AS at_ FROM e""")
def feed_dates(spark, sf_dir):
    """The times of events as feeds write them, in eleven ways by the event's number, read back."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("t"), (F.col("event_id") % len(WRITTEN)).alias("k"))
    raw = F.coalesce(*(F.when(F.col("k") == k, F.concat(F.date_format("t", p), F.lit(end))) for k, (p, end, _) in enumerate(WRITTEN)))
    return e.select("event_id", F.unix_seconds(feed_date(raw)).alias("at_"))


@query("SELECT user_id, least(21600, 600 * pow(2, least(n, 40) - 1))::BIGINT AS wait FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)")
def backoff(spark, sf_dir):
    """T15."""
    n = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", backoff_seconds(F.col("n")).alias("wait"))


@query("""WITH e AS (SELECT event_id, epoch(date_trunc('minute', ts))::BIGINT AS at_ FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 5000 WHEN 1 THEN CASE WHEN event_id % 3 > 0 THEN 600 * (event_id % 3) END WHEN 2 THEN NULL ELSE 90 END::BIGINT AS wait FROM e""")
def retry_after(spark, sf_dir):
    """What events' answers ask to wait: seconds, an HTTP date ahead or past, neither."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("t"))
    k = F.col("event_id") % 4
    until = F.date_format(F.timestamp_seconds(F.unix_seconds("t") + 600 * (F.col("event_id") % 3)), "'Fri, 'dd MMM yyyy HH:mm:ss' GMT'")
    header = F.when(k == 0, (F.col("event_id") % 5000).cast("string")).when(k == 1, until).when(k == 2, "later").otherwise(" 90 ")
    return e.select("event_id", "t", header.alias("header")).select("event_id", retry_seconds(F.col("header"), F.col("t")).alias("wait"))


@query(r"""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, length(props)::INT AS n, position('k' IN props)::INT AS at_ FROM events""")
def json_functions(spark, sf_dir):
    """Values out of JSON text."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.length("props").alias("n"), F.instr("props", "k").alias("at_"))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS p, round(100 * (1 - exp(-value / 25)), 6) AS scaled, round(pow(2, -value / 24), 6) AS decayed FROM events")
def scales(spark, sf_dir):
    """Logistic, saturating scale, half-life decay."""
    from ..functions.dates import decay, saturating, sigmoid

    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(sigmoid((v - 50) / 10), 6).alias("p"), F.round(saturating(v), 6).alias("scaled"), F.round(decay(v, 24.0), 6).alias("decayed"))


@query(r"""SELECT page_id, array_to_string(list_filter(string_split_regex(lower(url), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') AS phrase FROM pages""")
def phrases(spark, sf_dir):
    """T1."""
    return table(spark, sf_dir, "pages").select("page_id", phrase(F.col("url")).alias("phrase"))
