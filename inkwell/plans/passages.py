"""Queries of passages, quotes, timelines, vectors of texts, fits, editions and functions in SQL; conversations stand for events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import age_text, coverage_text, edition_is_current, edition_start, next_edition, window_start
from ..functions.embedding import hashed, pooled, word_pieces
from ..functions.sql import register
from ..operators.calibration import calibrated, newton, threshold_for
from ..operators.evaluation import longest_run
from ..operators.quotes import timeline, voices
from ..operators.selection import accounts, highlights, novel_sentence, updated, within_budget
from ..registry import query
from ..sources.tables import table

W = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query()
def event_highlights(spark, sf_dir):
    """Five statements of each conversation; its first turn is the headline, a role a source."""
    t = _turns(spark, sf_dir)
    first = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("headline"))
    facts = t.join(first, "conv_id").select("conv_id", F.col("turn").alias("id"), F.col("role").alias("source"), F.coalesce("text", F.lit("")).alias("statement"), "headline")
    return highlights(facts, "conv_id")


@query(r"""WITH t AS (SELECT conv_id, turn AS id, text, length(text) % 97 AS score, length(text) AS n, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w, length(text) - length(regexp_replace(text, '\p{P}', '', 'g')) AS p, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS f FROM conversations),
k AS (SELECT *, CASE WHEN f > 0.3 * n THEN ceil(n / 2.0) ELSE ceil(1.3 * w + 0.5 * p) END::BIGINT AS whole FROM t), r AS (SELECT *, sum(whole) OVER (PARTITION BY conv_id ORDER BY score DESC, id) <= 150 AS fits FROM k)
SELECT conv_id, id, whole AS tokens FROM r WHERE fits""")
def passage_budget(spark, sf_dir):
    """The passages that go into a budget of 150 tokens whole, in order of their score."""
    t = _turns(spark, sf_dir).select("conv_id", F.col("turn").alias("id"), (F.length("text") % 97).alias("score"), "text")
    return within_budget(t, "conv_id", 150).where("form = 'whole'").select("conv_id", "id", "tokens")


@query()
def novel_sentences(spark, sf_dir):
    """The sentence of each turn that is farthest from the turns before."""
    return novel_sentence(_turns(spark, sf_dir).select("conv_id", F.col("turn").alias("at"), F.coalesce("text", F.lit("")).alias("text")), "conv_id")


@query(r"""WITH d AS (SELECT doc_id // 50 AS event, source AS publisher, doc_id AS id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::BIGINT AS n_words FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY event, publisher ORDER BY n_words DESC, id) AS rn FROM d WHERE n_words >= 60), k AS (SELECT *, count(*) OVER (PARTITION BY event) AS n FROM o WHERE rn = 1) SELECT event, publisher, id, n_words FROM k WHERE n >= 2""")
def perspective_accounts(spark, sf_dir):
    """The fullest account of each publisher; fifty documents in a row are an event."""
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 50").alias("event"), F.col("source").alias("publisher"), F.col("doc_id").alias("id"), "text")
    return accounts(d, "event")


@query(f"""WITH a AS (SELECT doc_id % 100 AS event, 1704067200 + doc_id * 600 AS at_, list_sort(list_distinct({W.format("regexp_extract(text, '^[^.!?\\n]*')")})) AS t FROM documents), k AS (SELECT max(at_) AS now FROM a), x AS (SELECT event, t, at_ >= now - 86400 AS fresh FROM a, k),
o AS (SELECT DISTINCT event, t FROM x WHERE NOT fresh), n AS (SELECT DISTINCT event, t FROM x WHERE fresh),
s AS (SELECT n.event, n.t, bool_or(len(o.t) > 0 AND (2.0 * len(list_intersect(n.t, o.t)) / nullif(len(n.t) + len(o.t), 0) >= 0.6 OR (len(list_intersect(n.t, o.t)) >= 3 AND len(n.t) - len(list_intersect(n.t, o.t)) <= 1 AND (len(n.t) - len(list_intersect(n.t, o.t))) / len(n.t)::DOUBLE < 0.35))) AS same FROM n JOIN o ON o.event = n.event GROUP BY 1, 2),
u AS (SELECT event, bool_or(len(t) > 0 AND NOT coalesce(same, false)) AS said FROM s GROUP BY 1) SELECT x.event, coalesce(any_value(u.said), false) AS updated FROM x LEFT JOIN u ON u.event = x.event GROUP BY 1""")
def headline_updates(spark, sf_dir):
    """R4e: events whose last day says something that no headline before did."""
    d = table(spark, sf_dir, "documents")
    now = 1704067200 + (d.agg(F.max("doc_id")).first()[0] or 0) * 600
    r = d.select((F.col("doc_id") % 100).alias("event"), (F.lit(1704067200).cast("long") + F.col("doc_id") * 600).alias("at"), F.regexp_extract("text", r"^[^.!?\n]*", 0).alias("title"))
    return updated(r, "event", now)


@query()
def attributed_quotes(spark, sf_dir):
    """P5: quotes and their voices; a document is a report of its source's event."""
    return voices(table(spark, sf_dir, "documents").select(F.col("source").alias("event"), F.col("doc_id").alias("id"), "text"), "event")


@query()
def event_timelines(spark, sf_dir):
    """What documents of a source say happened on which day."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("event"), F.col("doc_id").alias("id"), F.col("lang").alias("publisher"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("published"), "text")
    return timeline(d, "event")


@query("""WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2), s AS (SELECT label, sqrt(sum(m * m)) AS size FROM m GROUP BY 1)
SELECT m.label, (i - 1)::INT AS i, round(m / size, 6) AS x FROM m JOIN s ON s.label = m.label""")
def pooled_vectors(spark, sf_dir):
    """V2: the mean of each label's vectors, at length one."""
    p = pooled(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return p.select("label", F.posexplode("vector").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query(f"""WITH w AS (SELECT conv_id * 1000 + turn AS id, unnest(list_filter({W.format("text")}, lambda x: length(x) >= 2)) AS word FROM conversations), v AS (SELECT DISTINCT word FROM w),
b AS (SELECT word, (list_reduce(list_prepend(5381::HUGEINT, list_transform(range(1, octet_length(encode(word)) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::HUGEINT)), lambda a, c: (a * 33 + c) % 18446744073709551616) % 384)::INT AS bucket FROM v),
c AS (SELECT id, bucket, count(*) AS n FROM w JOIN b USING (word) GROUP BY 1, 2), s AS (SELECT id, sqrt(sum(n * n)) AS size FROM c GROUP BY 1)
SELECT c.id, bucket, round(n / size, 6) AS weight FROM c JOIN s ON s.id = c.id UNION ALL SELECT conv_id * 1000 + turn, 0, 1.0 FROM conversations WHERE conv_id * 1000 + turn NOT IN (SELECT id FROM c)""")
def hashed_vectors(spark, sf_dir):
    """V3: hashed word counts of each turn."""
    return hashed(_turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id", "text").select("id", "bucket", F.round("weight", 6).alias("weight"))


#: A vocabulary made by a rule: letters and digits, alone and as continuations, after the special pieces.
LETTERS = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *(p + c for p in ("", "##") for c in "abcdefghijklmnopqrstuvwxyz0123456789")])}


@query(f"""WITH t AS (SELECT conv_id, turn, {W.format("text")} AS w FROM conversations), n AS (SELECT conv_id, turn, list_sum(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '[a-z0-9]+') AND length(x) <= 100 THEN length(x) ELSE 1 END)) AS n FROM t)
SELECT conv_id, turn, (2 + least(126, coalesce(n, 0)))::INT AS n_ids FROM n""")
def word_piece_counts(spark, sf_dir):
    """V4: piece ids of each turn, 128 at most, over a vocabulary of letters."""
    made = word_pieces(_turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id", "text", None, LETTERS)
    return made.select(F.expr("id div 1000").alias("conv_id"), (F.col("id") % 1000).alias("turn"), F.size("ids").alias("n_ids"))


@query()
def longest_runs(spark, sf_dir):
    """Q9: the longest run of words that each turn shares with the turn before, and its share of the turn."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return longest_run(_turns(spark, sf_dir).select("conv_id", "turn", "text", before.alias("before")).where("before IS NOT NULL"), ["conv_id", "turn"], "text", "before")


def _verdicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, sf_dir, "labels").where("quality IS NOT NULL").join(d, "doc_id").select(
        F.col("doc_id").alias("at"), "quality", (F.least(F.col("n_chars"), F.lit(4000)) / 4000.0).alias("size"), (F.col("lang") == "en").cast("double").alias("english"), ((F.col("doc_id") % 10) / 10.0).alias("turn"),
    )


@query()
def verdict_calibration(spark, sf_dir):
    """Weights of a reader's verdicts by gradient descent."""
    names = ["size", "english", "turn"]
    w = calibrated(_verdicts(spark, sf_dir), names, "quality", "at")
    return spark.createDataFrame([] if w is None else list(zip(["bias", *names], (round(float(x), 6) for x in w), strict=True)), "feature string, weight double")


@query()
def pair_head(spark, sf_dir):
    """Probabilities under an L2 logistic fit by Newton steps, each one aggregation over the table."""
    v, names = _verdicts(spark, sf_dir), ["size", "english", "turn"]
    return threshold_for(v, newton(v, names, "quality"), names).select(F.col("at").alias("doc_id"), F.round("probability", 6).alias("probability"))


@query("""SELECT event_id, (CASE WHEN ts >= date_trunc('day', ts) + INTERVAL 7 HOUR THEN date_trunc('day', ts) + INTERVAL 7 HOUR ELSE date_trunc('day', ts) - INTERVAL 17 HOUR END)::VARCHAR AS started, (CASE WHEN ts >= date_trunc('day', ts) + INTERVAL 7 HOUR THEN date_trunc('day', ts) + INTERVAL 31 HOUR ELSE date_trunc('day', ts) + INTERVAL 7 HOUR END)::VARCHAR AS following,
 ts - INTERVAL (event_id % 30) HOUR >= (CASE WHEN ts >= date_trunc('day', ts) + INTERVAL 7 HOUR THEN date_trunc('day', ts) + INTERVAL 7 HOUR ELSE date_trunc('day', ts) - INTERVAL 17 HOUR END) AS is_current, (ts::DATE - 29)::VARCHAR AS since FROM events""")
def editions(spark, sf_dir):
    """The edition due at seven, the following one, whether one chosen some hours before still stands, and the start of thirty days."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("now"))
    chosen = F.col("now") - F.make_dt_interval(hours=(F.col("event_id") % 30).cast("int"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", text(edition_start(F.col("now"), 7)).alias("started"), text(next_edition(F.col("now"), 7)).alias("following"), edition_is_current(chosen, F.col("now"), 7).alias("is_current"), window_start(F.col("now")).cast("string").alias("since"))


@query("""WITH m AS (SELECT user_id, max(ts) AS last, count(*) AS n, count(DISTINCT event_type) AS k FROM events GROUP BY 1), a AS (SELECT *, epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(last)) AS age FROM m)
SELECT user_id, CASE WHEN age < 60 THEN 'Just now' WHEN age < 3600 THEN floor(age / 60)::BIGINT || ' min. ago' WHEN age < 86400 THEN floor(age / 3600)::BIGINT || ' hr. ago' ELSE strftime(last, '%b ') || day(last) END AS age, n || CASE WHEN n = 1 THEN ' story' ELSE ' stories' END || ' · ' || k || CASE WHEN k = 1 THEN ' publisher' ELSE ' publishers' END AS coverage FROM a""")
def card_texts(spark, sf_dir):
    """How long ago, and how much."""
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last"), F.count("*").alias("n"), F.count_distinct("event_type").alias("k"))
    return m.select("user_id", age_text(F.col("last"), F.lit("2024-01-30 12:00:00").cast("timestamp")).alias("age"), coverage_text(F.col("n"), F.col("k")).alias("coverage"))


HOST_SQL = r"regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '^www\.', '')"


@query(rf"""SELECT page_id, {HOST_SQL} AS host, regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) || regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '/$', '') AS key, {HOST_SQL} = 'news1.example.com' OR {HOST_SQL} LIKE '%.news1.example.com' AS muted,
 contains(' ' || array_to_string({W.format("url")}, ' ') || ' ', ' utm source ') AS topic FROM pages""")
def sql_functions(spark, sf_dir):
    """UD1: functions called from SQL."""
    register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("inkwell_pages")
    return spark.sql("SELECT page_id, ink_host(url) AS host, ink_feed_key(url) AS key, ink_muted_source(url, array('news1.example.com')) AS muted, ink_muted_topic(url, '', array('UTM source')) AS topic FROM inkwell_pages")


PADDED = "' ' || array_to_string(" + W + ", ' ') || ' '"


@query(rf"""WITH d AS (SELECT doc_id, {PADDED.format("regexp_extract(text, '^[^.!?\n]*')")} AS t, {PADDED.format("text")} AS b FROM documents),
s AS (SELECT doc_id, 3.5 * (contains(t, ' rights reserved '))::INT + 0.5 * (contains(b, ' rights reserved ') AND NOT contains(t, ' rights reserved '))::INT + CASE WHEN contains(t, ' license ') THEN 7.0 WHEN contains(b, ' license ') THEN 1.0 ELSE 0 END AS law,
 0.5 * (CASE WHEN contains(t, ' the ') THEN 3.5 WHEN contains(b, ' the ') THEN 0.5 ELSE 0 END + CASE WHEN contains(t, ' and ') THEN 3.5 WHEN contains(b, ' and ') THEN 0.5 ELSE 0 END) AS prose, CASE WHEN contains(t, ' de ') THEN 3.5 WHEN contains(b, ' de ') THEN 0.5 ELSE 0 END AS french FROM d)
SELECT doc_id, CASE WHEN greatest(law, prose, french) < 2 THEN NULL WHEN law >= prose AND law >= french THEN 'law' WHEN prose >= french THEN 'prose' ELSE 'french' END AS topic FROM s""")
def sql_topics(spark, sf_dir):
    """UD1 R13: topics of whole documents by a function called from SQL, its taxonomy an argument."""
    register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("inkwell_documents")
    known = "array(('law', 'license', 2D), ('law', 'Rights-reserved', 1D), ('prose', 'the', 0.5D), ('prose', 'and', 0.5D), ('french', 'de', 1D))"
    return spark.sql(rf"SELECT doc_id, ink_topic(regexp_extract(text, '^[^.!?\\n]*', 0), '', text, transform({known}, t -> named_struct('label', t.col1, 'phrase', t.col2, 'factor', t.col3))) AS topic FROM inkwell_documents")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], v), 6) AS cosine FROM embeddings, q""")
def sql_cosine(spark, sf_dir):
    """UD1 V1: cosine of unit vectors in SQL."""
    register(spark)
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("inkwell_embeddings")
    return spark.sql("SELECT a.vec_id, round(ink_cosine(CAST(a.embedding AS ARRAY<DOUBLE>), CAST(q.embedding AS ARRAY<DOUBLE>)), 6) AS cosine FROM inkwell_embeddings a CROSS JOIN (SELECT embedding FROM inkwell_embeddings WHERE vec_id = 7) q")  # one row


@query("""SELECT doc_id, contains(text, '100%') OR contains(text, 'a_b') AS held FROM documents""")
def like_literals(spark, sf_dir):
    """T4: substrings with LIKE's own wildcards, taken as they are."""
    from ..functions.text import like_escaped

    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (t.like("%" + like_escaped("100%") + "%") | t.like("%" + like_escaped("a_b") + "%")).alias("held"))


@query("""WITH s AS (SELECT doc_id AS id, (n_chars % 97) / 96.0 AS a, (n_chars % 53) / 52.0 AS b FROM documents), x AS (SELECT id FROM s ORDER BY a DESC, id LIMIT 100), y AS (SELECT id FROM s ORDER BY b DESC, id LIMIT 100) SELECT count(*) / 100.0 AS shared FROM x JOIN y USING (id)""")
def top_list_overlap(spark, sf_dir):
    """Q5: how much of two lists' first hundred is the same."""
    from ..operators.evaluation import top_overlap

    d = table(spark, sf_dir, "documents")
    side = lambda n: d.select(F.col("doc_id").alias("id"), ((F.col("n_chars") % n) / float(n - 1)).alias("score"))
    return top_overlap(side(97), side(53), 100)


@query(r"""WITH a AS (SELECT doc_id, source, doc_id // 100 AS grp, list_distinct(list_filter(string_split_regex(lower(regexp_extract(text, '^[^.!?\n]*')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM documents),
p AS (SELECT a.grp, a.source, len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0)::DOUBLE AS j FROM a JOIN a b ON a.grp = b.grp AND a.source = b.source AND a.doc_id < b.doc_id) SELECT grp, source, round(least(0.95, 0.5 + 1.25 * coalesce(avg(j), 0)), 6) AS confidence FROM p GROUP BY 1, 2""".replace("\\\\", "\\"))
def grouping_confidence(spark, sf_dir):
    """How sure a group of titles is, by the mean Jaccard similarity of its pairs; a group is a source's part of a hundred documents."""
    from ..functions.text import jaccard, words

    a = table(spark, sf_dir, "documents").select("doc_id", "source", F.expr("doc_id div 100").alias("grp"), F.array_distinct(words(F.regexp_extract("text", r"^[^.!?\n]*", 0))).alias("w"))
    b = a.select(F.col("doc_id").alias("other"), "source", "grp", F.col("w").alias("v"))
    p = a.join(b, ["grp", "source"]).where("doc_id < other")
    return p.groupBy("grp", "source").agg(F.round(F.least(F.lit(0.95), 0.5 + 1.25 * F.coalesce(F.avg(jaccard(F.col("w"), F.col("v"))), F.lit(0.0))), 6).alias("confidence"))


#: Region anchors (latitude, longitude), by region key: Nairobi, Chicago, Singapore, Frankfurt, Dubai.
ANCHORS = ((0, -1.3, 36.8), (1, 41.9, -87.6), (2, 1.35, 103.8), (3, 50.1, 8.7), (4, 25.2, 55.3))


@query(f"""WITH n AS (SELECT n_nationkey, (n_nationkey * 37 % 140 - 70)::DOUBLE AS lat, (n_nationkey * 53 % 360 - 180)::DOUBLE AS lon FROM nation), a(anchor, alat, alon) AS (VALUES {", ".join(map(str, ANCHORS))}),
d AS (SELECT n_nationkey, anchor, 2 * 6371.0 * asin(sqrt(pow(sin(radians(alat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(alat)) * pow(sin(radians(alon - lon) / 2), 2))) AS km FROM n, a)
SELECT n_nationkey, arg_min(anchor, (km, anchor))::INT AS anchor, round(min(km), 3) AS km FROM d GROUP BY 1""")
def nearest_anchors(spark, sf_dir):
    """The nearest region anchor of each place and how far it is; the anchors are a few literals, so no join is made."""
    from ..functions.vectors import great_circle

    lat, lon = ((F.col("n_nationkey") * 37 % 140 - 70).cast("double"), (F.col("n_nationkey") * 53 % 360 - 180).cast("double"))
    away = F.array_min(F.array(*(F.struct(great_circle(lat, lon, F.lit(a), F.lit(o)).alias("km"), F.lit(k).alias("anchor")) for k, a, o in ANCHORS)))
    n = table(spark, sf_dir, "nation").select("n_nationkey", away.alias("x"))
    return n.select("n_nationkey", F.col("x.anchor").alias("anchor"), F.round("x.km", 3).alias("km"))


@query("""SELECT c.conv_id, c.turn, (c.turn + c.conv_id % 5) AS cited, EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = c.conv_id AND b.turn = c.turn + c.conv_id % 5) AS stands FROM conversations c""")
def citations_exist(spark, sf_dir):
    """Whether the passage that a citation names exists; turns cite a turn some places on."""
    c = _turns(spark, sf_dir).select("conv_id", "turn", (F.col("turn") + F.col("conv_id") % 5).alias("cited"))
    held = _turns(spark, sf_dir).select("conv_id", F.col("turn").alias("cited"), F.lit(True).alias("met")).distinct()
    return c.join(held, ["conv_id", "cited"], "left").select("conv_id", "turn", "cited", F.coalesce("met", F.lit(False)).alias("stands"))


@query("""WITH s AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS a, list(DISTINCT l_linestatus) AS b FROM lineitem GROUP BY 1) SELECT k, len(list_distinct(list_concat(a, b)))::INT AS both, len(list_intersect(a, b))::INT AS shared, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS only, list_has_any(a, b) AS meets FROM s""")
def set_algebra(spark, sf_dir):
    """Union, intersection, difference and overlap of an order's flag sets."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return s.select("k", F.size(F.array_union("a", "b")).alias("both"), F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_except("a", "b")).alias("only"), F.arrays_overlap("a", "b").alias("meets"))


@query("""WITH t AS (SELECT user_id, event_type AS field, event_id, 'v' || event_id AS value FROM events) SELECT user_id, field, arg_max(value, event_id) AS token FROM t GROUP BY 1, 2""")
def tag_tokens(spark, sf_dir):
    """Of a reader's tokens for one field the latest counts."""
    t = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field"), "event_id")
    return t.groupBy("user_id", "field").agg(F.concat(F.lit("v"), F.max("event_id").cast("string")).alias("token"))
