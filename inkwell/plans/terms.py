"""Queries over a dictionary of phrases: topics, sectors and places. The benchmark's passages give the phrases, so the dictionary grows with its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators.phrases import dictionary, phrase_hits
from ..operators.places import equirectangular, first_places, mercator, named_places, nearest_regions
from ..operators.taxonomy import classified, sector_impacts
from ..registry import query
from ..sources.tables import table

WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
#: Phrases taken out of texts before topics are sought, and the words that keep a text at home.
REMOVED, CUES = ["of the", "in the by"], ["the", "of"]
#: Implications: words of the benchmark with this ending.
IMPLIES = "tion"

PHRASES = f"""b AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
phrases AS (
  SELECT item_id % 12 AS class_no, 'topic ' || (item_id % 12) AS label, (CASE WHEN item_id % 3 = 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS factor, unnest(list_filter(w, lambda x: length(x) >= 8)) AS phrase FROM b
  UNION ALL SELECT item_id % 12, 'topic ' || (item_id % 12), 1.0, w[k] || ' ' || w[k + 1] FROM b, range(1, 9) r(k) WHERE k + 1 <= len(w)),
taxonomy AS (SELECT class_no, label, phrase, max(factor) AS factor FROM phrases GROUP BY ALL)"""
GRAMS = "list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"


def topic_phrases(spark, sf_dir):
    """(class_no, label, factor, phrase): twelve classes; long words and the first pairs of words of each passage."""
    b = table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("w"))
    keyed = lambda phrase, factor: b.select(F.expr("item_id % 12").alias("class_no"), F.concat(F.lit("topic "), F.expr("item_id % 12").cast("string")).alias("label"), factor.alias("factor"), F.explode(phrase).alias("phrase"))
    single = keyed(F.filter("w", lambda x: F.length(x) >= 8), F.when(F.expr("item_id % 3") == 0, 0.5).otherwise(1.0))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.least(F.size("w") - 1, F.lit(8))), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))).otherwise(F.array().cast("array<string>"))
    return single.unionByName(keyed(pairs, F.lit(1.0)))


FIELDS = r"""SELECT doc_id, regexp_extract(text, '^[^.!?\n]*') AS title, regexp_extract(text, '^[^.!?\n]*[.!?\n]+\s*([^.!?\n]*)', 1) AS description, text AS body, CASE WHEN doc_id % 50 = 0 THEN ' TOPIC 7 ' END AS hint FROM documents"""
TAKEN = "replace(replace(' ' || array_to_string({}, ' ') || ' ', ' of the ', ' '), ' in the by ', ' ')"


@query(f"""WITH {PHRASES}, d AS ({FIELDS}),
f AS (SELECT doc_id, 'title' AS field, 3.0 AS points, title AS t FROM d UNION ALL SELECT doc_id, 'description', 1.5, description FROM d UNION ALL SELECT doc_id, 'body', 0.5, body FROM d),
c AS (SELECT doc_id, field, points, list_filter(string_split({TAKEN.format(WORDS.format("coalesce(t, '')"))}, ' '), lambda x: x <> '') AS w FROM f),
g AS (SELECT doc_id, field, points, unnest({GRAMS}) AS phrase FROM c),
m AS (SELECT g.*, class_no, label, factor FROM g JOIN taxonomy USING (phrase)),
s AS (SELECT doc_id, class_no, label, sum(points::DOUBLE * factor) AS score, list_sort(list_distinct(list(phrase) FILTER (WHERE field <> 'body'))) AS evidence FROM m GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, (label = 'topic 0')::INT, class_no) AS place FROM s),
abroad AS (SELECT DISTINCT doc_id FROM m WHERE field = 'title' AND label = 'topic 2'), home AS (SELECT DISTINCT doc_id FROM g WHERE field = 'title' AND phrase IN ('the', 'of')),
k AS (SELECT doc_id, CASE WHEN label = 'topic 1' AND doc_id IN (FROM abroad) AND doc_id NOT IN (FROM home) THEN 'topic 2' ELSE label END AS label, score, evidence FROM r WHERE place = 1 AND score >= 2)
SELECT coalesce(d.doc_id, k.doc_id) AS doc_id, coalesce(d.label, k.label) AS label, CASE WHEN d.doc_id IS NOT NULL THEN 0.95::DOUBLE ELSE round(least(0.95::DOUBLE, 0.5 + 0.08 * k.score), 6) END AS confidence, round(k.score, 6) AS score,
       CASE WHEN d.doc_id IS NOT NULL THEN 'TOPIC 7' ELSE coalesce(array_to_string(k.evidence, '|'), '') END AS evidence
FROM k FULL JOIN (SELECT doc_id, 'topic 7' AS label FROM d WHERE hint IS NOT NULL AND EXISTS (SELECT 1 FROM taxonomy WHERE label = 'topic 7')) d ON d.doc_id = k.doc_id""")
def topic_classification(spark, sf_dir):
    """Twelve classes by phrases in title, description and whole text; one class is the catch-all, one yields to another abroad, a hint decides."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_extract("text", r"^[^.!?\n]*", 0).alias("title"), F.regexp_extract("text", r"^[^.!?\n]*[.!?\n]+\s*([^.!?\n]*)", 1).alias("description"), F.col("text").alias("body"), F.when(F.expr("doc_id % 50") == 0, " TOPIC 7 ").alias("hint")
    )
    made = classified(d, "doc_id", {"title": "title", "description": "description", "body": "body"}, topic_phrases(spark, sf_dir), REMOVED, "topic 0", ("topic 1", "topic 2", CUES), "hint")
    return made.select(F.col("id").alias("doc_id"), "label", F.round("confidence", 6).alias("confidence"), F.round("score", 6).alias("score"), F.array_join("evidence", "|").alias("evidence"))


SENTENCES = r"""list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s, ' ')), lambda s: s <> '')"""
IMPACTS = f"""{PHRASES},
i AS (SELECT DISTINCT x AS phrase FROM (SELECT unnest(w) AS x FROM b) WHERE x LIKE '%{IMPLIES}'),
cut AS (SELECT doc_id, unnest({SENTENCES}) AS sentence, generate_subscripts({SENTENCES}, 1) - 1 AS pos FROM documents),
kept AS (SELECT doc_id, pos, sentence, {WORDS.format("sentence")} AS w0 FROM cut WHERE NOT contains(sentence, 'Th')),
g0 AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos, unnest(w0) AS phrase FROM kept) JOIN i USING (phrase)),
g AS (SELECT doc_id, pos, unnest({GRAMS}) AS phrase FROM (SELECT doc_id, pos, list_filter(string_split({TAKEN.format("w0")}, ' '), lambda x: x <> '') AS w FROM kept JOIN g0 USING (doc_id, pos))),
s AS (SELECT doc_id, pos, class_no, label, count(*) AS cues, max(length(phrase)) AS longest FROM g JOIN taxonomy USING (phrase) GROUP BY 1, 2, 3, 4),
one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY cues DESC, longest DESC, class_no) = 1),
f AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY pos) = 1),
impacts AS (SELECT doc_id, pos::INT AS pos, sentence, label, cues::INT AS cues FROM f JOIN cut USING (doc_id, pos) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 4)"""


def _impacts(spark, sf_dir):
    phrases = topic_phrases(spark, sf_dir)
    implications = table(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("phrase")).where(F.col("phrase").endswith(IMPLIES)).distinct()
    return sector_impacts(table(spark, sf_dir, "documents"), "doc_id", "text", phrases, implications, REMOVED, F.col("sentence").contains("Th"))


@query(f"WITH {IMPACTS} SELECT doc_id, pos, sentence, label, cues FROM impacts")
def industry_impact(spark, sf_dir):
    """Sentences that tell what something means for a sector, one a sector and four a document (the feature's limits), over twelve sectors."""
    return _impacts(spark, sf_dir).withColumnRenamed("id", "doc_id")


@query(f"WITH {IMPACTS} SELECT label AS sector, count(DISTINCT doc_id)::BIGINT AS stories, count(*)::BIGINT AS passages FROM impacts GROUP BY 1")
def sector_cards(spark, sf_dir):
    """Stories and passages by sector."""
    return _impacts(spark, sf_dir).groupBy(F.col("label").alias("sector")).agg(F.count_distinct("id").alias("stories"), F.count("*").alias("passages"))


def gazetteer(spark, sf_dir):
    """(place_id, name, lat, lon, is_area): every passage is a place named by its first two words, and by its first three."""
    b = table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= 3)
    names = F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 1, 3), " ")))
    return b.select(F.col("item_id").alias("place_id"), names.alias("name"), F.expr("CAST(item_id * 37 % 180 - 90 AS DOUBLE)").alias("lat"), F.expr("CAST(item_id * 101 % 360 - 180 AS DOUBLE)").alias("lon"), F.expr("item_id % 2 = 0").alias("is_area"))


def _regions(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("region_id"), F.expr("CAST(n_nationkey * 37 % 140 - 70 AS DOUBLE)").alias("lat"), F.expr("CAST(n_nationkey * 53 % 360 - 180 AS DOUBLE)").alias("lon"))


@query(f"""WITH b AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
z AS (SELECT name, min(item_id) AS place_id, size FROM (SELECT item_id, array_to_string(w[1:2], ' ') AS name, 2 AS size FROM b WHERE len(w) >= 3 UNION ALL SELECT item_id, array_to_string(w[1:3], ' '), 3 FROM b WHERE len(w) >= 3) GROUP BY name, size),
d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, i AS p0, w[i + 1:i + n] AS run, n FROM d, range(2, 4) r(n), unnest(range(0, len(w) - n + 1)) u(i)),
m AS (SELECT doc_id, p0, size, place_id FROM g JOIN z ON z.name = array_to_string(g.run, ' ') AND z.size = g.n),
f AS (SELECT doc_id, arg_min(place_id, p0 * 10 - size) AS place_id FROM m GROUP BY 1),
p AS (SELECT doc_id, place_id, (place_id * 37 % 180 - 90)::DOUBLE AS lat, (place_id * 101 % 360 - 180)::DOUBLE AS lon FROM f),
r AS (SELECT n_nationkey AS region_id, (n_nationkey * 37 % 140 - 70)::DOUBLE AS rlat, (n_nationkey * 53 % 360 - 180)::DOUBLE AS rlon FROM nation),
n AS (SELECT doc_id, arg_min(region_id, (q, -region_id)) AS region_id, min(q) AS q FROM (SELECT doc_id, region_id, pow(rlat - lat, 2) + pow(CASE WHEN abs(rlon - lon) > 180 THEN 360 - abs(rlon - lon) ELSE abs(rlon - lon) END, 2) AS q FROM p, r) WHERE q <= 625 GROUP BY 1)
SELECT p.doc_id, place_id, place_id % 2 = 0 AS is_area, round((lon + 180) / 360 * 1000, 6) AS x, round((90 - lat) / 180 * 500, 6) AS y,
       round(greatest(0, least(1, (1 - ln(tan(pi() / 4 + radians(greatest(-85, least(85, lat))) / 2)) / pi()) / 2)) * 500, 6) AS mercator_y, region_id::BIGINT AS region_id, round(sqrt(q), 6) AS degrees
FROM p LEFT JOIN n USING (doc_id)""")
def document_places(spark, sf_dir):
    """The first place that each whole document names, projected, with the nearest region within 25 degrees."""
    known = gazetteer(spark, sf_dir)
    places = known.select("place_id", "lat", "lon", "is_area").distinct()
    first = first_places(named_places(table(spark, sf_dir, "documents"), "doc_id", "text", known))
    at = first.join(places, "place_id")
    near = nearest_regions(places.select(F.col("place_id").alias("point_id"), "lat", "lon"), _regions(spark, sf_dir))
    (x, y), (_, up) = equirectangular(F.col("lat"), F.col("lon"), 1000.0, 500.0), mercator(F.col("lat"), F.col("lon"), 1000.0, 500.0)
    joined = at.join(near, F.col("place_id") == F.col("point_id"), "left")
    return joined.select(F.col("id").alias("doc_id"), "place_id", "is_area", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(up, 6).alias("mercator_y"), "region_id", F.round("degrees", 6).alias("degrees"))


@query()
def place_mentions(spark, sf_dir):
    """How often each place is named, in how many documents, longest names first; tests hold it against a plain reading."""
    named = named_places(table(spark, sf_dir, "documents"), "doc_id", "text", gazetteer(spark, sf_dir))
    return named.groupBy("place_id").agg(F.count("*").alias("mentions"), F.count_distinct("id").alias("documents"))


@query(f"""WITH {PHRASES}, d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents), g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS phrase FROM d)
SELECT label, count(*)::BIGINT AS hits, count(DISTINCT doc_id)::BIGINT AS documents FROM g JOIN taxonomy USING (phrase) GROUP BY 1""")
def phrase_counts(spark, sf_dir):
    """All places of all phrases of the dictionary in whole documents, by class."""
    phrases = topic_phrases(spark, sf_dir).select("label", F.array_join(words(F.col("phrase")), " ").alias("phrase")).distinct().withColumn("phrase_id", F.xxhash64("phrase"))
    hits = phrase_hits(table(spark, sf_dir, "documents"), "doc_id", ["text"], dictionary(phrases, "phrase_id", "phrase"))
    return hits.join(phrases.select("phrase_id", "label"), "phrase_id").groupBy("label").agg(F.count("*").alias("hits"), F.count_distinct("id").alias("documents"))
