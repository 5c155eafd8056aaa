"""Search queries: the two arms, their fusion, pages, snippets, passages, spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators.index import Term, index_of, matches, ranked_matches
from ..operators.search import fuse, nearest, ranked, snippet
from ..operators.spelling import corrections
from ..registry import query
from ..sources.tables import table

TERMS = ["license", "the"]
WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
LEXICAL = f"""t AS (SELECT doc_id AS id, {WORDS} AS w FROM documents),
c AS (SELECT id, len(w) AS length, len(list_filter(w, lambda x: x = 'license')) AS tf0, len(list_filter(w, lambda x: x = 'the')) AS tf1 FROM t),
k AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (WHERE tf0 > 0) AS df0, count(*) FILTER (WHERE tf1 > 0) AS df1 FROM c),
lexical AS (SELECT id, ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * length / mean)) + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * length / mean)) AS score FROM c, k WHERE tf0 > 0 AND tf1 > 0)"""
SEMANTIC = """q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7),
semantic AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, q WHERE list_dot_product(embedding::DOUBLE[], v) >= 0.35)"""
FUSED = f"""{LEXICAL}, {SEMANTIC},
arms AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM lexical UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM semantic),
top AS (SELECT * FROM arms WHERE rank <= 500), fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM top GROUP BY 1)"""


def documents_index(spark, sf_dir):
    """The stored index of the documents; the first query of an application builds it."""
    return index_of(table(spark, sf_dir, "documents"), "doc_id", ["text"])


def _lexical(spark, sf_dir):
    return ranked_matches(documents_index(spark, sf_dir), [Term(t) for t in TERMS])


def _semantic(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    row = vectors.where("vec_id = 7").select("embedding").first()
    return nearest(vectors, "vec_id", "embedding", row[0] if row else [])


@query(f"WITH {LEXICAL} SELECT id, round(score, 6) AS score FROM lexical ORDER BY lexical.score DESC, id LIMIT 100")
def lexical_topk(spark, sf_dir):
    """BM25 over documents that hold all terms."""
    return _lexical(spark, sf_dir).orderBy(F.desc("score"), "id").limit(100).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {SEMANTIC} SELECT id, round(score, 6) AS score FROM semantic ORDER BY semantic.score DESC, id LIMIT 100")
def semantic_topk(spark, sf_dir):
    """Cosine at or above 0.35."""
    return _semantic(spark, sf_dir).orderBy(F.desc("score"), "id").limit(100).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {FUSED} SELECT id, round(score, 9) AS score FROM fused ORDER BY fused.score DESC, id LIMIT 50")
def rrf_fusion(spark, sf_dir):
    """Reciprocal-rank fusion of both arms."""
    f = fuse([_lexical(spark, sf_dir), _semantic(spark, sf_dir)], 500)
    return f.orderBy(F.desc("score"), "id").limit(50).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {FUSED}, p AS (SELECT id, round(score, 9) AS score FROM fused) SELECT id, score FROM p WHERE score < round(1.0::DOUBLE / 70, 9) OR (score = round(1.0::DOUBLE / 70, 9) AND id > 100) ORDER BY score DESC, id LIMIT 25")
def rrf_cursor_page(spark, sf_dir):
    """The page of the fused list after a cursor."""
    from ..operators.filters import page_after

    f = fuse([_lexical(spark, sf_dir), _semantic(spark, sf_dir)], 500).select("id", F.round("score", 9).alias("score"))
    return page_after(f, "score", "id", (round(1.0 / 70, 9), 100), 25)


@query(f"WITH {LEXICAL} SELECT id, row_number() OVER (ORDER BY score DESC, id)::BIGINT AS rank FROM lexical")
def lexical_ranks(spark, sf_dir):
    """Ranks of a whole arm without gathering it in one task."""
    return ranked(_lexical(spark, sf_dir)).select("id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH t AS (SELECT doc_id AS id, unnest({WORDS}) AS term FROM documents) SELECT term, count(DISTINCT id)::BIGINT AS df, count(*)::BIGINT AS cf FROM t GROUP BY 1 HAVING count(DISTINCT id) >= 10""")
def index_terms(spark, sf_dir):
    """The inverted index's document and corpus frequencies."""
    return documents_index(spark, sf_dir).vocabulary.where("df >= 10").select("term", "df", "cf")


@query()
def stem_forms(spark, sf_dir):
    """The words of the documents by stem, with how many words and occurrences each stem gathers."""
    v = documents_index(spark, sf_dir).vocabulary
    return v.groupBy("stem").agg(F.count("*").alias("forms"), F.sum("cf").alias("cf"), F.min("term").alias("first")).where("forms > 1")


@query(f"""WITH t AS (SELECT doc_id AS id, {WORDS} AS w FROM documents),
c AS (SELECT id, len(w) AS length, len(list_filter(w, lambda x: regexp_full_match(x, 'licens(e|es|ed|ing|er|ers|able|or|ors)?'))) AS tf, len(list_filter(w, lambda x: regexp_full_match(x, 'reserv(e|es|ed|ing|er|ers|able|ation|ations|ative)?'))) AS tg FROM t),
k AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (WHERE tf > 0) AS df, count(*) FILTER (WHERE tg > 0) AS dg FROM c)
SELECT id, round(coalesce(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 0) + coalesce(ln(1 + (n - dg + 0.5) / (dg + 0.5)) * tg * 2.2 / (tg + 1.2 * (0.25 + 0.75 * length / mean)), 0), 6) AS score FROM c, k WHERE tf > 0 OR tg > 0""")
def stemmed_search(spark, sf_dir):
    """Documents that hold any form of "licensed" or "reserves", ranked over stems. The SQL spells the forms out."""
    return ranked_matches(documents_index(spark, sf_dir), [Term("licensed", stemmed=True), Term("reserves", stemmed=True)], match_all=False).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH t AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), c AS (SELECT id, len(w) AS length, len(list_filter(range(1, len(w)), lambda i: regexp_full_match(w[i], 'right|rights') AND regexp_full_match(w[i + 1], 'reserv(e|es|ed|ing)?'))) AS tf FROM t), k AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (WHERE tf > 0) AS df FROM c)
SELECT id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score FROM c, k WHERE tf > 0""")
def stemmed_phrase(spark, sf_dir):
    """A phrase whose words answer by their stems."""
    return ranked_matches(documents_index(spark, sf_dir), [Term("right reserve", stemmed=True)]).select("id", F.round("score", 6).alias("score"))


BM25 = """ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))"""


@query(f"""WITH t AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), c AS (SELECT id, len(w) AS length, len(list_filter(w, lambda x: starts_with(x, 'licen'))) AS tf FROM t), k AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (WHERE tf > 0) AS df FROM c)
SELECT id, round({BM25}, 6) AS score FROM c, k WHERE tf > 0""")
def prefix_search(spark, sf_dir):
    """Words that begin with a prefix."""
    return ranked_matches(documents_index(spark, sf_dir), [Term("licen", prefix=True)]).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH t AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), c AS (SELECT id, len(w) AS length, len(list_filter(range(1, len(w) - 1), lambda i: w[i] = 'under' AND w[i + 1] = 'the' AND w[i + 2] = 'mit')) AS tf FROM t), k AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (WHERE tf > 0) AS df FROM c)
SELECT id, round({BM25}, 6) AS score FROM c, k WHERE tf > 0""")
def phrase_search(spark, sf_dir):
    """Words that follow each other."""
    return ranked_matches(documents_index(spark, sf_dir), [Term("under the MIT")]).select("id", F.round("score", 6).alias("score"))


@query(r"""WITH t AS (SELECT page_id AS id, list_filter(string_split_regex(lower(url), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS u, list_filter(string_split_regex(lower(html), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS h FROM pages),
c AS (SELECT id, len(u) + len(h) AS length, len(list_filter(u, lambda x: x = 'utm')) AS tf, len(list_filter(h, lambda x: starts_with(x, 'nav'))) + len(list_filter(u, lambda x: starts_with(x, 'nav'))) AS tg FROM t), k AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (WHERE tf > 0) AS df, count(*) FILTER (WHERE tg > 0) AS dg FROM c)
SELECT id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) + ln(1 + (n - dg + 0.5) / (dg + 0.5)) * tg * 2.2 / (tg + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score FROM c, k WHERE tf > 0 AND tg > 0""".replace("\\\\", "\\"))
def field_search(spark, sf_dir):
    """A word of one field and a prefix in any of two."""
    i = index_of(table(spark, sf_dir, "pages"), "page_id", ["url", "html"])
    return ranked_matches(i, [Term("utm", field="url"), Term("nav", prefix=True)]).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, {WORDS} AS w FROM conversations), c AS (SELECT id, len(w) AS length, len(list_filter(w, lambda x: starts_with(x, 'th'))) AS tf, len(list_filter(w, lambda x: starts_with(x, 'an'))) AS tg FROM t), k AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (WHERE tf > 0) AS df, count(*) FILTER (WHERE tg > 0) AS dg FROM c)
SELECT id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) + ln(1 + (n - dg + 0.5) / (dg + 0.5)) * tg * 2.2 / (tg + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score FROM c, k WHERE tf > 0 AND tg > 0 ORDER BY score DESC, id LIMIT 200""")
def note_search(spark, sf_dir):
    """Notes (turns) that hold words beginning with each of the given ones, best first."""
    notes = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    i = index_of(notes, "id", ["text"])
    return ranked_matches(i, [Term("th", prefix=True), Term("an", prefix=True)]).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(200)


@query()
def snippets(spark, sf_dir):
    """Fifteen words around the first match. The index names the documents; other texts are not cut to words."""
    held = documents_index(spark, sf_dir).postings.where("stem = 'licens' AND term = 'license'").select("id")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return snippet(d.join(held, d.doc_id == held.id, "left_semi"), "doc_id", "text", "license")


@query(f"""WITH t AS (SELECT doc_id AS id, source, {WORDS} AS w FROM documents) SELECT source, count(*)::BIGINT AS n FROM t WHERE list_contains(w, 'license') GROUP BY 1""")
def search_counts(spark, sf_dir):
    """Counts under the search predicate."""
    held = matches(documents_index(spark, sf_dir), [Term("license")]).where("_kept").select("id")
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(held, d.doc_id == held.id, "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query(f"""WITH h AS (SELECT doc_id, source, list_distinct(list_filter(list_slice({WORDS}, 1, 24), lambda x: length(x) >= 9)) AS keys FROM documents), e AS (SELECT doc_id, source, unnest(keys) AS k FROM h)
SELECT a.doc_id AS a, b.doc_id AS b, count(*)::BIGINT AS shared FROM e a JOIN e b ON a.k = b.k AND a.doc_id < b.doc_id AND b.doc_id - a.doc_id <= 2880 GROUP BY 1, 2 HAVING count(*) >= 3""")
def blocking_candidates(spark, sf_dir):
    """Documents within 48 hours of each other that share three or more long headline words.

    The join is on word and two-day bucket, so a frequent word pairs only what is near in time.
    """
    d = table(spark, sf_dir, "documents")
    keys = F.array_distinct(F.filter(F.slice(words(F.col("text")), 1, 24), lambda x: F.length(x) >= 9))
    e = d.select("doc_id", F.explode(keys).alias("k"), F.expr("doc_id div 2880").alias("bucket"))  # a document a minute
    a = e.select(F.col("doc_id").alias("a"), "k", F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    b = e.select(F.col("doc_id").alias("b"), "k", "bucket")
    pairs = a.join(b, ["k", "bucket"]).where("a < b AND b - a <= 2880")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where("shared >= 3")


TERM_WORDS = r"list_filter(string_split_regex(regexp_extract(text, '^[^.!?\n]*'), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 4 AND regexp_matches(w, '\p{L}'))"


@query(rf"""WITH d AS (SELECT doc_id AS id, doc_id * 600 AS at_, CASE WHEN doc_id % 9 > 0 THEN lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN doc_id * 600 - (doc_id % 7) * 90000 END AS active, {WORDS} AS w, {TERM_WORDS} AS h FROM documents),
u AS (SELECT *, list_transform(list_concat(list_filter(h, lambda x: regexp_matches(x, '^\p{{Lu}}')), list_filter(h, lambda x: NOT regexp_matches(x, '^\p{{Lu}}'))), lambda x: lower(x)) AS t FROM d),
p AS (SELECT id, at_, lang, unnest(list_filter(t, lambda x, i: list_position(t, x) = i)[1:8]) AS term FROM u), k AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
o AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM p) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM o GROUP BY 1),
m AS (SELECT p.id AS a, d.id AS b, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.w) / mean)) AS part FROM p JOIN o USING (term) JOIN f USING (term) JOIN d ON d.id = o.id CROSS JOIN k WHERE p.id <> d.id AND abs(p.at_ - d.at_) <= 172800 AND coalesce(p.lang = d.lang, true) AND coalesce(d.active >= p.at_ - 259200, true)),
s AS (SELECT a, b, round(sum(part), 6) AS score FROM m GROUP BY 1, 2) SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INT AS place, score FROM s QUALIFY place <= 40""")
def event_candidates(spark, sf_dir):
    """Up to forty reports that each is compared with, by its headline's terms, within two days, in its language, of events that are open."""
    from ..operators.shortlist import headline_terms, shortlists

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 600).alias("at"), F.when(F.col("doc_id") % 9 > 0, F.col("lang")).alias("lang"), "text", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 600 - F.col("doc_id") % 7 * 90_000).alias("active"))
    probes = d.select("id", "at", "lang", headline_terms(F.regexp_extract("text", r"^[^.!?\n]*", 0)).alias("terms"))
    return shortlists(probes, d)


@query(f"""WITH t AS (SELECT conv_id, turn, text, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM conversations)
SELECT a.conv_id, a.turn, max(b.turn) AS earlier FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn AND len(list_intersect(a.w, b.w)) >= 3 GROUP BY 1, 2""".replace("\\\\", "\\"))
def earlier_passages(spark, sf_dir):
    """For each turn, the latest earlier passage of its conversation with three shared terms."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(words(F.col("text"))).alias("w"))
    a, b = t.alias("a"), t.alias("b")
    near = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") < F.col("a.turn")) & (F.size(F.array_intersect("a.w", "b.w")) >= 3))
    return near.groupBy(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn")).agg(F.max("b.turn").alias("earlier"))


@query()
def spelling_correction(spark, sf_dir):
    """The likeliest word for each misspelled term."""
    vocabulary = documents_index(spark, sf_dir).vocabulary.select(F.col("term").alias("word"), F.col("cf").alias("n"))
    return corrections(spark, ["lisence", "reserevd", "relaesed", "publik", "xqzzy"], vocabulary)
