"""Ranking, selection, personalization and notification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ranking import briefing, discovery_slots, diversity, editorial_score, importance, lanes, limited, mmr, profiles, salience
from ..operators.windows import first_rows, top_quartile
from ..registry import query
from ..sources.tables import articles, table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("key"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query()
def mmr_rerank(spark, sf_dir):
    """Ten picks of each label's vectors."""
    v = _vectors(spark, sf_dir)
    return mmr(v.select("key", "id", F.round(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0, 6).alias("relevance"), "vector", (F.col("id") * 60).cast("double").alias("at")), "key")


@query("""SELECT a.label::BIGINT AS key, round(avg(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS diversity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def semantic_diversity(spark, sf_dir):
    """R2: mean distance of all pairs of a label, in one pass without making pairs."""
    return diversity(_vectors(spark, sf_dir), "key", "id", "vector").select("key", F.round("diversity", 5).alias("diversity"))


@query()
def briefing_greedy(spark, sf_dir):
    """Ten stories per reader group."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"), (F.col("o_custkey") % 20).alias("source"), (F.col("o_orderkey") % 400).alias("event"), (F.col("o_orderkey") % 9).alias("sources"), (F.col("o_custkey") % 5).alias("interest"), F.unix_timestamp("o_orderdate").alias("at"))
    return briefing(o, "key")


SCORED = """s AS (SELECT o_orderkey AS id, o_custkey % 4 AS edition, o_orderkey % 9 AS originals, CASE WHEN o_orderkey % 7 >= 5 THEN 'major' WHEN o_orderkey % 7 >= 2 THEN 'notable' ELSE 'minor' END AS level, o_orderkey % 3 = 0 AS sector, (o_orderkey % 11) / 10.0 AS sal, o_orderkey % 5 = 0 AS rising, o_orderkey % 4 = 0 AS dev, o_orderkey % 13 = 0 AS promo FROM orders),
e AS (SELECT *, least(1.0, greatest(0.0, 0.42 * least(1.0, log2(greatest(1, originals)) / log2(6)) + CASE level WHEN 'major' THEN 0.28 WHEN 'notable' THEN 0.16 ELSE 0.04 END + CASE WHEN sector AND level <> 'major' THEN 0.05 ELSE 0 END + 0.2 * sal + CASE WHEN rising AND dev THEN 0.1 WHEN rising OR dev THEN 0.07 ELSE 0 END)) AS raw FROM s),
f AS (SELECT id, edition, round(CASE WHEN promo THEN least(raw, 0.25) ELSE raw END, 6) AS score FROM e)"""


def _scored(spark, sf_dir):
    k = F.col("o_orderkey")
    level = F.when(k % 7 >= 5, "major").when(k % 7 >= 2, "notable").otherwise("minor")
    score = editorial_score(k % 9, level, k % 3 == 0, (k % 11) / 10.0, k % 5 == 0, k % 4 == 0, k % 13 == 0)
    return table(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") % 4).alias("edition"), F.round(score, 6).alias("score"))


@query(f"WITH {SCORED} SELECT id, edition, score FROM f")
def editorial_scores(spark, sf_dir):
    """R4b."""
    return _scored(spark, sf_dir)


@query("""WITH p AS (SELECT l_orderkey AS id, count(DISTINCT l_suppkey) AS c, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_suppkey END) AS o, max(l_quantity) AS q, bool_or(l_tax > 0.07) AS sector, bool_or(l_linestatus = 'O') AS moving FROM lineitem GROUP BY 1),
s AS (SELECT id, c, CASE WHEN c >= 8 THEN 3 WHEN c >= 5 THEN 2 WHEN c >= 3 THEN 1 ELSE 0 END + CASE WHEN o >= 5 THEN 1 ELSE 0 END + CASE WHEN q >= 48 THEN 2 WHEN q >= 40 THEN 1 ELSE 0 END + (q >= 49)::INT + sector::INT + moving::INT AS points FROM p)
SELECT id, CASE WHEN points >= 4 THEN 'major' WHEN points >= 2 OR c >= 2 THEN 'notable' ELSE 'minor' END AS level FROM s""")
def importance_levels(spark, sf_dir):
    """R4c."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count_distinct("l_suppkey").alias("c"), F.count_distinct(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey"))).alias("o"), F.max("l_quantity").alias("q"), F.bool_or(F.col("l_tax") > 0.07).alias("sector"), F.bool_or(F.col("l_linestatus") == "O").alias("moving"))
    q = F.col("q")
    return g.select("id", importance(F.col("c"), F.col("o"), q >= 48, q >= 40, q >= 49, F.col("sector"), F.col("moving")).alias("level"))


@query()
def lane_assignment(spark, sf_dir):
    """R4 R4d: the lane of every story of four editions; every story has one."""
    s, k = _scored(spark, sf_dir), F.col("id")
    s = s.select("edition", "id", "score", (F.col("score") >= 0.6).alias("lead_ok"), (k % 3 == 0).alias("motion_ok"), (F.col("score") * 0.9).alias("motion"), (k % 5 == 0).alias("deep_ok"), F.col("score").alias("deep"), (k % 2 == 0).alias("beat_ok"), F.col("score").alias("beat"), (k % 7 == 0).alias("outside_ok"), (1 - F.col("score")).alias("outside"))
    return lanes(s)


@query("SELECT conv_id, count(*)::BIGINT AS n, sum(length(text) - length(replace(text, ' ', '')) + 1)::BIGINT AS words, ceil(sum(length(text) - length(replace(text, ' ', '')) + 1) / 200.0)::BIGINT AS minutes, CASE WHEN bool_or(contains(lower(text), 'review')) THEN 'review' WHEN bool_or(contains(text, '?')) THEN 'question' ELSE 'report' END AS kind FROM conversations GROUP BY 1")
def content_types(spark, sf_dir):
    """R4f: kind of content and minutes to read at 200 words a minute."""
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(words).alias("words"), F.bool_or(F.lower("text").contains("review")).alias("r"), F.bool_or(F.col("text").contains("?")).alias("q"))
    return g.select("conv_id", "n", "words", F.ceil(F.col("words") / 200.0).alias("minutes"), F.when(F.col("r"), "review").when(F.col("q"), "question").otherwise("report").alias("kind"))


@query("""WITH s AS (SELECT o_orderkey AS id, (o_orderkey % 5)::INT AS reports, o_orderkey % 101 / 100.0 AS score, o_orderkey % 2 = 0 AS updated, o_orderkey % 3 > 0 AS moving, o_orderkey % 11 / 10.0 AS grouping_, o_orderkey % 4 AS publishers, CASE WHEN o_orderkey % 6 = 0 THEN 0.85 WHEN o_orderkey % 6 = 1 THEN 0.72 END AS kind, o_orderkey % 15 AS minutes, o_orderkey % 9 = 0 AS starred, o_orderkey % 8 = 0 AS affinity, o_orderkey % 21 / 20.0 AS match_ FROM orders)
SELECT id, round(least(1, 0.3 + least(1, reports / 3.0) * 0.45 + score * 0.25), 6)::DOUBLE AS lead, (CASE WHEN NOT (updated AND moving) THEN 0.30 WHEN grouping_ >= 0.7 OR publishers >= 3 THEN 0.88 ELSE 0.75 END)::DOUBLE AS in_motion,
       greatest(coalesce(kind, 0), CASE WHEN minutes >= 12 THEN 0.88 WHEN minutes >= 8 THEN 0.75 ELSE 0 END)::DOUBLE AS deep_read, round(greatest(CASE WHEN starred THEN 0.9 ELSE 0 END, CASE WHEN affinity THEN 0.78 ELSE 0 END, CASE WHEN match_ >= 0.5 THEN least(0.95, 0.55 + match_ * 0.4) ELSE 0 END), 6)::DOUBLE AS your_beat,
       round(CASE WHEN 1 - match_ < 0.6 OR score < 0.35 THEN 0.25 ELSE least(0.92, 0.45 + (1 - match_) * 0.3 + score * 0.2) END, 6)::DOUBLE AS outside FROM s""")
def lane_confidences(spark, sf_dir):
    """R4d: how sure each lane is of each order as a story."""
    from ..operators import editions as e

    k = F.col("o_orderkey")
    match, score = k % 21 / 20.0, k % 101 / 100.0
    made = {
        "lead": e.lead_confidence(k % 5, score), "in_motion": e.in_motion_confidence(k % 2 == 0, k % 3 > 0, k % 11 / 10.0, k % 4),
        "deep_read": e.deep_read_confidence(F.when(k % 6 == 0, 0.85).when(k % 6 == 1, 0.72), k % 15), "your_beat": e.your_beat_confidence(k % 9 == 0, k % 8 == 0, match), "outside": e.outside_confidence((20 - k % 21) / 20.0, score),
    }
    return table(spark, sf_dir, "orders").select(k.alias("id"), *(F.round(c, 6).alias(n) for n, c in made.items()))


@query("""WITH d AS (SELECT doc_id, (doc_id % 13)::INT AS k, length(text) - length(replace(text, ' ', '')) AS spaces FROM documents)
SELECT doc_id, CASE WHEN k IN (0, 1, 2) THEN 'investigation' WHEN k IN (3, 4, 5) THEN 'explainer' WHEN k IN (6, 7, 8, 9) THEN 'opinion' END AS kind, CASE WHEN k IN (0, 1, 2) THEN 0.85 WHEN k IN (3, 4, 5) THEN 0.8 WHEN k IN (6, 7, 8) THEN 0.85 WHEN k = 9 THEN 0.72 END::DOUBLE AS confidence FROM d""")
def content_kinds(spark, sf_dir):
    """R4f: kinds of documents whose headline, summary, section or address tells it in a way given by their number. The SQL tells it by that number."""
    from ..operators.editions import content_kind

    d = articles(spark, sf_dir).select("id", F.regexp_replace("title", r"[^\p{L} ]", "").alias("title"))
    k = F.col("id") % 13
    pick = lambda *cases, other="": F.coalesce(*(F.when(k == n, c if not isinstance(c, str) else F.lit(c)) for n, c in cases), F.lit(other) if isinstance(other, str) else other)
    title = pick((0, F.concat(F.lit("Investigation: "), "title")), (1, F.concat("title", F.lit(" - a deep-dive"))), (4, "How does it work?"), (6, F.concat(F.lit("My view: "), "title")), (10, "How it worked"), (11, "Police launch investigation"), other=F.col("title"))
    summary = pick((3, "What you need to know"), (9, "A columnist writes"), (12, "An opinionated guide"))
    return d.select(F.col("id").alias("doc_id"), content_kind(title, summary, pick((7, "World Opinion")), pick((2, "https://x.example/special-report/1"), (5, "https://x.example/Explainers/1"), (8, "https://x.example/commentisfree/1"))).alias("c")).select("doc_id", "c.kind", "c.confidence")


INTEREST = "i AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('view', 'purchase')), w AS (SELECT user_id, event_id % 12 AS category, sum(CASE event_type WHEN 'purchase' THEN 3 ELSE 1 END) AS weight FROM i WHERE rn <= 200 GROUP BY 1, 2)"


def _interests(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'purchase')").select("user_id", "event_id", "event_type", "ts")
    last = first_rows(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 200)
    return last.groupBy("user_id", (F.col("event_id") % 12).alias("category")).agg(F.sum(F.when(F.col("event_type") == "purchase", 3).otherwise(1)).alias("weight"))


@query(f"WITH {INTEREST} SELECT user_id, category, weight::BIGINT AS weight FROM w")
def interest_weights_200(spark, sf_dir):
    """Weights from the latest two hundred interactions."""
    return _interests(spark, sf_dir)


@query(f"WITH {INTEREST}, m AS (SELECT *, max(weight) OVER (PARTITION BY user_id) AS top, sum(weight) OVER (PARTITION BY user_id) AS total FROM w) SELECT user_id, category, round(0.75 * weight / top + 0.15 * weight / top + least(0.18, 0.45 * weight / total), 6) AS match FROM m")
def interest_match(spark, sf_dir):
    """Match of a category: the larger and smaller signal and the category's share."""
    from pyspark.sql import Window

    w, user = _interests(spark, sf_dir), Window.partitionBy("user_id")
    signal = F.col("weight") / F.max("weight").over(user)
    return w.select("user_id", "category", F.round(0.75 * signal + 0.15 * signal + F.least(F.lit(0.18), 0.45 * F.col("weight") / F.sum("weight").over(user)), 6).alias("match"))


@query("""WITH p AS (SELECT l_suppkey AS publisher, count(DISTINCT l_orderkey) AS published, count(*) FILTER (WHERE l_returnflag = 'R') AS engaged FROM lineitem GROUP BY 1), a AS (SELECT publisher, engaged / greatest(published, 5)::DOUBLE AS affinity FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY round(affinity, 9) DESC, publisher) AS rn, count(*) OVER () AS n FROM a) SELECT publisher, round(affinity, 6) AS affinity FROM r WHERE rn <= greatest(1, ceil(0.25 * n))""")
def per_story_affinity(spark, sf_dir):
    """Engagement per story published, with a floor; the top quarter. One row per publisher is ranked."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("publisher")).agg(F.count_distinct("l_orderkey").alias("published"), F.count_if(F.col("l_returnflag") == "R").alias("engaged"))
    a = g.select("publisher", F.round(F.col("engaged") / F.greatest("published", F.lit(5)), 9).alias("affinity"), F.lit(0).alias("all"))
    return top_quartile(a, ["all"], "affinity", "publisher").select("publisher", F.round("affinity", 6).alias("affinity"))


@query("SELECT user_id, ((3 * count(*) + user_id % 20) // 20)::BIGINT AS slots, ((3 * count(*) + user_id % 20) % 20)::BIGINT AS carried FROM events WHERE event_type = 'view' GROUP BY 1")
def discovery_allocation(spark, sf_dir):
    """R8."""
    g = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n"))
    slots, carried = discovery_slots(F.col("n"), F.col("user_id") % 20)
    return g.select("user_id", slots.alias("slots"), carried.alias("carried"))


@query("SELECT event_id, round(least(1.0, 0.25 * abs(value / 100) + 0.3 * least((event_id % 9) / 6.0, 1.0) + 0.3 * least((event_id % 5) / 3.0, 1.0) + 0.15), 6) AS salience FROM events")
def salience_scores(spark, sf_dir):
    """Salience; the sentiment is a given column."""
    return table(spark, sf_dir, "events").select("event_id", F.round(salience(F.col("value") / 100, F.col("event_id") % 9, F.col("event_id") % 5), 6).alias("salience"))


@query()
def priority_overflow(spark, sf_dir):
    """R9 ST4: notices that pass five an hour and three in half an hour."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select((F.col("user_id") % 10).alias("reader"), F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return limited(e, ["reader"], "at", ((5, 3600), (3, 1800)))


@query()
def embedding_profile_decay(spark, sf_dir):
    """Decayed unit profiles of readers."""
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'purchase', 'error')")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))
    n = F.lit((v.agg(F.max("vec_id")).first()[0] or 0) + 1)  # every vector stands for as many events
    a = e.select("user_id", (F.col("event_id") % n).alias("id"), F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "purchase", "save").otherwise("skip").alias("action"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return profiles(a.join(v, F.col("id") == F.col("vec_id")).drop("vec_id"))


@query("SELECT l_orderkey AS event, arg_max(l_linenumber, (l_discount * 10 + l_tax, l_quantity, -l_linenumber))::INT AS image FROM lineitem GROUP BY 1")
def best_image(spark, sf_dir):
    """Overlap times ten plus origin, then the larger width."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(F.max_by("l_linenumber", F.struct(F.col("l_discount") * 10 + F.col("l_tax"), "l_quantity", -F.col("l_linenumber"))).alias("image"))


@query("SELECT s_suppkey, alt.s_suppkey AS alternative FROM (SELECT * FROM supplier WHERE s_acctbal < 0) s LEFT JOIN (SELECT s_nationkey AS nk, min(s_suppkey) AS s_suppkey FROM supplier WHERE s_acctbal >= 0 GROUP BY 1) alt ON alt.nk = s.s_nationkey".replace("SELECT s_suppkey,", "SELECT s.s_suppkey,"))
def catalog_gaps(spark, sf_dir):
    """Feeds gone, and an alternative from the same place."""
    s = table(spark, sf_dir, "supplier")
    alt = s.where("s_acctbal >= 0").groupBy(F.col("s_nationkey").alias("nk")).agg(F.min("s_suppkey").alias("alternative"))
    return s.where("s_acctbal < 0").join(alt, F.col("s_nationkey") == F.col("nk"), "left").select("s_suppkey", "alternative")


@query()
def extractive_summary(spark, sf_dir):
    """Two sentences of each document by position, overlap with the title and length."""
    from ..functions.text import sentences, words

    d = table(spark, sf_dir, "documents").select("doc_id", words(F.regexp_extract("text", r"^[^.!?\n]*", 0)).alias("title"), F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    w = words(F.col("sentence"))
    score = 1.0 / (1 + F.col("pos")) + F.size(F.array_intersect(w, "title")) / F.greatest(F.size("title"), F.lit(1)) + F.least(F.size(w) / 30.0, F.lit(1.0))
    return first_rows(d.select("doc_id", "pos", "sentence", score.alias("score")), ["doc_id"], [F.desc("score"), F.asc("pos")], 2).select("doc_id", "pos", "sentence")


@query()
def passage_alignment(spark, sf_dir):
    """Each turn's best counterpart in the same conversation, with consensus from 0.82 and divergence below 0.40."""
    from ..functions.text import cosine_of_sets, words

    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_distinct(words(F.col("text"))).alias("w")).where("turn < 40")  # a comparison takes forty passages
    a, b = t.alias("a"), t.alias("b")
    p = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.role") != F.col("b.role")))
    g = p.groupBy(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn")).agg(F.max(F.struct(F.round(F.coalesce(cosine_of_sets(F.col("a.w"), F.col("b.w")), F.lit(0.0)), 6).alias("s"), (-F.col("b.turn")).alias("t"))).alias("best"))
    return g.select("conv_id", "turn", (-F.col("best.t")).alias("other"), F.col("best.s").alias("similarity"), F.when(F.col("best.s") >= 0.82, "consensus").when(F.col("best.s") < 0.40, "divergence").otherwise("partial").alias("kind"))
