"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.evaluation import kappa, ndcg, precision_recall, random_unit, stratified_sample, threshold_at_precision, wilson
from ..registry import query
from ..sources.tables import table

LABELS = "x AS (SELECT l.doc_id, l.quality, l.toxic, d.source, d.lang, d.n_chars, (d.n_chars % 97) / 96.0 AS score FROM labels l JOIN documents d USING (doc_id))"


def _labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("score", (F.col("n_chars") % 97) / 96.0)


@query(f"""WITH {LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS p, row_number() OVER (PARTITION BY lang ORDER BY quality DESC, doc_id) AS q FROM x)
SELECT lang, round(sum((pow(2.0, quality) - 1) / log2(p + 1.0)) FILTER (WHERE p <= 10) / nullif(sum((pow(2.0, quality) - 1) / log2(q + 1.0)) FILTER (WHERE q <= 10), 0), 6) AS ndcg FROM r GROUP BY 1""")
def ndcg10(spark, sf_dir):
    """Q1."""
    return ndcg(_labels(spark, sf_dir), "lang", "score", "quality", "doc_id").select("lang", F.round("ndcg", 6).alias("ndcg"))


@query(f"""WITH {LABELS}, p AS (SELECT lang, quality = 1 AS t, CASE WHEN score < 0.1 THEN NULL ELSE score >= 0.4 END AS y FROM x), g AS (SELECT lang, count(*) FILTER (WHERE t AND y) AS hits, count(*) FILTER (WHERE y) AS said, count(*) FILTER (WHERE t) AS real, count(*) FILTER (WHERE y IS NULL) AS abst FROM p GROUP BY 1)
SELECT lang, hits::BIGINT AS hits, abst::BIGINT AS abstained, round(hits / nullif(said, 0), 6) AS precision, round(hits / nullif(real, 0), 6) AS recall,
 round((hits / said + 3.8414588206941227 / (2 * said) - 1.959963984540054 * sqrt(hits / said * (1 - hits / said) / said + 3.8414588206941227 / (4.0 * said * said))) / (1 + 3.8414588206941227 / said), 6) AS low FROM g""")
def precision_recall_wilson(spark, sf_dir):
    """Q2 Q3: precision and recall with abstention, and the lower bound of precision."""
    x = _labels(spark, sf_dir).select("lang", (F.col("quality") == 1).alias("t"), F.when(F.col("score") < 0.1, None).otherwise(F.col("score") >= 0.4).alias("y"))
    g = precision_recall(x, ["lang"], "t", "y")
    low, _ = wilson(F.col("hits"), F.col("said"))
    return g.select("lang", "hits", "abstained", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(low, 6).alias("low"))


@query(f"""WITH {LABELS}, g AS (SELECT unnest([2, 3, 4, 5, 6]) AS f), h AS (SELECT unnest([1, 2, 3]) AS m) SELECT f::INT AS f, m::INT AS m, (count(*) FILTER (WHERE quality = 1 AND n_chars >= f * 300 AND score >= m / 4.0))::BIGINT AS tp, (count(*) FILTER (WHERE quality = 0 AND n_chars >= f * 300 AND score >= m / 4.0))::BIGINT AS fp, (count(*) FILTER (WHERE quality = 1 AND NOT (n_chars >= f * 300 AND score >= m / 4.0)))::BIGINT AS fn FROM x, g, h GROUP BY 1, 2""")
def floor_confusion(spark, sf_dir):
    """Q4: confusion over a grid of floors; every row meets the fifteen cells in one pass."""
    x = _labels(spark, sf_dir)
    cell = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(m).alias("m")) for f in (2, 3, 4, 5, 6) for m in (1, 2, 3))))
    c = x.select("quality", "n_chars", "score", cell.alias("c")).withColumn("y", (F.col("n_chars") >= F.col("c.f") * 300) & (F.col("score") >= F.col("c.m") / 4.0))
    return c.groupBy(F.col("c.f").alias("f"), F.col("c.m").alias("m")).agg(F.count_if((F.col("quality") == 1) & F.col("y")).alias("tp"), F.count_if((F.col("quality") == 0) & F.col("y")).alias("fp"), F.count_if((F.col("quality") == 1) & ~F.col("y")).alias("fn"))


@query(f"""WITH {LABELS}, p AS (SELECT quality AS a, (score >= 0.2)::INT AS b FROM x), n AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (WHERE a = b)) / count(*)::DOUBLE AS po, (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b))) AS pe FROM p) SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM n""")
def cohen_kappa(spark, sf_dir):
    """Q5."""
    x = _labels(spark, sf_dir).select(F.col("quality").alias("a"), (F.col("score") >= 0.2).cast("int").alias("b"))
    return kappa(x, "a", "b").select(F.round("kappa", 6).alias("kappa"))


@query(f"""WITH {LABELS}, s AS (SELECT score AS s, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS h FROM x GROUP BY 1), r AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS n, sum(h) OVER (ORDER BY s DESC) AS h, sum(h) OVER () AS a FROM s)
SELECT round(s, 6) AS threshold, round(h / n, 6) AS precision, round(h / a, 6) AS recall FROM r WHERE h / n >= 0.8 ORDER BY s LIMIT 1""")
def precision_threshold(spark, sf_dir):
    """The lowest threshold that reaches a precision."""
    x = _labels(spark, sf_dir).select("score", (F.col("quality") == 1).alias("t"))
    return threshold_at_precision(x, "score", "t", 0.8).select(F.round("threshold", 6).alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('s' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 5")
def hash_sample(spark, sf_dir):
    """Q7: a sampling operator: five rows of each language by a hash."""
    return stratified_sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 5, "s").select("lang", "doc_id")


UNIT = "(('0x' || left(sha256('{}|' || c_custkey || '|' || k), 13))::BIGINT / 4503599627370496.0)"


@query(f"""WITH r AS (SELECT c_custkey, k, c_custkey % 50 AS m FROM customer, range(0, 12) t(k)) SELECT c_custkey AS event, k::INT AS k, floor({UNIT.format("fixture")} * 20)::BIGINT AS publisher, floor({UNIT.format("time")} * CASE WHEN m < 20 THEN 3600 WHEN m < 35 THEN 86400 ELSE 1800 END)::BIGINT AS at_,
       CASE WHEN m < 20 THEN 'breaking' WHEN m < 35 THEN 'weekend' ELSE 'syndication' END AS scenario FROM r""")
def synthetic_reports(spark, sf_dir):
    """Q8: twelve reproducible reports for each customer as an event, from hashes, in three scenarios."""
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event"), (F.col("c_custkey") % 50).alias("m"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    burst = F.when(F.col("m") < 20, 3600).when(F.col("m") < 35, 86_400).otherwise(1800)
    u = random_unit("fixture", F.col("event"), F.col("k"))
    return r.select("event", "k", F.floor(u * 20).alias("publisher"), F.floor(random_unit("time", F.col("event"), F.col("k")) * burst).alias("at_"), F.when(F.col("m") < 20, "breaking").when(F.col("m") < 35, "weekend").otherwise("syndication").alias("scenario"))


@query("SELECT user_id, round((count(*) FILTER (WHERE event_type = 'purchase')) / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 6) AS discovery, round((count(*) FILTER (WHERE event_type = 'view')) / count(*), 6) AS exposure FROM events GROUP BY 1")
def exposure_rates(spark, sf_dir):
    """Q10."""
    n = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(n("purchase") / F.nullif(n("view"), F.lit(0)), 6).alias("discovery"), F.round(n("view") / F.count("*"), 6).alias("exposure"))
