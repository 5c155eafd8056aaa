"""Graph queries: parts are entities, orders are stories, suppliers are publishers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators.graph import capped_mentions, components, edges, pagerank, personalized, related
from ..operators.storage import checkpointed
from ..operators.windows import first_rows
from ..registry import query
from ..sources.tables import table

MENTIONS = """mentions AS (SELECT DISTINCT l_orderkey AS story, p_brand AS entity, l_suppkey % 50 AS publisher, date_diff('day', l_shipdate::DATE, DATE '2001-12-31') AS age FROM lineitem JOIN part ON p_partkey = l_partkey),
w AS (SELECT *, CASE WHEN age < 2 THEN 1.0::DOUBLE WHEN age < 7 THEN 0.7 WHEN age < 14 THEN 0.4 WHEN age < 30 THEN 0.2 ELSE 0.1 END AS w FROM mentions),
per AS (SELECT x.entity AS a, y.entity AS b, x.publisher, max(x.w) AS w, count(*) AS n FROM (SELECT DISTINCT story, entity, publisher, w FROM w) x JOIN (SELECT DISTINCT story, entity, publisher FROM mentions) y ON x.story = y.story AND x.publisher = y.publisher AND y.entity > x.entity GROUP BY 1, 2, 3),
once AS (SELECT a, b, sum(w) AS weight, sum(n) AS evidence FROM per GROUP BY 1, 2 HAVING sum(n) >= 2), edges AS (SELECT * FROM once UNION ALL SELECT b, a, weight, evidence FROM once)"""


def _mentions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    age = F.date_diff(F.lit("2001-12-31").cast("date"), F.to_date("l_shipdate"))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("story"), F.col("p_brand").alias("entity"), (F.col("l_suppkey") % 50).alias("publisher"), age.alias("age_days")).distinct()


def _edges(spark, sf_dir):
    return edges(_mentions(spark, sf_dir))


@query(f"WITH {MENTIONS} SELECT a, b, round(weight, 6) AS weight, evidence::BIGINT AS evidence FROM edges")
def entity_edges(spark, sf_dir):
    """N3 A8 J6."""
    return _edges(spark, sf_dir).select("a", "b", F.round("weight", 6).alias("weight"), "evidence")


@query(f"""WITH RECURSIVE {MENTIONS}, sh AS MATERIALIZED (SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS share FROM edges), nodes AS MATERIALIZED (SELECT DISTINCT a AS node FROM edges), n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes),
r AS (SELECT 0 AS k, node, 1.0 / n AS rank FROM nodes, n UNION ALL SELECT k + 1, node, rank FROM (SELECT r.k, sh.b AS node, 0.15 / any_value(n.n) + 0.85 * sum(r.rank * sh.share) AS rank FROM r JOIN sh ON sh.a = r.node, n WHERE r.k < 30 GROUP BY r.k, sh.b))
SELECT node, round(rank, 6) AS rank FROM r WHERE k = 30""")
def entity_pagerank(spark, sf_dir):
    """Thirty rounds; every node of these edges has an edge out, so no mass is lost."""
    return pagerank(checkpointed(_edges(spark, sf_dir))).select("node", F.round("rank", 6).alias("rank"))


@query()
def entity_ppr_related(spark, sf_dir):
    """Entities related to the most mentioned one."""
    e = checkpointed(_edges(spark, sf_dir))
    seed = e.groupBy("a").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "a").first()
    if seed is None:
        return spark.createDataFrame([], "node string, score double")
    central = pagerank(e)
    return related(personalized(e, seed[0]), central, seed[0], central.count()).select("node", F.round("score", 6).alias("score"))


@query("SELECT l_partkey AS entity, count(DISTINCT l_orderkey)::BIGINT AS stories FROM lineitem GROUP BY 1 ORDER BY stories DESC, entity LIMIT 20")
def entity_top(spark, sf_dir):
    """N8."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(F.count_distinct("l_orderkey").alias("stories")).orderBy(F.desc("stories"), "entity").limit(20)


@query("""WITH c AS (SELECT p_brand AS entity, l_suppkey AS publisher, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY entity) AS share, row_number() OVER (PARTITION BY entity ORDER BY n DESC, publisher) AS rn FROM c)
SELECT entity, publisher, round(share, 6) AS share FROM s WHERE rn <= 8""")
def entity_publisher_share(spark, sf_dir):
    """Each entity's eight largest publishers; brands repeat over parts, so counts are made per part before names are joined."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_suppkey").alias("publisher")).agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    c = per.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("entity", "publisher").agg(F.sum("n").alias("n"))
    total = c.groupBy("entity").agg(F.sum("n").alias("total"))
    top = first_rows(c, ["entity"], [F.desc("n"), F.asc("publisher")], 8)
    return top.join(total, "entity").select("entity", "publisher", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("""SELECT l_suppkey AS entity, l_orderkey AS story FROM (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY d DESC, l_orderkey) AS rn FROM (SELECT l_suppkey, l_orderkey, max(l_shipdate) AS d FROM lineitem GROUP BY 1, 2)) WHERE rn <= 6""")
def entity_latest_stories(spark, sf_dir):
    """The six latest stories of each entity."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.max("l_shipdate").alias("d"))
    return first_rows(s, ["l_suppkey"], [F.desc("d"), F.asc("l_orderkey")], 6).select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("story"))


W = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


@query(f"""WITH t AS (SELECT doc_id AS story, {W.format("text")} AS t, {W.format(r"regexp_extract(text, '^[^.!?\n]*')")} AS lead FROM documents), c AS (SELECT unnest(['the', 'und', 'les', 'que', 'license']) AS entity),
s AS (SELECT story, entity, 3 * len(list_filter(lead, lambda x: x = entity)) + len(list_filter(t, lambda x: x = entity)) AS score FROM t, c)
SELECT story, entity, score::BIGINT AS score FROM s WHERE score >= 2""")
def entity_tags(spark, sf_dir):
    """Entities scored by whole-word mentions, those in the lead counting three more; twelve a story."""
    names = ["the", "und", "les", "que", "license"]
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("story"), words(F.col("text")).alias("t"), words(F.regexp_extract("text", r"^[^.!?\n]*", 0)).alias("lead"))
    met = lambda c, n: F.size(F.filter(c, lambda w: w == n))
    scores = F.array(*(F.struct(F.lit(n).alias("entity"), (3 * met("lead", n) + met("t", n)).cast("long").alias("score")) for n in names))
    return capped_mentions(t.select("story", F.inline(scores)).where("score >= 2"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND length(text) >= 400 ORDER BY doc_id DESC LIMIT 50")
def stale_index_candidates(spark, sf_dir):
    """Rows that aren't indexed at the current revision, newest first."""
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").where(F.length("text") >= 400).select("doc_id").join(done, "doc_id", "left_anti").orderBy(F.desc("doc_id")).limit(50)


@query("""WITH RECURSIVE l AS (SELECT DISTINCT s_suppkey AS a, (s_suppkey * 7) % 90 + 1 AS b FROM supplier WHERE s_suppkey % 3 = 0), b AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
r AS (SELECT a AS node, a AS reach FROM b UNION SELECT r.node, b.b FROM r JOIN b ON b.a = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def link_components(spark, sf_dir):
    """Connected components."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0")
    return components(s.select(F.col("s_suppkey").alias("a"), ((F.col("s_suppkey") * 7) % 90 + 1).alias("b")))
