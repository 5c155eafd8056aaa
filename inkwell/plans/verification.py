"""Queries that check derived text against sources; conversations stand for revisions and claims."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators.verification import citation_match, fidelity, forward_kind, note_place, quote_grounded, sanitized, sentence_diff, thematic, tone, unsupported_numbers
from ..registry import query
from ..sources.tables import table

W = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
CLAIMS = f"""c AS (SELECT d.doc_id AS id, d.text AS source, regexp_extract(o.text, '^[^.!?\\n]*') AS claim FROM documents d JOIN documents o ON o.doc_id = d.doc_id - d.doc_id % 2),
w AS (SELECT *, ' ' || array_to_string({W.format("claim")}, ' ') || ' ' AS p, ' ' || array_to_string({W.format("source")}, ' ') || ' ' AS s, list_distinct({W.format("claim")}) AS cw, {W.format("source")} AS sw FROM c)"""


def _claims(spark, sf_dir):
    """Each document with the first sentence of the even document at or before it."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("source"), (F.col("doc_id") - F.col("doc_id") % 2).alias("of"))
    o = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("of"), F.regexp_extract("text", r"^[^.!?\n]*", 0).alias("claim"))
    return d.join(o, "of").select("id", "source", "claim")


@query(f"WITH {CLAIMS} SELECT id, length(p) > 2 AND contains(s, p) AS grounded FROM w")
def quote_grounding(spark, sf_dir):
    """Whether each claim stands in its source word for word."""
    return _claims(spark, sf_dir).select("id", quote_grounded(F.col("claim"), F.col("source")).alias("grounded"))


@query(f"""WITH {CLAIMS}, n AS (SELECT id, list_distinct(list_transform(regexp_extract_all(claim, '[0-9]+(?:[.,][0-9]+)*'), lambda x: replace(x, ',', ''))) AS a, list_transform(regexp_extract_all(source, '[0-9]+(?:[.,][0-9]+)*'), lambda x: replace(x, ',', '')) AS b FROM c)
SELECT id, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS unsupported FROM n""")
def number_fidelity(spark, sf_dir):
    """Numbers of each claim that its source lacks."""
    return _claims(spark, sf_dir).select("id", F.size(unsupported_numbers(F.col("claim"), F.col("source"))).alias("unsupported"))


@query(f"WITH {CLAIMS} SELECT id, (length(p) > 2 AND contains(s, p)) OR (len(cw) > 0 AND len(list_intersect(cw, sw)) >= 0.6 * len(cw)) AS matched FROM w")
def citation_blocks(spark, sf_dir):
    """Which quotes a block holds, or nearly."""
    return _claims(spark, sf_dir).select("id", citation_match(F.col("claim"), F.col("source")).alias("matched"))


def _turns(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", before.alias("before")).where("before IS NOT NULL")


@query()
def claim_fidelity(spark, sf_dir):
    """Negation flips and dropped hedges against the closest sentence of the turn before."""
    return fidelity(_turns(spark, sf_dir), ["conv_id", "turn"], "text", "before")


@query()
def sentence_diffs(spark, sf_dir):
    """Sentence diffs of each turn and the one before."""
    return sentence_diff(_turns(spark, sf_dir), ["conv_id", "turn"], "before", "text")


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\b(if|unless|could|might|provided that)\b') THEN 'conditional' WHEN regexp_matches(lower(text), '\b(scheduled|will be held|is set for|takes place|due on)\b') THEN 'scheduled' WHEN regexp_matches(lower(text), '\b(expected to|plans to|is likely to|will)\b') THEN 'expected' END AS kind FROM conversations""")
def forward_watch(spark, sf_dir):
    """What looks ahead, and how."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", forward_kind(F.col("text")).alias("kind"))


@query(r"""SELECT doc_id, regexp_matches(lower(text), '[$€£%]|\b(percent|million|billion|revenue|profit|shares)\b') AND NOT regexp_matches(lower(text), '\b(forecast|outlook|should buy|should sell|price target|we recommend|is expected to)\b') AS thematic FROM documents""")
def thematic_angles(spark, sf_dir):
    """P10: financial or quantitative facts without forecasts or advice."""
    return table(spark, sf_dir, "documents").select("doc_id", thematic(F.col("text")).alias("thematic"))


@query("SELECT event_id, round(CASE WHEN event_type = 'error' AND value / 100 - 0.5 < 0 THEN (value / 100 - 0.5) * 0.5 ELSE value / 100 - 0.5 END, 6) AS tone FROM events")
def tone_calibration(spark, sf_dir):
    """Tone with adverse reports' negativity discounted; the sentiment is given."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(tone(F.col("value") / 100 - 0.5, F.col("event_type") == "error"), 6).alias("tone"))


@query("SELECT doc_id, instr(text, substr(text, 31, 20))::INT AS first, CASE WHEN instr(text, substr(text, 21, 40)) > 0 THEN (instr(text, substr(text, 21, 40)) + 10)::INT END AS place FROM documents WHERE length(text) >= 80")
def note_anchors(spark, sf_dir):
    """Where notes' quotes stand, by their neighbours."""
    d = table(spark, sf_dir, "documents").where("length(text) >= 80")
    part = lambda a, n: F.substring("text", a, n)
    return d.select("doc_id", F.instr("text", part(31, 20)).alias("first"), note_place(F.col("text"), part(31, 20), part(21, 10), part(51, 10)).alias("place"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace('<system>' || text || '</system> #### <|end|>', '(?i)</?\s*(system|assistant|user|instructions?|source|untrusted)\b[^>]*>|<\|[^|>]*\|>', ' ', 'g'), '`{3,}|#{3,}|-{4,}|={4,}', ' ', 'g'), '[ \t]+', ' ', 'g'), ' ') AS clean FROM conversations""")
def delimiters_removed(spark, sf_dir):
    """Texts without marks that could pass for delimiters."""
    marked = F.concat(F.lit("<system>"), "text", F.lit("</system> #### <|end|>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sanitized(marked).alias("clean"))


MONTH_NAME = "list_extract(['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'], month(o_orderdate)::INT)"


def order_statements(spark, sf_dir):
    """(o_orderkey, claim, source): what each order's figures are worth, told in two units; some sources differ by key."""
    o = table(spark, sf_dir, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    day = F.to_date("o_orderdate")
    kg = k % 97 + 1
    thousand = F.round(price / 1000, 2).cast("decimal(18,2)").cast("string")
    claim = F.concat(F.lit("It cost "), thousand, F.lit(" thousand dollars on "), F.date_format(day, "d MMMM yyyy"), F.lit(" and weighed "), kg.cast("string"), F.lit(" kg."))
    paid = F.round(F.when(k % 5 == 1, price * 1.02).otherwise(price), 2).cast("decimal(18,2)").cast("string")
    grams = F.when(k % 3 == 1, kg * 1010).otherwise(kg * 1000).cast("string")
    source = F.concat(F.when(k % 4 == 1, "EUR ").otherwise("USD "), paid, F.lit(" was paid; dated "), F.date_format(F.when(k % 7 == 1, F.date_add(day, 1)).otherwise(day), "yyyy-MM-dd"), F.lit(", net "), grams, F.lit(" grams."))
    return o.select("o_orderkey", claim.alias("claim"), source.alias("source"))


@query("""WITH p AS (SELECT o_orderkey, o_totalprice::DOUBLE AS price, round(CASE WHEN o_orderkey % 5 = 1 THEN o_totalprice::DOUBLE * 1.02 ELSE o_totalprice::DOUBLE END, 2) AS paid FROM orders), q AS (SELECT *, round(price / 1000, 2) * 1000 AS told FROM p)
SELECT o_orderkey, (CASE WHEN o_orderkey % 4 = 1 OR abs(told - paid) > 0.005 * greatest(told, paid) THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END)::INT AS quantities, CASE WHEN o_orderkey % 7 = 1 THEN 1 ELSE 0 END AS dates FROM q""")
def quantity_fidelity(spark, sf_dir):
    """Figures of a claim that its source does not state: money in thousands against units, kilograms against grams, days in words against figures. The SQL reckons with the table's numbers and parses no text."""
    from ..operators.quantities import quantities, stated_dates, unsupported_dates, unsupported_quantities

    # dealt anew: a file of few row groups is read by few tasks, and reading the texts' figures is the work
    o = order_statements(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    found = o.select("o_orderkey", quantities(F.col("claim")).alias("c"), quantities(F.col("source")).alias("s"), stated_dates(F.col("claim")).alias("cd"), stated_dates(F.col("source")).alias("sd"))
    return found.select("o_orderkey", F.size(unsupported_quantities(F.col("c"), F.col("s"))).alias("quantities"), F.size(unsupported_dates(F.col("cd"), F.col("sd"))).alias("dates"))


def reported_orders(spark, sf_dir):
    """(o_orderkey, claim, source): what a customer said of each order, and a retelling that goes wrong in a way told by the key."""
    named = lambda c: F.initcap(F.translate((c + 1000).cast("string"), "0123456789", "abcdefghij"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", named(F.col("o_custkey")).alias("who"), named(F.col("o_orderkey") + 500_000).alias("other"))
    case = F.pmod(F.col("o_orderkey"), F.lit(8))
    source = F.concat("who", F.lit(" said the order was shipped and inspected by the port. "), "other", F.lit(' wrote "we never saw the goods that were promised to us". The clerk was reportedly absent.'))
    who, other = F.col("who"), F.col("other")
    claim = (
        F.when(case == 0, F.concat(who, F.lit(" said the order was shipped and inspected.")))
        .when(case == 1, F.concat(F.lit("Zz"), F.lower(who), F.lit(" said the order was shipped and inspected.")))
        .when(case == 2, F.concat(who, F.lit(" said the order was not shipped and not inspected by the port.")))
        .when(case == 3, F.concat(who, F.lit(" said the order was shipped and the port charged.")))
        .when(case == 4, F.lit('"We never saw the goods" at the port.'))
        .when(case == 5, F.lit("The clerk was absent."))
        .when(case == 6, F.lit("it seems that they never saw the goods that were promised to anyone."))
        .otherwise(F.concat(other, F.lit(" said the order was shipped and inspected by the port.")))
    )
    return o.select("o_orderkey", claim.alias("claim"), source.alias("source"))


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN 'speaker,attribution' WHEN 2 THEN 'negation' WHEN 3 THEN 'action' WHEN 4 THEN 'detached_quotation' WHEN 5 THEN 'hedge' WHEN 6 THEN 'quotation_as_fact' WHEN 7 THEN 'speaker' ELSE '' END AS failures FROM orders""")
def claim_failures(spark, sf_dir):
    """What speaks against each retelling: speaker, attribution, negation, act, hedge, quotation. The SQL tells it by how each was made."""
    from ..operators.claims import claim_failures as failures

    made = failures(reported_orders(spark, sf_dir), ["o_orderkey"], "claim", "source")
    return made.select("o_orderkey", F.array_join("failures", ",").alias("failures"))
