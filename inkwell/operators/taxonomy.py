"""Classes of texts by the phrases of a taxonomy: topics by weighted fields, sectors by sentences with an implication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences
from .phrases import dictionary, phrase_hits

#: Points of a phrase by the field that holds it.
POINTS = {"title": 3.0, "description": 1.5, "body": 0.5}
LEAST_POINTS = 2.0


def taxonomy_of(phrases: DataFrame) -> DataFrame:
    """(phrase_id, class_no, label, factor, phrase): a taxonomy with its phrases numbered by what they are.

    ``phrases`` holds (class_no, label, phrase) and, if phrases differ in weight, ``factor``. A phrase of two classes
    counts for both; repeated rows count once.
    """
    factor = F.col("factor") if "factor" in phrases.columns else F.lit(1.0)
    cut = phrases.select("class_no", "label", factor.cast("double").alias("factor"), F.array_join(F.filter(F.split(F.lower("phrase"), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ").alias("phrase")).where("phrase <> ''")
    return cut.groupBy("class_no", "label", "phrase").agg(F.max("factor").alias("factor")).withColumn("phrase_id", F.xxhash64("phrase"))


def classified(
    df: DataFrame, id_col: str, fields: dict[str, str], phrases: DataFrame, removed: list[str] = (), catch_all: str | None = None, foreign: tuple[str, str, list[str]] | None = None, hint: str | None = None, least: float = LEAST_POINTS
) -> DataFrame:
    """(id, label, confidence, score, evidence) of the texts that reach ``least`` points in a class.

    ``fields`` names the column of each of title, description and body. A phrase gives its field's points times its
    factor once a field. The class of most points wins, ties going to the smaller class_no, but to any other class before
    ``catch_all``. ``foreign`` = (from, to, cues): a text of class ``from`` whose title holds a phrase of class ``to`` and
    none of the cues is of class ``to``. A ``hint`` column that is a class's label decides with a confidence of 0.95.
    ``evidence`` lists, in order, the winning class's phrases met in title and description. Ids have to be distinct.
    """
    taxonomy = taxonomy_of(phrases)
    spark = df.sparkSession
    cues = spark.createDataFrame([(c,) for c in (foreign[2] if foreign else ())], "cue string").withColumn("phrase_id", F.xxhash64(F.lower("cue")))
    known = dictionary(taxonomy.select("phrase_id", "phrase").unionByName(cues.select("phrase_id", F.col("cue").alias("phrase"))), "phrase_id", "phrase")
    column_of = {v: k for k, v in fields.items()}
    met = phrase_hits(df, id_col, list(fields.values()), known, removed).select("id", "field", "phrase_id").distinct()
    points = F.create_map(*[F.lit(x) for column, kind in column_of.items() for x in (column, POINTS[kind])])
    scored = met.join(taxonomy, "phrase_id")
    shown = F.col("field").isin(*[c for c, kind in column_of.items() if kind != "body"])
    per = scored.groupBy("id", "class_no", "label").agg(
        F.sum(F.element_at(points, F.col("field")) * F.col("factor")).alias("score"),
        F.array_sort(F.collect_set(F.when(shown, F.col("phrase")))).alias("evidence"),
    )
    order = F.struct(F.col("score"), (F.col("label") != F.lit(catch_all or "")).cast("int").alias("o"), (-F.col("class_no")).alias("n"))
    best = per.groupBy("id").agg(F.max_by(F.struct("label", "score", "evidence"), order).alias("b")).select("id", "b.*")
    if foreign:
        source, target, _ = foreign
        title = met.where(F.col("field") == fields["title"])
        abroad = title.join(taxonomy.where(F.col("label") == target), "phrase_id", "left_semi").select("id").distinct().withColumn("abroad", F.lit(True))
        home = title.join(cues, "phrase_id", "left_semi").select("id").distinct().withColumn("home", F.lit(True))
        moved = (F.col("label") == source) & F.col("abroad").isNotNull() & F.col("home").isNull()
        best = best.join(abroad, "id", "left").join(home, "id", "left").withColumn("label", F.when(moved, F.lit(target)).otherwise(F.col("label"))).drop("abroad", "home")
    best = best.where(F.col("score") >= least).withColumn("confidence", F.least(F.lit(0.95), 0.5 + 0.08 * F.col("score")))
    if hint:
        labels = taxonomy.select("label").distinct()
        told = df.select(F.col(id_col).alias("id"), F.btrim(hint).alias("told")).join(labels, F.lower("told") == F.lower("label")).select("id", "label", F.array("told").alias("told"))
        best = best.withColumnRenamed("label", "found").join(told, "id", "full").select(
            "id", F.coalesce("label", "found").alias("label"), F.when(F.col("label").isNotNull(), 0.95).otherwise(F.col("confidence")).alias("confidence"), "score", F.coalesce("told", "evidence").alias("evidence")
        )
    return best.select("id", "label", "confidence", "score", "evidence")


def sector_impacts(
    df: DataFrame, id_col: str, text_col: str, sectors: DataFrame, implications: DataFrame, homonyms: list[str] = (), rejected: Column | None = None, most: int = 4
) -> DataFrame:
    """(id, pos, sentence, label, cues): sentences that name a sector and what it means for it, ``most`` a text.

    A sentence counts where it holds an implication phrase and a sector's; its sector is the one with most of its phrases
    met, then the longest, then the smaller class_no. ``homonyms`` are taken out before sectors are sought. ``rejected`` tests the
    column ``sentence`` (forecasts, advice). Each sector is told once a text, by its first sentence. Ids have to be distinct.
    """
    taxonomy = taxonomy_of(sectors)
    cut = df.select(F.col(id_col).alias("id"), F.posexplode(sentences(F.col(text_col))).alias("pos", "sentence"))
    if rejected is not None:
        cut = cut.where(~rejected)
    cut = cut.select(F.struct("id", "pos").alias("s"), "sentence")
    implied = phrase_hits(cut, "s", ["sentence"], dictionary(implications.select(F.xxhash64("phrase").alias("phrase_id"), "phrase"), "phrase_id", "phrase")).select("id").distinct()
    met = phrase_hits(cut, "s", ["sentence"], dictionary(taxonomy, "phrase_id", "phrase"), homonyms).select("id", "phrase_id").distinct().join(implied, "id", "left_semi")
    per = met.join(taxonomy, "phrase_id").groupBy("id", "class_no", "label").agg(F.count("*").cast("int").alias("cues"), F.max(F.length("phrase")).alias("longest"))
    best = per.groupBy("id").agg(F.max_by(F.struct("label", "cues"), F.struct("cues", "longest", (-F.col("class_no")).alias("n"))).alias("b")).select(F.col("id.id").alias("id"), F.col("id.pos").alias("pos"), "b.*")
    first = best.groupBy("id", "label").agg(F.min(F.struct("pos", "cues")).alias("f")).select("id", "label", "f.*")
    # a text has as many rows here as there are sectors at most
    kept = first.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "label", "cues"))), 1, most).alias("k")).select("id", F.inline("k"))
    return kept.join(cut.select("s.id", "s.pos", "sentence"), ["id", "pos"]).select("id", "pos", "sentence", "label", "cues")
