"""A corpus pipeline of five stages over the documents table.

Each stage works on all rows that its predecessor kept and is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import materialize
from inkwell.llm.linededup import apply_bitmaps, keep_bitmaps
from inkwell.llm.mixing import mixed
from inkwell.llm.pieces import default_model, encode_documents
from inkwell.llm.quality import verdicts
from inkwell.llm.simhash import near_duplicate_classes

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep, unchanged. A null text has no words and goes.

    Each row has its own verdict: rows are told apart by id, host and text, so a rejected row goes
    even where another row of its id stays.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "source", "text").alias("_row"))
    judged = verdicts(keyed.select("doc_id", "text", "source", "_row"), carry=("_row",))
    kept = materialize(judged.where("kept").select("_row").distinct().withColumnRenamed("_row", "_kept"), "kept")
    return keyed.join(kept.hint("merge"), F.col("_row") == F.col("_kept"), "left_semi").select(*COLUMNS)  # rows grow with the corpus: no broadcast


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more of them share, but for the largest doc_id's; n_chars follows the text.

    Rows without an id keep all their lines; a null text becomes an empty one.
    """
    maps = materialize(keep_bitmaps(docs), "bitmaps")
    made = apply_bitmaps(docs, maps, carry=("lang", "source"))
    return made.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five-word shingles, similarity 0.8): the smallest doc_id.

    Candidates come from the chains of SimHash fingerprints and from routing keys with SimHash sketches; links are exact.
    Rows without an id stay, as nothing names them; rows that repeat an id stay or go together.
    """
    kept = materialize(near_duplicate_classes(docs).where("id = component").select(F.col("id").alias("_id")).distinct(), "representatives")
    named = docs.select(*COLUMNS).where("doc_id IS NOT NULL").join(kept.hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi")
    return named.unionByName(docs.select(*COLUMNS).where("doc_id IS NULL"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order in which the Pfair schedule takes blocks of their sources."""
    return mixed(docs.select(*COLUMNS))


def sentencepiece_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids and the digests of ids and decoded text."""
    made = encode_documents(docs, default_model())
    return made.select(F.col("id").alias("doc_id"), "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", sentencepiece_encode),
]

#: SQL can't express the fingerprints, the schedule or the encoding; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
