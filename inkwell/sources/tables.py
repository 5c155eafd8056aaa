"""The driver tables, and the library relations that stand on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words

#: The relation of articles in DuckDB SQL, for oracles; the counterpart of ``articles``.
ARTICLES_SQL = r"""articles AS (
  SELECT doc_id AS id, text AS body, source, lang,
         regexp_extract(text, '^[^.!?\n]*') AS title,
         epoch(TIMESTAMP '2024-01-01')::BIGINT + doc_id * 60 AS published
  FROM documents
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: id, title (up to the first full stop), body, source, lang, published (epoch seconds)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("body"),
        "source",
        "lang",
        F.regexp_extract("text", r"^[^.!?\n]*", 0).alias("title"),
        (F.lit(1704067200).cast("long") + F.col("doc_id") * 60).alias("published"),
    )


def reading_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article, user_id, is_read, is_saved, at): views of events read an article, purchases save it; the event's number picks it."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("id"),
        "user_id",
        (F.col("event_type") == "view").alias("is_read"),
        (F.col("event_type") == "purchase").alias("is_saved"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"),
    )


def title_words(df: DataFrame) -> DataFrame:
    return df.withColumn("title_words", words(F.col("title")))
