"""Exports of articles: JSON, Markdown with front matter, EPUB, and snapshots with a check."""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of one EPUB at most, and bytes of their texts.
EPUB_DOCUMENTS, EPUB_BYTES = 500, 32 << 20


def front_matter(fields: dict[str, Column]) -> Column:
    """YAML front matter; values are quoted, quotes and backslashes in them escaped, line ends folded."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r'(["\\])', r"\\$1"), r"\s+", " ")
    lines = [F.concat(F.lit(f'{name}: "'), quoted(c), F.lit('"')) for name, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def markdown(title: Column, body: Column, fields: dict[str, Column]) -> Column:
    return F.concat(front_matter(fields), F.lit("\n# "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")), F.lit("\n"))


def write_markdown(df: DataFrame, path: str, text: str) -> None:
    """One text file row per article; Spark's writer puts them into part files."""
    df.select(F.col(text).alias("value")).write.mode("overwrite").option("lineSep", "\n\f\n").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def epub_of(titles: list[str], texts: list[str]) -> bytes:
    """A small EPUB with a chapter for each text."""
    safe = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        names = [f"c{k}.xhtml" for k in range(len(texts))]
        z.writestr(zipfile.ZipInfo("META-INF/container.xml"), '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        items = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
        z.writestr(zipfile.ZipInfo("book.opf"), f'<package version="3.0" xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{"".join(f"<itemref idref=\"c{k}\"/>" for k in range(len(names)))}</spine></package>')
        for n, title, text in zip(names, titles, texts, strict=True):
            paragraphs = "".join(f"<p>{safe(p)}</p>" for p in text.split("\n") if p.strip())
            z.writestr(zipfile.ZipInfo(n), f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{safe(title)}</title></head><body><h1>{safe(title)}</h1>{paragraphs}</body></html>')
    return out.getvalue()


def epub_volumes(df: DataFrame, group: str, order: str, title: str, text: str) -> DataFrame:
    """(group, volume, n_documents, epub, crc): each group's documents in volumes of EPUB_DOCUMENTS and EPUB_BYTES at most.

    Volumes are cut by running counts of documents and bytes, so the bytes that one task gathers are bounded,
    but for a single text that is larger by itself.
    """
    from pyspark.sql import Window

    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sized = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(title), F.lit("")).alias("title"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias("b"), F.count("*").over(before).alias("k"))
    volumes = sized.withColumn("volume", F.expr(f"struct(k div {EPUB_DOCUMENTS} AS d, b div {EPUB_BYTES // 2} AS b)"))

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o")
        book = epub_of(rows["title"].tolist(), rows["text"].tolist())
        return pd.DataFrame({"g": [key[0]], "d": [rows["d"].iloc[0]], "b": [rows["b"].iloc[0]], "n_documents": [len(rows)], "epub": [book], "crc": [zlib.crc32(book)]})

    flat = volumes.select("g", "o", "title", "text", "volume.d", "volume.b")
    return flat.groupBy("g", "d", "b").applyInPandas(make, "g string, d long, b long, n_documents long, epub binary, crc long").withColumnRenamed("g", group)


def checksum(df: DataFrame) -> DataFrame:
    """(n_rows, sum): the row count and an order-free sum of row hashes."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("sum"))


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write a table and tell whether it reads back the same: (n_rows, ok)."""
    df.write.mode("overwrite").parquet(path)
    back = checksum(df.sparkSession.read.schema(df.schema).parquet(path)).withColumnsRenamed({"n_rows": "n_back", "sum": "sum_back"})
    both = checksum(df).join(F.broadcast(back))  # one row each
    return both.select("n_rows", ((F.col("n_rows") == F.col("n_back")) & (F.col("sum") == F.col("sum_back"))).alias("ok"))
