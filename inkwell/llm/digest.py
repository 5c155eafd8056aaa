"""Canonical exact document digests, with DataFrame functions only.

A text's canonical form is its NFKC normalisation, case-folded, with every run of white space as
one space and none at the ends. Its digest is 128 bits wide: two XXH64 values, the second over the
form with a salt. Texts meet only inside an equal digest, and there their canonical bytes are
compared; should two forms ever share a digest, a SHA-256 suffix tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, text_or_empty

#: Most ranges that successor() cuts the ids into; what is broadcast has a row for each at most.
MAX_RANGES = 65_536
#: Fewest ids to a range.
MIN_WIDTH = 128
#: Ranges of rows without an id.
NULL_RANGES = 64


def canonical(text: Column) -> Column:
    """NFKC, full case folding, then NFKC again (folding can undo it), white space folded. Null stays null."""
    normal = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), normal, F.lit(True))
    again = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.btrim(F.regexp_replace(again, r"[\s\p{Z}]+", " "))


def digest(form: Column) -> Column:
    """32 hex digits of a canonical form."""
    half = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return F.concat(half(F.xxhash64(form)), half(F.xxhash64(F.lit("second"), form)))


def duplicate_forms(df: DataFrame, form_col: str = "form", digest_col: str = "digest") -> DataFrame:
    """(digest, form_sha256, n_rows): the byte-distinct canonical forms inside every equal digest.

    The grouping compares the forms' bytes. A hot group of copies is collapsed by the map-side
    aggregation before anything is shuffled.
    """
    forms = df.groupBy(digest_col, form_col).agg(F.count("*").alias("n_rows"))
    return forms.select(digest_col, F.sha2(F.col(form_col), 256).alias("form_sha256"), "n_rows")


def shared_digests(forms: DataFrame) -> DataFrame:
    """(digest): digests of more than one form; as good as always none."""
    return forms.groupBy("digest").agg(F.count("*").alias("n_forms")).where("n_forms > 1").select("digest")


def _long(x: int) -> str:
    return f"CAST('{x}' AS BIGINT)"


def id_range(df: DataFrame, id_col: str, carried: list[str]):
    """The range of each row of ``df``, in the order of its id; negative for rows without one."""
    low, high, *inner = df.agg(F.min(id_col), F.max(id_col), F.percentile_approx(id_col, [0.001, 0.999], 10_000)).first()
    low, high, (a, b) = low or 0, high or 0, (inner[0] or (0, 0))
    part = MAX_RANGES // 4
    # In decimals: ids may span all 64 bits. The middle holds all but a few thousandths of the rows, in half of the ranges,
    # so a few ids far away leave the others' ranges narrow.
    cut = lambda first, last, ranges, at: f"{at} + CAST((CAST({id_col} AS DECIMAL(20, 0)) - {first}BD) div {max(MIN_WIDTH, (last - first) // (ranges - 1) + 1)}BD AS BIGINT)"
    middle = F.expr(f"CASE WHEN {id_col} < {_long(a)} THEN {cut(low, a, part, 0)} WHEN {id_col} <= {_long(b)} THEN {cut(a, b, 2 * part, part)} ELSE {cut(b, high, part, 3 * part)} END")
    return F.coalesce(middle, -1 - F.pmod(F.xxhash64(*carried), F.lit(NULL_RANGES)))


def successor(df: DataFrame, id_col: str, carried: list[str], prefix: str = "next_") -> DataFrame:
    """Add ``prefix + c`` for each carried column: its value in the next row by descending id.

    After the last row comes the first. Ids are cut into ranges, of equal width between the outer thousandths of
    the ids and of others beyond; a window runs inside each range, and the first row of a range is copied into the range before it, so no row waits for
    another partition. The range table has MAX_RANGES rows at most, which bounds the broadcast.
    Equal ids follow each other in the order of their carried values; rows without an id come last,
    in NULL_RANGES ranges of a hash of their values.
    """
    ranged = df.withColumn("_range", id_range(df, id_col, carried))
    rank = [F.desc_nulls_last(id_col), *(F.asc_nulls_first(c) for c in carried)]
    heads = ranged.groupBy("_range").agg(F.max(id_col).alias("_head"))
    order = Window.orderBy(F.desc("_range"))
    before = F.coalesce(F.lag("_range").over(order), F.min("_range").over(Window.partitionBy()))
    heads = heads.select(F.col("_range").alias("_own"), before.alias("_before"), "_head")
    # Rows of the largest id of a range: the first among them is found by the window they are copied into.
    copies = ranged.join(F.broadcast(heads), (F.col("_range") == F.col("_own")) & F.col(id_col).eqNullSafe(F.col("_head")))
    copies = copies.select(*df.columns, F.col("_before").alias("_range"), F.lit(1).alias("_copy"))
    both = ranged.select(*df.columns, "_range", F.lit(0).alias("_copy")).unionByName(copies)
    line = Window.partitionBy("_range").orderBy("_copy", *rank)
    out = both.select(*df.columns, "_copy", *(F.lead(c).over(line).alias(prefix + c) for c in carried))
    return out.where("_copy = 0").drop("_copy")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form, digest) of every whole text; null counts as empty."""
    form = df.select(F.col(id_col).alias("id"), canonical(text_or_empty(text_col)).alias("form"))
    return form.withColumn("digest", digest(F.col("form")))


def op2_canonical_digest(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness (1 for equal forms, else 0).

    ``n_copies`` counts the rows of the document's canonical form.
    """
    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    line = successor(docs, "doc_id", ["text"])
    n = F.length("text").cast("long")
    third = F.expr("CAST(length(text) div 3 AS INT)")
    made = line.select(
        "doc_id", n.alias("n_chars"), "text", "next_text",
        F.concat(F.expr("left(text, CAST(length(text) - length(text) div 3 AS INT))"), F.substring("next_text", F.lit(1), third)).alias("edited"),
    )
    made = made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("form"), canonical(F.col("edited")).alias("edited_form"), canonical(F.col("next_text")).alias("next_form"),
    )
    same = lambda c: F.when(F.col("form") == F.col(c), 1.0).otherwise(0.0)
    rows = materialize(
        made.select(
            "doc_id", "n_chars", "edited_sha256", digest(F.col("form")).alias("digest"), digest(F.col("edited_form")).alias("edited_digest"),
            same("edited_form").alias("near_edited"), same("next_form").alias("near_next"), F.sha2("form", 256).alias("form_sha256"), F.sha2("edited_form", 256).alias("edited_sha"),
        ),
        "digests",
    )
    forms = materialize(duplicate_forms(fingerprint_documents(docs)), "forms")
    many = materialize(shared_digests(forms), "shared-digests")
    counted = rows.join(forms, ["digest", "form_sha256"], "left")
    # Both texts' digests get their form's hash where the documents hold two forms of the digest, so equal texts stay equal.
    for c, sha in (("digest", "form_sha256"), ("edited_digest", "edited_sha")):
        at = many.select(F.col("digest").alias("_d"))
        counted = counted.join(at, F.col(c) == F.col("_d"), "left").withColumn(c, F.when(F.col("_d").isNull(), F.col(c)).otherwise(F.concat(F.col(c), F.lit(":"), sha))).drop("_d")
    return counted.select("doc_id", "n_chars", "edited_sha256", F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next", F.col("n_rows").alias("n_copies"))
