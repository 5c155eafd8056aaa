"""Quality rules per document and per host, with DataFrame functions only.

Documents fail by their own figures first. Failures are then counted by host, each host's rate is
shrunk by a beta prior fitted to all hosts, and a host whose shrunk rate is too high fails the
documents it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, text_or_empty

#: White space that separates words: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A host is rejected from this shrunk failure rate on.
HOST_RATE = 0.5
#: Copies of the host table that the documents of one host are spread over in the join.
SALTS = 16


def _repeat_words() -> Column:
    """Words in 8-word windows found twice or more, from ``starts``: the starts of such windows in order.

    Each start covers the words up to the next start, eight at most.
    """
    n = WINDOW
    return F.expr(f"aggregate(transform(starts, (s, k) -> CAST(least({n}, coalesce(get(starts, k + 1) - s, {n})) AS BIGINT)), 0L, (a, x) -> a + x)")


def figures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text; the text is dropped.

    Null and empty texts have no words and zeros throughout.
    """
    kept = [c for c in df.columns if c != text_col]
    space, bare = r"[ \t\n\x0B\f\r]+", F.translate("_t", SPACE, "")
    words = F.filter(F.split("_t", space), lambda w: w != "")
    rows = df.select(*kept, text_or_empty(text_col).alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = rows.select(
        *kept,
        words.alias("words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    rows = rows.withColumn("hashes", F.expr(f"CASE WHEN size(words) < {WINDOW} THEN array() ELSE transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))) END"))
    rows = rows.withColumn("sorted", F.sort_array("hashes"))
    # Most texts repeat no window: only where one does are (hash, start) pairs sorted.
    rows = rows.withColumn("pairs", F.expr("""
        CASE WHEN exists(transform(sorted, (x, k) -> x = get(sorted, k - 1)), same -> same)
             THEN sort_array(transform(hashes, (h, i) -> struct(h AS h, i AS i))) ELSE array() END"""))
    rows = rows.withColumn("starts", F.expr("sort_array(transform(filter(pairs, (p, k) -> get(pairs, k - 1).h = p.h OR get(pairs, k + 1).h = p.h), p -> p.i))"))
    return rows.select(
        *kept, F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", _repeat_words().alias("n_repeat_words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def host_rates(rows: DataFrame, host_col: str = "host", failed_col: str = "base_failed") -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate): failure rates shrunk by an empirical beta prior.

    The prior has the mean and variance of the hosts' rates, less the variance that draws of their
    sizes have by themselves (method of moments). If that leaves no variance, all hosts share the
    overall rate.
    """
    hosts = rows.groupBy(host_col).agg(F.count("*").alias("n_docs"), F.count_if(F.col(failed_col)).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.var_pop(rate).alias("spread"), F.avg(1 / F.col("n_docs")).alias("inv"))
    # Variance between hosts: observed less binomial, m (1 - m) E[1/n].
    binomial = F.col("mean") * (1 - F.col("mean"))
    between = F.col("spread") - binomial * F.col("inv")
    strength = F.when(between > 1e-9, F.greatest(binomial / between - 1, F.lit(1.0))).otherwise(F.lit(1e9))
    prior = prior.select("mean", strength.alias("strength"))
    return hosts.join(F.broadcast(prior)).select(  # the prior is one row
        host_col, "n_docs", "n_failed", ((F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))).alias("shrunk_rate")
    )


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row's figures with ``base_failed``, the host's ``shrunk_rate`` and ``kept``, and the columns of ``carry``.

    The host is ``host_col`` (null: ''). Ids may repeat or be null; each row has its own verdict.
    An empty table gives none. ``host`` tables join back on (host, salt), so the rows of a host with
    a third of all documents go to SALTS tasks.
    """
    rows = figures(df.select(id_col, text_col, *carry, F.coalesce(F.col(host_col), F.lit("")).alias("host")), id_col, text_col)
    rows = materialize(rows.withColumn("base_failed", base_failed()), "figures")
    rates = host_rates(rows).select(F.col("host").alias("_host"), "shrunk_rate", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(id_col, "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    joined = salted.join(rates, (F.col("host") == F.col("_host")) & (F.col("salt") == F.col("_salt")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("shrunk_rate") < host_rate)).drop("_host", "_salt", "salt")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, figures, base_failed and kept of every document, with its host's shrunk failure rate."""
    return verdicts(documents(spark, sf_dir, "doc_id", "text", "source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "shrunk_rate"
    )
