"""Token counts of whole texts by compiled transducers, without encoding them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, text_or_empty
from .transducer import END, CountTransducer, class_table, piece_starts

#: Characters turned into classes, and pieces counted, at a time.
WINDOW = 1 << 20
PIECES = 1 << 18

_COMPILED: dict[str, CountTransducer] = {}


def compiled(path: str) -> CountTransducer:
    """The transducer of a tokenizer file: made once in a worker, which keeps its states from task to task."""
    if path not in _COMPILED:
        _COMPILED[path] = CountTransducer(path)
    return _COMPILED[path]


def count_tokens(texts: list[str], transducer: CountTransducer) -> np.ndarray:
    """Tokens of each text. Strings of added tokens inside a text are one token each and part what is on either side."""
    added = re.compile("|".join(map(re.escape, sorted(transducer.added, key=len, reverse=True)))) if transducer.added else None
    total, parts, owner = np.zeros(len(texts), np.int64), [], []
    for k, text in enumerate(texts):
        if added and added.search(text):
            pieces = added.split(text)
            total[k] = len(pieces) - 1
        else:
            pieces = [text]
        parts += pieces
        owner += [k] * len(pieces)
    joined = "".join(parts)
    if not joined:
        return total
    ends = np.cumsum([len(p) for p in parts])
    table = class_table()
    classes = np.concatenate([table[np.frombuffer(joined[a : a + WINDOW].encode("utf-32-le"), np.uint32)] for a in range(0, len(joined), WINDOW)])
    starts = piece_starts(np.insert(classes, ends, END))
    starts = np.delete(starts, ends + np.arange(len(ends)))
    chars = np.flatnonzero(starts)
    data = np.frombuffer(joined.encode(), np.uint8)
    at = np.flatnonzero((data & 0xC0) != 0x80)[chars]
    lengths = np.diff(at, append=len(data))
    of = np.asarray(owner)[np.searchsorted(ends, chars, side="right")]
    for a in range(0, len(at), PIECES):
        counts = transducer.count(data, at[a : a + PIECES], lengths[a : a + PIECES])
        total += np.bincount(of[a : a + PIECES], counts, len(texts)).astype(np.int64)
    return total


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch in groups of about WINDOW characters, with the place of the first."""
    group, size, first = [], 0, 0
    for k, text in enumerate(column):
        group.append(text.as_py())
        size += len(group[-1])
        if size >= WINDOW:
            yield first, group
            group, size, first = [], 0, k + 1
    if group:
        yield first, group


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row: UTF-8 bytes, tokens as the library counts them, whether these are more than ``limit``.

    A null text counts as empty: no bytes, no tokens. Ids may be null or repeat; every row has a row
    in the result, and other columns are not read.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(tokenizer_path)
        for b in it:
            for first, texts in _groups(b.column(2)):
                n = pa.array(count_tokens(texts, transducer))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), n], names=["id", "n_bytes", "n_tokens"])

    t = text_or_empty(text_col)
    read = df.select(F.col(id_col).cast("long").alias("id"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("t"))
    return read.mapInArrow(batches, "id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document under the byte-level vocabulary."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
