"""Line deduplication over range-partitioned, secondarily sorted line hashes.

Line keys are hashed to 128 bits, range-partitioned by (hash, document) and sorted, so a task streams
each hash with its documents in order. A hash that fills many partitions is cut between documents;
each task tells what it saw of its first and last hash, and these few summaries settle the rows that
one task alone could not decide. What comes back is a compressed bitmap of kept lines per document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, in_parts, materialize, text_or_empty

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5


def line_keys(df: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, id, line): the key hash of every line that is long enough."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, at, hashes = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for k, line in enumerate(t.as_py().split("\n")):
                    if len(line) >= min_chars and len(key := line.strip(SPACE)) >= min_chars:
                        ids.append(i)
                        at.append(k)
                        hashes.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()))
            both = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64()), pa.array(at, pa.int32())], ["h1", "h2", "id", "line"])

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    return rows.mapInArrow(batches, "h1 long, h2 long, id long, line int")


def _settle(it: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Stream a partition sorted by (h1, h2, id descending, line).

    Out come rows (h1, h2, id, line, docs): docs 0 for a line to drop; -1 for a line whose hash
    may go on in another partition; above 0 for the summary of such a hash, with its number of
    documents here and its largest document in ``id``. One batch is held, and of the hash that
    reaches into the next batch the rows that can't be decided yet.
    """
    names = ["h1", "h2", "id", "line", "docs"]

    def out(h1, h2, ids, line, docs):
        return pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.int64()), pa.array(line, pa.int32()), pa.array(docs, pa.int32())], names)

    first = True  # the partition's first hash is still open
    open_key, open_docs, open_top, open_last = None, 0, 0, None
    waiting: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the open hash, not its top document's
    for b in it:
        if not b.num_rows:
            continue
        h1, h2, ids, line = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        new_hash = np.concatenate([[open_key != (h1[0], h2[0])], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        starts = np.flatnonzero(new_hash)
        pieces = np.concatenate([[0], starts]) if not new_hash[0] else starts
        ends = np.concatenate([pieces[1:], [len(h1)]])
        for s, e in zip(pieces.tolist(), ends.tolist(), strict=True):
            if new_hash[s]:
                if open_key is not None:
                    yield from _close(out, open_key, open_docs, open_top, waiting, min_docs, first)
                    first = False
                open_key, open_docs, open_top, open_last, waiting = (h1[s], h2[s]), 0, ids[s], None, []
            part = ids[s:e]
            changes = int((part[1:] != part[:-1]).sum()) + (open_last is None or open_last != part[0])
            open_docs, open_last = open_docs + changes, part[-1]
            rest = part != open_top
            if rest.any():
                waiting.append((part[rest], line[s:e][rest]))
            if not first and open_docs >= min_docs and waiting:  # decided: nothing needs to wait
                w = waiting
                waiting = []
                x, y = np.concatenate([a for a, _ in w]), np.concatenate([c for _, c in w])
                yield out(np.full(len(x), open_key[0]), np.full(len(x), open_key[1]), x, y, np.zeros(len(x)))
            elif first and len(waiting) and sum(len(a) for a, _ in waiting) > 100_000:
                yield from _pending(out, open_key, waiting)
                waiting = []
            if first and len(part):  # the top document's rows may have to go as well, if it is not the top elsewhere
                top = ~rest
                if top.any():
                    yield out(np.full(top.sum(), open_key[0]), np.full(top.sum(), open_key[1]), part[top], line[s:e][top], np.full(top.sum(), -1))
    if open_key is not None:
        # The last hash may go on in the next partition: its documents there are smaller, its top is here.
        yield from _pending(out, open_key, waiting)
        yield out([open_key[0]], [open_key[1]], [open_top], [0], [open_docs])


def _pending(out, key, waiting):
    if waiting:
        x, y = np.concatenate([a for a, _ in waiting]), np.concatenate([c for _, c in waiting])
        yield out(np.full(len(x), key[0]), np.full(len(x), key[1]), x, y, np.full(len(x), -1))


def _close(out, key, docs, top, waiting, min_docs, first):
    """End a hash inside a partition."""
    if first:
        yield from _pending(out, key, waiting)
        yield out([key[0]], [key[1]], [top], [0], [docs])
    elif docs >= min_docs and waiting:
        x, y = np.concatenate([a for a, _ in waiting]), np.concatenate([c for _, c in waiting])
        yield out(np.full(len(x), key[0]), np.full(len(x), key[1]), x, y, np.zeros(len(x)))


def dropped_lines(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line): the lines to drop, numbered from 0 in each document.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents keeps its
    lines in the largest id that holds it. Null ids hold no key. Rows that repeat an id count as one
    document, and a line number that any of them drops is dropped in all of them.
    """
    keys = materialize(line_keys(df, min_chars, id_col, text_col), "line-keys")
    n = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.asc("h1"), F.asc("h2"), F.desc("id")]
    dealt = keys.repartitionByRange(n, *order).sortWithinPartitions(*order, F.asc("line"))
    seen = materialize(dealt.mapInArrow(lambda it: _settle(it, min_docs), "h1 long, h2 long, id long, line int, docs int"), "line-drops")
    # Two summaries a partition at most, so the broadcast is bounded by the number of partitions.
    ends = seen.where("docs > 0").groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("id").alias("top")).where(F.col("docs") >= min_docs)
    late = seen.where("docs = -1").join(F.broadcast(ends.select("h1", "h2", "top")), ["h1", "h2"]).where("id < top").select("id", "line")
    return seen.where("docs = 0").select("id", "line").unionByName(late)


def keep_bitmaps(df: DataFrame, **options) -> DataFrame:
    """(id, keep): for every document that loses lines, a zlib-compressed bitmap with a set bit for each line that stays.

    Bits are little-endian from line 0 on; lines past the bitmap's end stay.
    """

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            maps = []
            for lines in b.column(1):
                at = np.array(lines.as_py(), np.int64)
                bits = np.ones((at.max() // 8 + 1) * 8, np.uint8)  # whole bytes, so padding never drops a line
                bits[at] = 0
                maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.binary())], ["id", "keep"])

    return dropped_lines(df, **options).groupBy("id").agg(F.collect_set("line").alias("lines")).mapInArrow(pack, "id long, keep binary")


def kept_text(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """The text of the kept lines, the number of lines before, and the number dropped."""
    lines = text.split("\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[: len(lines)]
    stay = [x for k, x in enumerate(lines) if k >= len(bits) or bits[k]]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def apply_bitmaps(df: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept, n_lines, n_dropped) and the string columns of ``carry``: every row with the lines its bitmap keeps.

    Null texts count as empty: one line.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(it):
            rows = [kept_text(t.as_py(), k) for t, k in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
            made = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made, *b.columns[3:]], ["id", "kept", "n_lines", "n_dropped", *carry])

    rows = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("t"), *carry)
    # The bitmaps grow with the corpus: never broadcast.
    joined = rows.join(maps.hint("merge"), F.col("_id") == F.col("id"), "left").select("_id", "t", "keep", *carry)
    return joined.mapInArrow(batches, "id long, kept string, n_lines long, n_dropped long" + "".join(f", {c} string" for c in carry))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = documents(spark, sf_dir)
    made = apply_bitmaps(docs, materialize(keep_bitmaps(docs), "bitmaps"))
    return made.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
