"""Removal of byte strings that occur more than once in the corpus, and a count of shared word passages.

Every window (400 bytes, or 51 words) has an anchor: the least hash of the short pieces inside it.
Equal windows have equal anchors, so a window can only repeat where its anchor does. Consecutive
windows of one anchor are one row, a span; spans are grouped by anchor. Equal spans repeat as a
whole; of different spans with one anchor, the windows are compared. Work and traffic follow the
number of spans (one in about 170 bytes or 22 words), not pairs.

Where a window's least hash stands at several places, the place of the window before is kept while
it lies inside, else the last one is taken. So a text of one repeated character has a span for every
170 bytes as well, and a span that holds such a tie is compared even if no other shares its anchor.

The README says why this stands in place of the column-wise construction of a collection BWT.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, text_or_empty
from .simhash import _runs


class Scale(NamedTuple):
    """Symbols of a window and of the pieces that anchor it."""

    length: int
    piece: int


BYTES, WORDS = Scale(400, 64), Scale(51, 8)
#: Texts below this many bytes hold neither kind of window.
SHORTEST = min(BYTES.length, 2 * WORDS.length - 1)
#: Symbols hashed at once; positions inside a block fit in 20 bits.
BLOCK = 1 << 18
#: Anchors with more different spans than this have their windows dealt by window instead of meeting in one task.
HOT = 512
_POS = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
KIND = ["words", "anchor", "len", "h1", "h2"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64, and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Hasher:
    """Polynomial hashes of every piece of a block, from one running sum."""

    def __init__(self, size: int = BLOCK + BYTES.length):
        self.up, self.down = _powers(size + 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def pieces(self, sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice, shift: np.ndarray | slice) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[shift])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` neighbours, by running minima inside blocks from both sides."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.uint64(_MASK))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def spans_of(data: np.ndarray, ends: np.ndarray, hasher: Hasher, scale: Scale = BYTES):
    """Spans of the windows of several texts laid end to end (at most BLOCK + a window's symbols).

    Returns (first window, last window, anchor hash, tie), places in ``data``. No window crosses one
    of ``ends``; a span has no more windows than a window has pieces. ``tie``: the anchor's hash
    stands at more than one place of the span, so windows of the span may be equal to each other.
    """
    width = scale.length - scale.piece + 1
    if len(data) < scale.length:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), np.empty(0, bool)
    sums, n = hasher.sums(data), len(data)
    piece = hasher.pieces(sums, slice(0, n - scale.piece + 1), slice(scale.piece, n + 1), slice(0, n - scale.piece + 1))
    # The place stands in the low bits and counts down, so the last of equal hashes is the least.
    packed = (piece & ~_POS) | (_POS - np.arange(len(piece), dtype=np.uint64))
    least = sliding_least(packed, width)
    value, last_place = least & ~_POS, (_POS - (least & _POS)).astype(np.int64)
    windows = np.arange(len(least))
    owner = np.searchsorted(ends, windows, side="right")
    whole = windows + scale.length <= ends[owner]
    run = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1])])
    starts = np.flatnonzero(run)
    stops = np.append(starts[1:], len(least))
    starts, stops = starts[whole[starts]], stops[whole[starts]]
    moves = last_place[starts] != last_place[stops - 1]  # runs whose last place changes: the hash stands there again
    cuts, ties = [starts[~moves]], [np.zeros(int((~moves).sum()), bool)]
    for s, e in zip(starts[moves].tolist(), stops[moves].tolist(), strict=True):
        at = s
        while at < e:
            cuts.append(np.array([at]))
            ties.append(np.ones(1, bool))
            at = int(last_place[at]) + 1
    first, tie = np.concatenate(cuts), np.concatenate(ties)
    order = np.argsort(first)
    first, tie = first[order], tie[order]
    end_of_run = stops[np.searchsorted(starts, first, side="right") - 1]
    last = np.minimum(np.append(first[1:], len(least)), end_of_run) - 1
    return first, last, value[first], tie


def word_hashes(raw: bytes) -> np.ndarray:
    """XXH64 of each word ``[^\\x20\\x09-\\x0D]+``."""
    return np.fromiter(map(xxhash.xxh64_intdigest, raw.split()), np.uint64)


def _blocks(rows: list[np.ndarray], length: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Texts in blocks of (row, offset, symbols); longer ones are cut so that every window lies in one part."""
    held, size = [], 0
    for i, raw in enumerate(rows):
        if len(raw) < length:
            continue
        for at in range(0, max(1, len(raw) - length + 1), BLOCK):
            part = raw[at : at + BLOCK + length - 1]
            if held and size + len(part) > BLOCK:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


_SPAN = "words boolean, anchor long, len int, h1 long, h2 long, tie boolean, id long, th long, lo long"


def spans(df: DataFrame) -> DataFrame:
    """(id, th, raw) → the byte spans and word spans of every text, each with the XXH3-128 of its symbols."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in it:
            raws = b.column(2).to_pylist()
            for scale, rows in ((BYTES, (np.frombuffer(x, np.uint8) for x in raws)), (WORDS, (word_hashes(x) for x in raws))):
                for part in _blocks(rows, scale.length):
                    data = np.concatenate([x for _, _, x in part])
                    ends = np.cumsum([len(x) for _, _, x in part])
                    first, last, anchor, tie = spans_of(data, ends, hasher, scale)
                    if not len(first):
                        continue
                    which = np.searchsorted(ends, first, side="right")
                    row, offset = np.array([r for r, _, _ in part])[which], np.array([o for _, o, _ in part])[which]
                    lo, length = first - np.concatenate([[0], ends])[which] + offset, last - first + scale.length
                    view, size = memoryview(data.tobytes()), data.itemsize
                    marks = b"".join(xxhash.xxh3_128_digest(view[s * size : e * size]) for s, e in zip(first.tolist(), (first + length).tolist(), strict=True))
                    h = np.frombuffer(marks, np.int64).reshape(-1, 2)
                    words = pa.array(np.full(len(first), scale is WORDS))
                    yield pa.RecordBatch.from_arrays(
                        [words, pa.array(anchor.view(np.int64)), pa.array(length.astype(np.int32)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(tie), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(lo)],
                        ["words", "anchor", "len", "h1", "h2", "tie", "id", "th", "lo"],
                    )

    return df.mapInArrow(batches, _SPAN)


def examples(df: DataFrame, flush: int = 100_000) -> DataFrame:
    """(raw, want) → rows of each wanted span: its bytes, or (words and hot anchors) the XXH3-128 of each of its windows.

    ``piece`` is null in rows of windows, ``inside`` their number in the span.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KIND, "low", "high", "inside", "v1", "v2", "piece"]
        kinds, inside, piece, marks = [], [], [], []

        def made():
            h = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            cols = [pa.array(c, t) for c, t in zip(zip(*kinds, strict=True), (pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            out = pa.RecordBatch.from_arrays([*cols, pa.array(inside, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(piece, pa.binary())], names)
            for x in (kinds, inside, piece, marks):
                x.clear()
            return out

        for b in it:
            for raw, want in zip(b.column(0), b.column(1), strict=True):
                raw, symbols = raw.as_py(), None
                for x in want.as_py():
                    kind, lo, size = (*(x[k] for k in KIND), x["low"], x["high"]), x["lo"], 1
                    if not x["words"] and not x["hot"]:
                        kinds.append(kind)
                        inside.append(-1)
                        piece.append(raw[lo : lo + x["len"]])
                        marks.append(bytes(16))
                        continue
                    data, length = raw, BYTES.length
                    if x["words"]:
                        symbols = word_hashes(raw).tobytes() if symbols is None else symbols
                        data, size, length = symbols, 8, WORDS.length
                    n = x["len"] - length + 1
                    marks += [xxhash.xxh3_128_digest(data[s * size : (s + length) * size]) for s in range(lo, lo + n)]
                    kinds += [kind] * n
                    inside += range(n)
                    piece += [None] * n
                    if len(kinds) >= flush:
                        yield made()
            if kinds:
                yield made()

    return df.mapInArrow(batches, "words boolean, anchor long, len int, h1 long, h2 long, low long, high long, inside int, v1 long, v2 long, piece binary")


def equal_windows(value: np.ndarray, start: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Which windows (hash ``value``, at ``start`` of ``data``) have an equal one; bytes decide, hashes only propose."""
    order = np.argsort(value, kind="stable")
    same = np.flatnonzero(value[order][1:] == value[order][:-1])
    a, b = order[same], order[same + 1]
    hit = np.zeros(len(value), bool)
    hit[a] = hit[b] = True
    if not len(same):
        return hit
    # Neighbouring windows with neighbouring partners are compared as one stretch.
    by = np.argsort(start[a])
    x, y = start[a][by], start[b][by]
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 1) | (np.diff(y) != 1)]))
    for s, e in zip(heads, [*heads[1:], len(x)], strict=True):
        n = e - s + length - 1
        if not np.array_equal(data[x[s] : x[s] + n], data[y[s] : y[s] + n]):  # a hash stood for two strings: count the strings
            for v in np.unique(value[a[by[s:e]]]):
                members = np.flatnonzero(value == v)
                texts = [data[p : p + length].tobytes() for p in start[members]]
                met = Counter(texts)
                hit[members] = [met[t] > 1 for t in texts]
    return hit


def _compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, len, h1, h2, piece) sorted by anchor → (anchor, len, h1, h2, w0, w1): the windows of each span that stand elsewhere too."""
    hasher = Hasher()
    for anchor, (length, h1, h2, piece) in _runs(it):
        length = length.astype(np.int64)
        ends = np.cumsum(length)
        data = np.frombuffer(b"".join(piece), np.uint8)
        n = length - BYTES.length + 1  # windows of each span
        upto = np.cumsum(n)
        owner = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(upto - n, n)
        start = (ends - length)[owner] + inside
        value = np.empty(len(start), np.uint64)
        for a in range(0, len(n), 256):  # sums stay inside the hasher's range
            z = min(a + 256, len(n))
            low, high = ends[a] - length[a], ends[z - 1]
            sums = hasher.sums(data[low:high])
            mine = slice(int((upto - n)[a]), int(upto[z - 1]))
            at = start[mine] - low
            value[mine] = hasher.pieces(sums, at, at + BYTES.length, at)
        # One key's windows only meet each other: their hashes carry the anchor.
        hit = equal_windows(mix(value ^ mix(anchor[owner].view(np.uint64))), start, data, BYTES.length)
        # A run of hits is cut where one span ends and the next begins.
        firsts = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (owner[1:] != owner[:-1])]))
        lasts = np.flatnonzero(hit & np.concatenate([~hit[1:] | (owner[1:] != owner[:-1]), [True]]))
        if len(firsts):
            o = owner[firsts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[o]), pa.array(length[o].astype(np.int32)), pa.array(h1[o]), pa.array(h2[o]), pa.array(inside[firsts].astype(np.int32)), pa.array(inside[lasts].astype(np.int32))],
                ["anchor", "len", "h1", "h2", "w0", "w1"],
            )


def repeated_intervals(df: DataFrame, hot: int = HOT) -> DataFrame:
    """(id, th, raw) → (id, th, cuts): for each text with repeated windows, their intervals (words, start, end).

    Byte intervals count repeats anywhere; word intervals only those in another row (id and text).
    """
    rows = materialize(spans(df), "spans")
    # Anchors met once can't hold a repeated window, unless a span repeats itself: most spans leave here. The anchors are
    # written apart: the join's stage then holds no aggregate, and a hot anchor's rows can be split.
    met = materialize(rows.groupBy("words", "anchor").agg(F.count("*").alias("met"), F.bool_or("tie").alias("t")).where("met > 1 OR t").select("words", "anchor"), "met-anchors")
    rows = materialize(rows.join(met.hint("merge"), ["words", "anchor"], "left_semi"), "met-spans")
    row = F.xxhash64("id", "th")
    kinds = rows.groupBy(*KIND).agg(F.count("*").alias("n"), F.bool_or("tie").alias("tie"), F.min(row).alias("low"), F.max(row).alias("high"), F.min(F.struct("id", "th", "lo")).alias("at"))
    kinds = materialize(kinds, "span-kinds")
    last = F.col("len") - F.when(F.col("words"), WORDS.length).otherwise(BYTES.length)
    whole = kinds.where(F.when(F.col("words"), F.col("low") != F.col("high")).otherwise(F.col("n") > 1)).select(*KIND, F.lit(0).alias("w0"), last.alias("w1"))
    several = kinds.groupBy("words", "anchor").agg(F.count("*").alias("k"), F.bool_or("tie").alias("t")).where("k > 1 OR t").select("words", "anchor", (F.col("k") > hot).alias("hot"))
    compared = kinds.join(materialize(several, "several-kinds").hint("merge"), ["words", "anchor"]).select(*KIND, "hot", "low", "high", "at.*")
    # One example of each kind is cut from its text.
    wanted = compared.groupBy("id", "th").agg(F.collect_list(F.struct(*KIND, "hot", "low", "high", "lo")).alias("want"))
    texts = df.join(wanted, [df.id.eqNullSafe(wanted.id), df.th == wanted.th]).select("raw", "want")
    cut = materialize(examples(texts), "span-examples")
    pieces = cut.where("piece IS NOT NULL").select("anchor", "len", "h1", "h2", "piece").repartition("anchor").sortWithinPartitions("anchor")
    partly = pieces.mapInArrow(_compared, "anchor long, len int, h1 long, h2 long, w0 int, w1 int").select(F.lit(False).alias("words"), "*")
    windows = cut.where("piece IS NULL").drop("piece")
    found = windows.groupBy("words", "v1", "v2").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = materialize(found.where(F.when(F.col("words"), F.col("low") != F.col("high")).otherwise(F.col("n") > 1)).select("words", "v1", "v2"), "met-windows")
    hits = windows.join(found.hint("merge"), ["words", "v1", "v2"], "left_semi").groupBy(*KIND).agg(F.sort_array(F.collect_set("inside")).alias("x"))
    edges = hits.select(*KIND, F.explode(F.expr("arrays_zip(filter(x, (w, i) -> i = 0 OR get(x, i - 1) <> w - 1), filter(x, (w, i) -> i = size(x) - 1 OR get(x, i + 1) <> w + 1))")).alias("e"))
    apart = edges.select(*KIND, F.col("e.0").alias("w0"), F.col("e.1").alias("w1"))
    marks = materialize(whole.unionByName(partly.unionByName(apart).join(whole, KIND, "left_anti")), "span-marks")
    size = F.when(F.col("words"), WORDS.length).otherwise(BYTES.length)
    hits = rows.join(marks.hint("merge"), KIND).select("id", "th", F.struct("words", (F.col("lo") + F.col("w0")).alias("s"), (F.col("lo") + F.col("w1") + size).alias("e")).alias("cut"))
    return hits.groupBy("id", "th").agg(F.sort_array(F.collect_set("cut")).alias("cuts"))


def merged(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in cuts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, kept, n_bytes, n_removed, n_spans, n_passage_words): every text as UTF-8 bytes without those that repeated 400-byte strings cover.

    ``n_passage_words`` counts the words inside passages of over 50 words that another document holds
    too, whatever their bytes; they are not removed unless they reach 400 bytes.
    Null and empty texts have no bytes. Rows are told apart by id and text: a row that repeats
    both has its whole text (from 400 bytes on) removed in all of them, like any copy, but counts
    as one document for passages. Null ids are rows like any other; an empty table gives none.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    rows = rows.select("id", F.xxhash64("t").alias("th"), F.col("t").cast("binary").alias("raw"))
    cuts = materialize(repeated_intervals(rows.where(F.octet_length("raw") >= SHORTEST), hot), "cuts")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            kept, counts = [], []
            raws = b.column(1).to_pylist()
            for raw, found in zip(raws, b.column(2).to_pylist(), strict=True):
                runs = merged([(c["s"], c["e"]) for c in found or [] if not c["words"]])
                words = merged([(c["s"], c["e"]) for c in found or [] if c["words"]])
                at, parts = 0, []
                for s, e in runs:
                    parts.append(raw[at:s])
                    at = e
                kept.append(b"".join([*parts, raw[at:]]))
                counts.append((len(raw), sum(e - s for s, e in runs), len(runs), sum(e - s for s, e in words)))
            made = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), *(pa.array(made[:, k].copy()) for k in range(4))], ["id", "kept", "n_bytes", "n_removed", "n_spans", "n_passage_words"])

    found = cuts.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "cuts")
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("id", "raw", "cuts")
    return joined.mapInArrow(batches, "id long, kept binary, n_bytes long, n_removed long, n_spans long, n_passage_words long")


def op9_repeated_passages(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage_words of every document."""
    made = remove_repeats(documents(spark, sf_dir))
    return made.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")
