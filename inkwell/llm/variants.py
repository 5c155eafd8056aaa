"""Spelling variants: words within one edit of each other, found by automata over halves of words.

One edit leaves the first or the second half of a word as it is, at its place counted from the start
or the end. Every word therefore puts its two segments into shards; a shard is an Aho-Corasick
automaton over the segments dealt to it. A word can only hold a segment at a compatible offset and
length if its own prefix or suffix of one of two lengths is that segment, so it is scanned by the
shards of these four strings and by no other. A segment that a large part of a shard's words share is
dealt over several shards, and the words that hold it are scanned by each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize

#: Segments of a shard, about; bounds an automaton's memory.
SHARD_SEGMENTS = 16_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def typed_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the distinct words of whole texts and how often each occurs, misspelled by a fixed rule.

    A run of letters of A-Z, a-z and U+00C0 to U+00FF is lower-cased in A-Z. Where 97 divides the
    crc32 of ``<id>:<run>``, the code point at that number modulo the run's length is deleted. A null
    id stands as an empty string, a null text has no words.
    """
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text_col, F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("r"))
    low = runs.select(F.translate("r", _UPPER, _LOWER).alias("r"), "d").select("r", F.crc32(F.concat("d", F.lit(":"), "r")).alias("h"))
    at = (F.col("h") % F.length("r")).cast("int")
    word = F.when(F.col("h") % 97 == 0, F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))).otherwise(F.col("r"))
    return low.select(word.alias("word")).where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _segments(word, length):
    """A word's two segments with their kind: 0 at the start, 1 at the end."""
    half = F.floor(length / 2).cast("int")
    return F.array(F.struct(F.lit(0).alias("kind"), F.substring(word, F.lit(1), half).alias("segment")), F.struct(F.lit(1).alias("kind"), F.substring(word, half + 1, length).alias("segment")))


def _held(word, length):
    """The strings of a word that can be a segment of a word whose length differs by one at most."""
    found = []
    for m in (length - 1, length, length + 1):
        half = F.floor(m / 2).cast("int")
        rest = m - half
        found += [F.struct(F.lit(0).alias("kind"), F.substring(word, F.lit(1), half).alias("segment")), F.struct(F.lit(1).alias("kind"), F.substring(word, length - rest + 1, rest).alias("segment"))]
    return F.array_distinct(F.array(*found))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns one into the other."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:]


class Shard:
    """An automaton over segments with the words that own them."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        self.n: dict[str, int] = {}
        # (kind, segment, length of the owner, 0 or 1, that half of what is left of it): its owners. The edit is in one
        # of the two halves of what is left, so an owner is found by the other.
        self.owners: dict[tuple, list[str]] = {}

    def add(self, word: str, n: int, kind: int) -> None:
        half = len(word) // 2
        segment, rest = (word[:half], word[half:]) if kind == 0 else (word[half:], word[:half])
        self.automaton.add_word(segment, segment)
        self.n[word] = n
        cut = len(rest) // 2
        for side, part in enumerate((rest[:cut], rest[cut:])):
            self.owners.setdefault((kind, segment, len(word), side, part), []).append(word)

    def close(self) -> None:
        self.automaton.make_automaton()

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The owners within one edit of ``word``, each once."""
        if not len(self.automaton):
            return
        size = len(word)
        for end, segment in self.automaton.iter(word):
            start = end - len(segment) + 1
            if start == 0:
                yield from self._verified(word, size, 0, segment, word[len(segment) :])
            if end == size - 1:
                yield from self._verified(word, size, 1, segment, word[:start])

    def _verified(self, word: str, size: int, kind: int, segment: str, rest: str) -> Iterator[tuple[str, int]]:
        for m in (size - 1, size, size + 1):
            left = m - len(segment)
            # lengths are compatible where the segment is this half of a word of m code points
            if left < 0 or len(segment) != (m // 2 if kind == 0 else m - m // 2):
                continue
            cut = left // 2
            first = rest[:cut]
            found = self.owners.get((kind, segment, m, 0, first), ())
            if len(rest) >= left - cut:
                begins = m // 2 if kind == 0 else 0
                # owners with the same first half of the rest are found above
                found = [*found, *(o for o in self.owners.get((kind, segment, m, 1, rest[len(rest) - (left - cut) :]), ()) if o[begins : begins + cut] != first)]
            for other in found:
                # a word that holds both segments is told by the first
                if one_edit(word, other) and not (kind == 1 and word.startswith(other[: m // 2])):
                    yield other, self.n[other]


def near_words(words: DataFrame, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """(word, n_near, best) of every word with a near word: how many differ from it by one edit, and the most frequent as struct(less, form): minus its n, itself.

    ``words`` holds distinct (word, n). Nothing is emitted per pair: a shard sends one row a scanned word.
    """
    shards = max(1, -(-2 * words.count() // shard_segments))
    length = F.length("word")
    owned = words.select("word", "n", F.explode(_segments(F.col("word"), length)).alias("s")).select("word", "n", "s.*")
    held = words.select("word", "n", F.explode(_held(F.col("word"), length)).alias("s")).select("word", "n", "s.*")
    # Segments of so many words that they would fill a shard: at most 8 * words / shard_segments of them.
    share = max(1, shard_segments // 4)
    hot = materialize(owned.groupBy("kind", "segment").count().where(F.col("count") > share).select("kind", "segment", F.ceil(F.col("count") / share).cast("int").alias("salts")), "hotsegments")
    salts = F.coalesce("salts", F.lit(1))
    shard = F.pmod(F.xxhash64("kind", "segment", "salt"), F.lit(shards)).cast("int").alias("shard")
    owners = owned.join(hot, ["kind", "segment"], "left").withColumn("salt", F.pmod(F.xxhash64("word"), salts).cast("int"))
    scanned = held.join(hot, ["kind", "segment"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    # a word meets a shard once, by however many strings it comes there
    routed = owners.select(shard, F.lit(0).alias("role"), "word", "n", "kind").unionByName(scanned.select(shard, F.lit(1).alias("role"), "word", F.lit(0).cast("long").alias("n"), F.lit(-1).alias("kind")).distinct())
    placed = routed.repartition(shards, "shard").sortWithinPartitions("shard", "role")
    found = placed.select("shard", "role", "word", "n", "kind").mapInArrow(_scan, "word string, near long, less long, form string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come shard by shard, a shard's owners before the words it scans."""
    shard, current, phase = Shard(), None, 0
    for b in it:
        out: list[tuple] = []
        for number, role, word, n, kind in zip(*(c.to_pylist() for c in b.columns)):
            if number != current:
                shard, current, phase = Shard(), number, 0
            if role and not phase:
                shard.close()
                phase = 1
            if role == 0:
                shard.add(word, n, kind)
                continue
            near, best = 0, None
            for other, m in shard.near(word):
                near += 1
                if best is None or (-m, other) < best:
                    best = (-m, other)
            if near:
                out.append((word, near, *best))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["word", "near", "less", "form"])


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): from each word along ``form`` to the last. A form is at least twice as frequent, so chains have no circle and few steps."""
    roots = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("_w"), F.col("root").alias("_r")).where("_w <> _r")
        made = materialize(roots.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        if made.where("moved").isEmpty():
            return made.select("word", "root")
        roots = made.select("word", "root")


def variant_groups(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct (word, n).

    ``form`` is the near word of largest n (ties: smallest in code-point order) where that is at least
    twice the word's own; ``root`` is the last word reached by following forms. An empty table gives none.
    """
    near = near_words(words)
    known = F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best"))
    made = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), known.getField("form").alias("form"), (-known.getField("less")).alias("form_n"))
    forms = materialize(made, "forms")
    return forms.join(followed(forms), "word")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of five code points and three occurrences in documents."""
    words = materialize(typed_words(documents(spark, sf_dir)), "words")
    return variant_groups(words).select("word", "form", "root", "n", "n_near", "form_n")
