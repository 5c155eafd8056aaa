"""SimHash near-duplicate classes with pigeonring candidate filtering.

A fingerprint is cut into consecutive segments that form a ring. If two fingerprints differ in at
most t of their bits, some segment starts a chain whose cumulative differences stay within the
proportional budgets l * t / m for every chain length l (m segments). The budgets of the first
segments are below one, so the chain's head must be equal: it is the blocking key. The rest of the
chain is checked next, and only what passes it gets the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, in_parts, materialize, text_or_empty
from .components import components

SEED = 42
#: Segments of a 64-bit ring, eight bits each.
RING = 8
#: Heads of chains for a distance of 3 over 8 segments. The budgets are 0, 0, 1, 1, 1, 2, 2, 3: two
#: equal segments, then at most one difference in three, so two of these three are equal as well.
EXACT_HEADS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4))
#: Bits by which linked fingerprints differ at most; the heads are made for it.
LIMIT = 3
#: Keys that route a text, each over so many minima of its shingle hashes. Two texts of Jaccard similarity j share
#: none with the probability (1 - j ** ROWS) ** BANDS, wherever they differ: 0.00005 at 0.8.
BANDS, ROWS = 25, 5
#: 64-bit lanes of the sketch that is compared.
LANES = 8
#: Estimates this far above the asked similarity are tried first. Each link is checked exactly.
SLACK = 0.06
#: Pairs are candidates up to this many standard deviations of a sketch's error beyond the asked similarity's distance.
DEVIATIONS = 4
#: From this many fingerprints under one key, the group is cut once more before it is compared.
DENSE = 4096
#: Keys with more rows than this are split: their rows are dealt to blocks of half as many, and every two blocks meet in a task of their own.
HOT = 8192


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words; fewer words: of the whole sequence; none: nothing."""
    h, join = xxhash.xxh64_intdigest, b" ".join
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([h(join(words), SEED)], np.uint64)
    if width == 1:
        return np.fromiter((h(w, SEED) for w in words), np.uint64, len(words))
    runs = zip(*(words[i:] for i in range(width)), strict=False)
    return np.fromiter((h(join(r), SEED) for r in runs), np.uint64, len(words) - width + 1)


def majority_bits(hashes: np.ndarray, block: int = 1 << 15) -> int:
    """The 64 bits that are set in over half of the hashes; 0 for no hashes."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, block):
        part = hashes[i : i + block]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """A further 64-bit hash of each hash (a multiply-xorshift finaliser, one constant for each k)."""
    x = hashes ^ np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each whole text as a signed long. Null texts count as empty."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = [majority_bits(shingle_hashes(words_of(t.as_py()), width)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_signed(fps))], ["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(batches, "id long, fp long")


_MULTIPLIERS = (remixed(np.arange(BANDS * ROWS, dtype=np.uint64), 77) | np.uint64(1))[:, None]


def band_keys(hashes: np.ndarray, block: int = 1 << 12) -> np.ndarray:
    """BANDS keys of a set of hashes, each of ROWS minima under hash functions of its own; one key for no hashes."""
    if not len(hashes):
        return np.zeros(1, np.int64)
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(hashes), block):
        least = np.minimum(least, (hashes[None, i : i + block] * _MULTIPLIERS).min(1))
    rows = np.ascontiguousarray(least.reshape(BANDS, ROWS))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def sketches(df: DataFrame, width: int = 5, lanes: int = LANES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, c, n, keys, s0..): a hash and the size of the set of ``width``-word shingles, routing keys and a SimHash sketch of it.

    Equal sets have equal hashes ``c``; a sketch has 64 * ``lanes`` bits.
    """
    names = ["id", "c", "n", "keys", *(f"s{k}" for k in range(lanes))]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(it):
            sums, sizes, keys, rows = [], [], [], [[] for _ in range(lanes)]
            for t in b.column(1):
                runs = np.unique(shingle_hashes(words_of(t.as_py()), width))
                sums.append(xxhash.xxh3_64_intdigest(runs.tobytes()))
                sizes.append(len(runs))
                keys.append(band_keys(runs))
                for k in range(lanes):
                    rows[k].append(majority_bits(remixed(runs, k)))
            made = [pa.array(_signed(sums)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *(pa.array(_signed(r)) for r in rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names)

    schema = "id long, c long, n long, keys array<long>, " + ", ".join(f"{n} long" for n in names[4:])
    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(batches, schema)


def head_keys(ring: str, heads: tuple[tuple[int, ...], ...], tag: int = 0):
    """All chain heads of a 64-bit ring as an array of (key, start).

    A key holds the equal segments (eight bits each, four at most) below, and which ring, start and
    head they belong to above; ``start`` is the chain's first segment.
    """
    segment = [F.shiftrightunsigned(F.col(ring), 8 * i).bitwiseAND(F.lit(255)) for i in range(RING)]
    keys = []
    for start in range(RING):
        for which, head in enumerate(heads):
            key = F.lit((tag * RING + start) * len(heads) + which).cast("long")
            for offset in head:
                key = F.shiftleft(key, 8).bitwiseOR(segment[(start + offset) % RING])
            keys.append(F.struct(key.alias("key"), F.lit(start).alias("start")))
    return F.array(*keys)


def split_hot(keyed: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, id, ...) with the keys of more than ``hot`` rows replaced by keys of pairs of blocks.

    The rows of such a key go to blocks by a hash of their id, and a row to every pair that its block
    is part of, so any two of them still meet, in a task that holds about ``hot`` rows.
    """
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > hot), "hot-keys")
    if sizes.isEmpty():
        return keyed
    sizes = sizes.select(F.col("key").alias("_key"), F.ceil(2 * F.col("_n") / hot).cast("int").alias("_blocks"))
    joined = keyed.join(sizes, F.col("key") == F.col("_key"), "left")
    block = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    others = joined.withColumn("_block", block).withColumn("_other", F.explode_outer(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pair = F.xxhash64("key", F.least("_block", "_other"), F.greatest("_block", "_other"))
    return others.withColumn("key", F.coalesce(F.when(F.col("_key").isNotNull(), pair), F.col("key"))).drop("_key", "_blocks", "_block", "_other")


def _chain_ok(diff: np.ndarray, start: np.ndarray, budget: int) -> np.ndarray:
    """Whether the ring's chain from ``start`` stays within its proportional budgets at each length."""
    turned = (diff >> start) | (diff << ((np.uint64(64) - start) & np.uint64(63)))
    ok = np.ones(len(diff), bool)
    for length in range(3, RING + 1):
        mask = np.uint64((1 << (8 * length)) - 1) if length < RING else np.uint64(0xFFFFFFFFFFFFFFFF)
        ok &= np.bitwise_count(turned & mask) <= length * budget // RING
    return ok


def _forest(sketch: np.ndarray, limit: int, start: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span each connected class of rows at most ``limit`` bits apart.

    With ``start``, pairs pass the chain from there first; only what it leaves gets the full check.
    Each row is removed from the pool when it is reached, so a dense group costs little, and at
    most n - 1 links leave, never all pairs.
    """
    left = np.arange(len(sketch))
    parents, found = [], []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            diff = sketch[left] ^ sketch[at]
            if start is None:
                near = np.bitwise_count(diff).sum(1) <= limit
            else:
                near = _chain_ok(diff[:, 0], np.uint64(8 * start), limit)
                near[near] = np.bitwise_count(diff[near, 0]) <= limit
            if near.any():
                hit = left[near]
                parents.append(np.full(len(hit), at))
                found.append(hit)
                frontier.extend(hit.tolist())
                left = left[~near]
    if not parents:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(parents), np.concatenate(found)


def _links_of_group(ids: np.ndarray, sketch: np.ndarray, limit: int, start: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links inside one key's group. A large group of one-lane fingerprints is cut by a further pigeonhole step.

    The bits that vary in the group are cut into ``limit`` + 1 pieces: fingerprints at most ``limit`` bits
    apart agree in one of them at least, so every link lies inside a part of equal pieces.
    """
    if len(ids) > DENSE and sketch.shape[1] == 1:
        fp = sketch[:, 0]
        varying = np.flatnonzero(np.unpackbits(np.array([np.bitwise_or.reduce(fp ^ fp[0])], np.uint64).view(np.uint8), bitorder="little"))
        if len(varying) > limit:  # else a piece is empty, and its part the whole group
            out = []
            for bits in np.array_split(varying, limit + 1):
                value = fp & np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))
                order = np.argsort(value, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
                    if len(part) > 1:
                        out += _links_of_group(ids[part], sketch[part], limit, start)
            return out
    p, f = _forest(sketch, limit, start)
    return [(ids[p], ids[f])] if len(p) else []


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Batches of a partition sorted by its first column, cut so that equal keys never straddle a cut."""
    held: list[np.ndarray] | None = None
    for b in it:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            yield held[0][:cut], [c[:cut] for c in held[1:]]
            held = [c[cut:] for c in held]
    if held is not None:
        yield held[0], held[1:]


def group_links(keyed: DataFrame, lanes: list[str], limit: int, chain: bool, hot: int = HOT) -> DataFrame:
    """(key, id, lanes...) → (u, v): spanning links of every key's group of fingerprints within ``limit`` bits.

    Pairs are compared inside tasks over sorted partitions; groups of two take the vectorised path,
    and the groups of hot keys are split. ``chain``: a column ``start`` names each key's chain over
    the single lane, and the chain is checked before the full distance.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (ids, begins, *cols) in _runs(it):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            sketch = np.stack([c.view(np.uint64) for c in cols], axis=1)
            us, vs = [], []
            two = starts[sizes == 2]
            if len(two):
                diff = sketch[two] ^ sketch[two + 1]
                if chain:
                    ok = _chain_ok(diff[:, 0], begins[two].astype(np.uint64) * np.uint64(8), limit)
                    two, diff = two[ok], diff[ok]
                ok = np.bitwise_count(diff).sum(1) <= limit
                us.append(ids[two[ok]])
                vs.append(ids[two[ok] + 1])
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                for u, v in _links_of_group(ids[s : s + n], sketch[s : s + n], limit, int(begins[s]) if chain else None):
                    us.append(u)
                    vs.append(v)
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    rows = split_hot(keyed.select("key", "id", "start" if chain else F.lit(0).alias("start"), *lanes), hot)
    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(batches, "u long, v long")


def chain_links(nodes: DataFrame, fp: str, hot: int = HOT) -> DataFrame:
    """(id, fp) → (u, v): links that span the classes of distinct fingerprints LIMIT or fewer bits apart, sought by the ring's chains."""
    keyed = nodes.select(F.explode(head_keys(fp, EXACT_HEADS)).alias("k"), "id", fp).select("k.*", "id", fp)
    return group_links(keyed, [fp], LIMIT, chain=True, hot=hot)


def hamming_components(df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, fp, component): classes of fingerprints that 3 or fewer differing bits link, at any remove.

    Equal fingerprints are collapsed before candidates are sought, so copies never meet as pairs.
    Null texts count as empty (fingerprint zero, linked like any other); rows with a null id are
    given the component of their fingerprint; repeated ids keep their rows; an empty table gives none.
    """
    fps = materialize(fingerprints(df, width, id_col, text_col), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("node")), "classes")
    found = components(chain_links(classes.where("node IS NOT NULL").select(F.col("node").alias("id"), "fp"), "fp", hot))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return fps.join(materialize(named, "named"), "fp", "left").select("id", "fp", "component")


def hamming_limit(similarity: float, bits: int) -> int:
    """The largest number of differing sketch bits whose estimated Jaccard similarity reaches ``similarity``.

    Sets of that similarity j have a cosine of about 2 j / (1 + j); the expected share of differing
    bits is the angle divided by pi.
    """
    return int(np.arccos(2 * similarity / (1 + similarity)) / np.pi * bits)


def group_open(keyed: DataFrame, lanes: list[str], limit: int, similarity: float, block: int = 256, hot: int = HOT) -> DataFrame:
    """(key, id, label, n, lanes...) → (key, id): the rows of each key's group that stand within ``limit`` bits of one of another label.

    Sets whose sizes ``n`` are too far apart for the similarity stand apart. At most one row leaves for each that
    comes: rows, never pairs. Rows of the group's largest label are compared with the others only, so a group that is one
    class but for a few rows costs little.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (names, ids, labels, sizes_of, *cols) in _runs(it):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            sketch = np.stack([c.view(np.uint64) for c in cols], axis=1)
            open_ = np.zeros(len(key), bool)
            for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                label, sk, size = labels[s : s + n], sketch[s : s + n], sizes_of[s : s + n]
                values, counts = np.unique(label, return_counts=True)
                few = np.flatnonzero(label != values[counts.argmax()])
                for i in range(0, len(few), block):
                    part = few[i : i + block]
                    apart = sum(np.bitwise_count(sk[part, k][:, None] ^ sk[None, :, k]).astype(np.int32) for k in range(sk.shape[1]))
                    fits = np.minimum(size[part][:, None], size[None, :]) >= similarity * np.maximum(size[part][:, None], size[None, :])
                    met = (apart <= limit) & (label[part][:, None] != label[None, :]) & fits
                    open_[s + part[met.any(1)]] = True
                    open_[s : s + n] |= met.any(0)
            if open_.any():
                yield pa.RecordBatch.from_arrays([pa.array(names[open_]), pa.array(ids[open_])], ["key", "id"])

    rows = split_hot(keyed.select("key", F.col("key").alias("name"), "id", "label", "n", *lanes), hot)
    dealt = rows.select("key", "name", "id", "label", "n", *lanes).repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(batches, "key long, id long").distinct()


def _linked(name: int, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], limit: int, similarity: float) -> list[tuple[int, int]]:
    """Spanning links between a group's classes: pairs of different classes are compared by their sets, nearest sketches first.

    Classes that a link joins are one from then on, so no pair inside a class is compared, and there are fewer links than rows. A pair that shares an
    earlier routing key is left to that key's group.
    """
    root = {int(x): int(x) for x in labels}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in range(len(ids) - 1):
        mine = find(int(labels[i]))
        apart = np.bitwise_count(sketch[i + 1 :] ^ sketch[i]).sum(1)
        fits = np.minimum(sizes[i + 1 :], sizes[i]) >= similarity * np.maximum(sizes[i + 1 :], sizes[i])
        near = np.flatnonzero((apart <= limit) & fits) + i + 1
        if not len(near):
            continue
        near = near[keys[i, (keys[near] == keys[i]).argmax(1)] == np.uint64(name & 0xFFFFFFFFFFFFFFFF)]
        for j in near[np.argsort(apart[near - i - 1], kind="stable")].tolist():
            other = find(int(labels[j]))
            if other == mine:
                continue
            a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            shared = int(np.count_nonzero(b[at] == a))
            if shared >= similarity * (len(a) + len(b) - shared):
                root[other] = mine
                links.append((int(max(ids[i], ids[j])), int(min(ids[i], ids[j]))))
    return links


def group_linked(opened: DataFrame, lanes: list[str], limit: int, similarity: float, hot: int) -> DataFrame:
    """(key, id, label, n, keys, hashes, lanes...) → (u, v): links with an exact Jaccard similarity of ``similarity`` or more that span the classes of each key's group.

    The sets come to the group once a row, and what leaves is a link at most a row.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        current = None

        def links() -> Iterator[pa.RecordBatch]:
            if len(group) > 1:
                names, ids, labels, sizes, keys, sets, *cols = zip(*group)
                made = _linked(names[0], np.array(ids), np.array(labels), np.array(sizes), np.ascontiguousarray(np.array(cols, np.int64).T).view(np.uint64), np.stack(keys), list(sets), limit, similarity)
                if made:
                    u, v = zip(*made)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in in_parts(it, 200):
            cols = [c.to_pylist() for c in (*b.columns[:5], *b.columns[7:])]
            # sets are in the order of unsigned hashes
            lists = [[x.values.to_numpy().view(np.uint64) for x in b.column(k)] for k in (5, 6)]
            for k, (key, name, i, label, n, *lane) in enumerate(zip(*cols, strict=True)):
                if key != current:
                    yield from links()
                    group.clear()
                    current = key
                group.append((name, i, label, n, lists[0][k], lists[1][k], *lane))
        yield from links()

    rows = split_hot(opened.select("key", F.col("key").alias("name"), "id", "label", "n", "keys", "hashes", *lanes), hot)
    dealt = rows.select("key", "name", "id", "label", "n", "keys", "hashes", *lanes).repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(batches, "u long, v long").distinct()


def hash_sets(texts: DataFrame, width: int) -> DataFrame:
    """(c, hashes): the shingle hashes of each text (c, t) whose set hashes to ``c``, as an array."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(it, 200):
            rows = []
            for c, t in zip(*(x.to_pylist() for x in part.columns), strict=True):
                found = np.unique(shingle_hashes(words_of(t), width))
                if _signed([xxhash.xxh3_64_intdigest(found.tobytes())])[0] == c:
                    rows.append((c, found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["c", "hashes"])

    return texts.select("c", "t").mapInArrow(batches, "c long, hashes array<long>").dropDuplicates(["c"])


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) whose hash sets have an exact Jaccard similarity of ``similarity`` or more; sets are joined by pair, so pairs have to be few to a text."""
    first, second = (sets.select(F.col("c").alias(n), F.col("hashes").alias(f"h{n}")).hint("merge") for n in ("u", "v"))
    met = pairs.join(first, "u").join(second, "v")
    p, q = F.size("hu"), F.size("hv")
    shared = F.when(F.least(p, q) >= similarity * F.greatest(p, q), F.size(F.array_intersect("hu", "hv"))).otherwise(-1)
    return met.select("u", "v", shared.alias("shared"), (p + q).alias("both")).where((F.col("shared") >= 0) & (F.col("shared") >= similarity * (F.col("both") - F.col("shared")))).select("u", "v")


def near_duplicate_classes(
    df: DataFrame, width: int = 5, similarity: float = 0.8, lanes: int = LANES, id_col: str = "doc_id", text_col: str = "text", slack: float = SLACK, hot: int = HOT
) -> DataFrame:
    """(id, component): classes of texts that links of an exact Jaccard similarity of ``similarity`` or more join.

    Candidates are fingerprints within LIMIT bits, found by the ring's chains as in ``hamming_components``, and, as texts of that
    similarity differ in more bits than chains can seek, what shares a routing key and is near by its whole sketch; each link is confirmed on the
    sets of shingle hashes. Surely near texts are linked first by spanning links. Of what these leave in different classes, every
    candidate pair is checked where both sets are: rows with an open candidate bring their set to the routing key that the
    pair shares first, and only links that join two classes leave. Null and empty texts form one class of their
    own only with other texts without words. Rows with a null id are left out: no id tells them apart.
    ``hot`` bounds the rows of a routing key that meet in one task.
    """
    parts, bits = [f"s{k}" for k in range(lanes)], 64 * lanes
    at = hamming_limit(similarity, bits)
    wide = int(at + DEVIATIONS * np.sqrt(at * (1 - at / bits)))
    made = materialize(sketches(df, width, lanes, id_col, text_col).where("id IS NOT NULL"), "sketches")
    firsts = [F.first(x).alias(x) for x in ("n", "keys", *parts)]
    classes = materialize(made.groupBy("c").agg(F.min(F.struct("id")).alias("_node"), *firsts).select("c", F.col("_node.id").alias("node"), "n", "keys", *parts), "sketch-classes")
    keyed = classes.where("n > 0").select(F.explode("keys").alias("key"), F.col("c").alias("id"), *parts)
    # the first lane is a fingerprint of its own
    chained = materialize(chain_links(classes.where("n > 0").select(F.col("c").alias("id"), parts[0]), parts[0], hot).distinct(), "sketch-chained")
    near = materialize(group_links(keyed, parts, wide, chain=False, hot=hot).unionByName(chained).distinct(), "sketch-near")
    ends = near.select(F.explode(F.array("u", "v")).alias("c")).distinct()
    some = materialize(classes.join(ends.hint("merge"), "c", "left_semi"), "sketch-some")
    texts = df.select(F.col(id_col).cast("long").alias("node"), text_or_empty(text_col).alias("t"))
    sets = materialize(hash_sets(texts.join(some.select("c", "node").hint("merge"), "node"), width), "sketch-sets")
    again = some.select(F.explode("keys").alias("key"), F.col("c").alias("id"), *parts)
    sure = group_links(again, parts, hamming_limit(min(1.0, similarity + slack), bits), chain=False, hot=hot).unionByName(chained).distinct()
    sure = materialize(confirmed(sure, sets, similarity), "sketch-sure")
    labels = materialize(some.select("c").join(components(sure), F.col("c") == F.col("node"), "left").select("c", F.coalesce("component", "c").alias("label")), "sketch-labels")
    labelled = materialize(some.join(labels, "c").select("c", "label", "n", "keys", *parts), "sketch-labelled")
    met = group_open(labelled.select(F.explode("keys").alias("key"), F.col("c").alias("id"), "label", "n", *parts), parts, wide, similarity, hot=hot)
    whole = labelled.join(sets, "c").select(F.col("c").alias("id"), "label", "n", "keys", "hashes", *parts)
    more = materialize(group_linked(materialize(met, "sketch-open").join(whole, "id"), parts, wide, similarity, max(2, hot // 8)), "sketch-more")
    found = components(sure.unionByName(more)).select(F.col("node").alias("c"), F.col("component").alias("root"))
    rooted = materialize(classes.select("c", "node").join(found, "c", "left").withColumn("root", F.coalesce("root", "c")), "sketch-rooted")
    least = rooted.groupBy("root").agg(F.min("node").alias("component"))
    named = materialize(rooted.join(least.hint("merge"), "root").select("c", "component"), "sketch-named")
    return made.select("id", "c").join(named.hint("merge"), "c").select("id", "component")


def op3_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = hamming_components(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
