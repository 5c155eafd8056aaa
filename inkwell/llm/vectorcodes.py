"""Product codes of vectors by delta-maintained Lloyd rounds, in whole numbers.

Vectors are written once, bucketed by a row number; each round's assignments are a table bucketed in
the same way, so both meet without a shuffle. A round assigns all parts anew and compares them with
the persisted assignments: only parts that moved add a plus to the entry they moved to and a minus to
the one they left. A task sums these before they are shuffled, and they change running sums and
counts. Codebooks, sums and counts hold positions x entries x part length numbers, whatever the
number of vectors, and so may sit on the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_root

#: Bytes of whole-number vectors in a bucket, about; a bucket is a task's input.
BUCKET_BYTES = 96 << 20
#: Whole numbers are held within plus and minus this, so that a squared distance over 1024 components fits a long.
BOUND = 1 << 25


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 4096) -> DataFrame:
    """(vec_id, label, v): the rows whose vector is there and holds finite numbers only, each as ``floor(scale * x)`` within BOUND."""
    kept = df.where(F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    whole = F.transform(vector_col, lambda c: F.floor(F.greatest(F.lit(float(-BOUND)), F.least(F.lit(float(BOUND)), c.cast("double") * F.lit(float(scale))))).cast("long"))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), whole.alias("v"))


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index, and its squared distance."""
    far = np.empty((len(part), len(book)), np.int64)
    for k, entry in enumerate(book):
        away = part - entry
        far[:, k] = np.einsum("nd,nd->n", away, away)
    at = far.argmin(1)
    return at.astype(np.uint8), far[np.arange(len(at)), at]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows, shorter ones filled up with zeros."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    if (lengths == width).all():
        return flat[ends[0] : ends[-1]].reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        out[k, : b - a] = flat[a:b]
    return out


class Sums:
    """Running sums and counts of each position's entries."""

    def __init__(self, positions: int, entries: int, length: int):
        self.shape = (positions, entries, length + 1)
        self.total = [0] * (positions * entries * (length + 1))

    def add(self, delta: dict[int, int]) -> None:
        for at, x in delta.items():
            self.total[at] += int(x)

    def entries(self, before: np.ndarray) -> np.ndarray:
        """Each entry as the floor of its parts' mean; those without parts as before."""
        positions, entries, width = self.shape
        after = before.copy()
        for p in range(positions):
            for k in range(entries):
                *sums, count = self.total[(p * entries + k) * width : (p * entries + k + 1) * width]
                if count:
                    after[p, k] = [s // count for s in sums]
        return after


def _assign(books: np.ndarray, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round over (row, v, codes): the new codes, and on a task's last row what its moved parts add to sums and counts."""
    positions, entries, length = books.shape

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        delta, held = np.zeros((positions, entries, length + 1), np.int64), None
        for b in it:
            if not b.num_rows:
                continue
            if held is not None:
                yield _coded(*held, None)
            v = _matrix(b.column(1), positions * length)
            codes = np.empty((len(v), positions), np.uint8)
            before = None if first else np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(v), positions)
            for p in range(positions):
                part = v[:, p * length : (p + 1) * length]
                codes[:, p], _ = nearest(part, books[p])
                moved = slice(None) if first else np.flatnonzero(codes[:, p] != before[:, p])
                counted = np.hstack([part[moved], np.ones((len(part[moved]), 1), np.int64)])
                np.add.at(delta[p], codes[moved, p], counted)
                if not first:
                    np.subtract.at(delta[p], before[moved, p], counted)
            held = b.column(0), codes
        if held is not None:
            yield _coded(*held, delta)

    return batches


def _coded(rows: pa.Array, codes: np.ndarray, delta: np.ndarray | None) -> pa.RecordBatch:
    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
    last = [None] * (len(codes) - 1) + [None if delta is None else delta.reshape(-1)]
    return pa.RecordBatch.from_arrays([rows, packed, pa.array(last, pa.list_(pa.int64()))], names=["row", "codes", "delta"])


def _last(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The final codes in hexadecimal digits and the squared distances summed over a vector's parts, over (v, vec_id, label)."""
    positions, _, length = books.shape

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = _matrix(b.column(0), positions * length)
            codes, error = np.empty((len(v), positions), np.uint8), np.zeros(len(v), np.int64)
            for p in range(positions):
                codes[:, p], far = nearest(v[:, p * length : (p + 1) * length], books[p])
                error += far
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return batches


class Bucketed:
    """Tables in the shared folder, bucketed alike by ``row``; ``drop`` forgets their names, their files stay."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        name = f"inkwell_{label}_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, "row").option("path", f"{shared_root(self.spark)}/{name}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positions: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every kept vector, the codebooks as an array [position, entry, component]).

    Vectors are cut into ``positions`` equal parts. Codebooks start with the parts of the vectors of the
    smallest ids (null ids last, equal ids by vector); fewer vectors give fewer entries. A width that
    the positions don't divide, and vectors shorter than the longest, are filled up with zeros. Ids may
    be null or repeat: every kept row has a row in the result. Without kept rows there are none, and no entries.
    """
    spark = df.sparkSession
    whole = whole_vectors(df, id_col, vector_col, label_col)
    rows, width = whole.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    length = -(-width // positions)
    seeds = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.zeros((positions, len(seeds), length), np.int64)
    for k, (v,) in enumerate(seeds):
        books[:, k] = np.array([*v, *[0] * (positions * length - len(v))], np.int64).reshape(positions, length)
    label_type = whole.schema["label"].dataType.simpleString()
    if not rows:
        return spark.createDataFrame([], f"vec_id long, label {label_type}, code string, error long"), books
    buckets = max(1, -(-rows * width * 8 // BUCKET_BYTES), min(spark.sparkContext.defaultParallelism, -(-rows // 4096)))
    tables = Bucketed(spark, buckets)
    vectors = tables.write(whole.withColumn("row", F.monotonically_increasing_id()).repartition(buckets, "row"), "vectors")
    sums, codes = Sums(positions, len(seeds), length), None
    for _ in range(rounds):
        if codes is None:
            read = vectors.select("row", "v")
        else:
            read = vectors.select("row", "v").join(codes.select("row", "codes").hint("shuffle_hash"), "row")
        codes = tables.write(read.mapInArrow(_assign(books, codes is None), "row long, codes binary, delta array<long>"), "codes")
        # one array a task, of a length that no table changes
        changes = codes.where("delta IS NOT NULL").select(F.posexplode("delta").alias("at", "x")).where("x <> 0").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        if not changes:
            break
        sums.add({r.at: r.x for r in changes})
        books = sums.entries(books)
    made = materialize(vectors.select("v", "vec_id", "label").mapInArrow(_last(books), f"vec_id long, label {label_type}, code string, error long"), "vectorcodes")
    tables.drop()
    return made, books


def codebooks_sha256(books: np.ndarray) -> str:
    """Of all components in decimal, by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row of embeddings."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    made, books = vector_codes(df)
    totals = materialize(made.groupBy("label").agg(F.sum("error").alias("label_error")), "labelerrors")
    joined = made.alias("m").join(totals.alias("t"), F.col("m.label").eqNullSafe(F.col("t.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
