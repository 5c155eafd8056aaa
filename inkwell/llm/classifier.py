"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters slide
over each chunk and are max-pooled; the chunk vectors are pooled over the document (largest, mean and
smallest of each filter) and a logistic layer makes one probability of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, text_or_empty

CHUNK, STEP = 256, 192
WIDTH, STRIDE = 8, 2
EMBED, FILTERS = 8, 24
#: The fit reads at most this many labelled rows, the first by a hash of their id.
FIT_ROWS = 1500
#: Chunks of one fitted row, at most, spread evenly over the whole text. A parameter of the fit; scores read whole texts.
FIT_CHUNKS = 12
#: Chunks that pass through the network at once when scoring; bounds a task's memory.
SCORE_CHUNKS = 256
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 3 * FILTERS
    out_bias: float


def chunks_of(data: bytes) -> np.ndarray:
    """Overlapping chunks that cover the data, the last one moved back to end with it; short data are padded with zeros."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= CHUNK:
        return np.concatenate([raw, np.zeros(CHUNK - len(raw), np.uint8)])[None]
    starts = np.append(np.arange(0, len(raw) - CHUNK, STEP), len(raw) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[starts]


def _windows(embedded: np.ndarray) -> np.ndarray:
    """(n, CHUNK, EMBED) → (n * POSITIONS, WIDTH * EMBED), one row per place of the filters."""
    flat = embedded.reshape(len(embedded), CHUNK * EMBED)
    view = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
    return view.reshape(-1, WIDTH * EMBED)


def chunk_vectors(net: Network, chunks: np.ndarray) -> np.ndarray:
    """Max-pooled filter responses of each chunk."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    for i in range(0, len(chunks), SCORE_CHUNKS):
        part = net.embed[chunks[i : i + SCORE_CHUNKS]]
        made = (_windows(part) @ net.conv).reshape(len(part), POSITIONS, FILTERS)
        out[i : i + SCORE_CHUNKS] = np.maximum(made.max(1) + net.bias, 0)
    return out


def _logit(net: Network, vectors: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.append(starts, len(vectors)))
    pooled = np.hstack([np.maximum.reduceat(vectors, starts), np.add.reduceat(vectors, starts) / sizes[:, None], np.minimum.reduceat(vectors, starts)])
    return pooled @ net.out + net.out_bias


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, seed: int = 7) -> Network:
    """Adam on the logistic loss; gradients pass through the places that won each pool."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(f32),
        "conv": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(f32),
        "bias": np.zeros(FILTERS, f32),
        "out": rng.normal(0, 0.1, 3 * FILTERS).astype(f32),
        "out_bias": np.zeros(1, f32),
    }
    if not len(texts):
        return Network(p["embed"], p["conv"], p["bias"], np.zeros(3 * FILTERS, f32), 0.0)
    all_chunks = []
    for t in texts:
        c = chunks_of(t)
        all_chunks.append(c if len(c) <= FIT_CHUNKS else c[np.linspace(0, len(c) - 1, FIT_CHUNKS).astype(int)])
    positive = max(labels.mean(), 1e-3)
    p["out_bias"][0] = np.log(positive / max(1 - positive, 1e-3))
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            chunks = np.concatenate([all_chunks[r] for r in rows])
            starts = np.cumsum([0, *(len(all_chunks[r]) for r in rows[:-1])])
            owner = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(chunks))))
            wins = _windows(p["embed"][chunks])
            resp = (wins @ p["conv"]).reshape(len(chunks), POSITIONS, FILTERS)
            best = resp.argmax(1)
            pre = np.take_along_axis(resp, best[:, None], 1)[:, 0] + p["bias"]
            vec = np.maximum(pre, 0)
            sizes = np.diff(np.append(starts, len(vec)))[:, None]
            top, low = np.maximum.reduceat(vec, starts), np.minimum.reduceat(vec, starts)
            pooled = np.hstack([top, np.add.reduceat(vec, starts) / sizes, low])
            prob = 1 / (1 + np.exp(-(pooled @ p["out"] + p["out_bias"][0])))
            err = ((prob - labels[rows]) / len(rows)).astype(f32)
            g = {"out": pooled.T @ err + 1e-4 * p["out"], "out_bias": np.array([err.sum()], f32)}
            back = err[:, None] * p["out"][None]
            d_vec = (back[:, FILTERS : 2 * FILTERS] / sizes)[owner]
            for part, pool in ((back[:, :FILTERS], top), (back[:, 2 * FILTERS :], low)):
                won = vec == pool[owner]
                d_vec = d_vec + part[owner] * won / np.maximum(np.add.reduceat(won.astype(f32), starts), 1)[owner]
            d_vec = (d_vec * (pre > 0)).astype(f32)
            g["bias"] = d_vec.sum(0)
            at = np.arange(len(chunks))[:, None] * POSITIONS + best  # the place that won, for each chunk and filter
            picked = wins[at.ravel()].reshape(len(chunks), FILTERS, WIDTH * EMBED)
            g["conv"] = np.einsum("cf,cfk->kf", d_vec, picked)
            d_win = d_vec[:, :, None] * p["conv"].T[None]
            spot = best[:, :, None] * STRIDE + np.arange(WIDTH)
            byte = np.take_along_axis(chunks, spot.reshape(len(chunks), -1), 1).ravel()
            d_embed = np.zeros_like(p["embed"])
            np.add.at(d_embed, byte, d_win.reshape(-1, EMBED))
            g["embed"] = d_embed
            step += 1
            rate = 0.01 * min(1.0, 2 * (1 - epoch / epochs))
            for k, x in p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                x -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(f32)
    return Network(p["embed"], p["conv"], p["bias"], p["out"], float(p["out_bias"][0]))


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of each whole text; long texts are pooled over blocks of chunks."""
    out, held, starts, n = [], [], [], 0

    def flush():
        if starts:
            z = _logit(net, chunk_vectors(net, np.concatenate(held)), np.array(starts))
            out.extend((1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist())

    for t in texts:
        c = chunks_of(t)
        held.append(c)
        starts.append(n)
        n += len(c)
        if n >= 8 * SCORE_CHUNKS:
            flush()
            held, starts, n = [], [], 0
    flush()
    return np.array(out)


def train(df: DataFrame, label_col: str, id_col: str, text_col: str, rows: int = FIT_ROWS) -> Network:
    """Fit on at most ``rows`` labelled rows of ``df``, the first by a hash of their id."""
    sample = df.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t"), F.col(label_col).cast("double").alias("y"))
    got = sample.orderBy(F.xxhash64("i"), "i").limit(rows).collect()
    return fit([r.t.encode("utf-8", "surrogatepass") for r in got], np.array([r.y for r in got], np.float32))


def score_documents(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text. Null and empty texts are one chunk of padding and have a score like any other."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            scores = score_texts(net, [t.as_py().encode("utf-8", "surrogatepass") for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(batches, "id long, score double")


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = documents(spark, sf_dir)
    out_of_fit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where("doc_id IS NOT NULL").where(~out_of_fit)
    # The sample is drawn from the labels first, so that only its texts are read by the driver.
    chosen = labels.where("quality IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    net = train(docs.join(F.broadcast(chosen), "doc_id"), "quality", "doc_id", "text")
    made = score_documents(docs, net).withColumnRenamed("id", "doc_id")
    return made.select("doc_id", out_of_fit.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
