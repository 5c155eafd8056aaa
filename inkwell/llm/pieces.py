"""SentencePiece encoding and decoding through a table of distinct marked words.

The model's text is its input with every space turned into the marker U+2581 and one marker put
before it. No piece of the vocabulary has a marker after another character, so merges never cross
the start of a run of markers, and the text falls into chunks that are segmented independently of
each other. Each task keeps the distinct chunks it has met with the ids the library gives them,
segments a chunk only when it is new, and joins the ids back by position. The table is per task:
looked up in memory, it costs no shuffle of (word, position) rows, which are several times the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, in_parts, text_or_empty

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Distinct chunks held by a task before the table is started anew; bounds its memory.
TABLE_ROWS = 400_000
#: Longer chunks are segmented but not kept.
KEPT_CHARS = 64


def check_model(model: sentencepiece.SentencePieceProcessor) -> None:
    """Raise unless chunks of this model can be segmented apart."""
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {i} crosses a marker; chunks can't be segmented apart")
    probe = " a  b \n c"
    if model.decode(model.encode(probe)) != probe:
        raise ValueError("the model normalises its input; chunks can't be cut before normalisation")


class ChunkTable:
    """Distinct marked words of a task with their ids and decoded bytes."""

    def __init__(self, model_path: str, rows: int = TABLE_ROWS):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        check_model(self.model)
        self.rows, self.known = rows, {}
        n = self.model.get_piece_size()
        self.byte_of = {i: int(self.model.id_to_piece(i)[3:5], 16) for i in range(n) if self.model.is_byte(i)}
        self.silent = {i for i in range(n) if self.model.is_control(i)}
        self.piece = [self.model.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]

    def _segment(self, chunk: str) -> tuple[bytes, bytes]:
        """The ids as little-endian 32-bit integers, and what they decode to with the marker as a space."""
        # The library sets the first marker itself, but none for an empty text: a lone marker (a space at the end) is its own piece.
        ids = [self.model.piece_to_id(MARK)] if chunk == MARK else self.model.encode(chunk[1:].replace(MARK, " "), num_threads=1)
        out = bytearray()
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i not in self.silent:
                out += self.piece[i]
        return b"".join(i.to_bytes(4, "little") for i in ids), bytes(out)

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids (without begin and end) and the decoded text, each as bytes."""
        if not text:
            return b"", b""
        marked = MARK + text.replace(" ", MARK)
        known, ids, decoded = self.known, [], []
        for chunk in _CHUNK.findall(marked):
            got = known.get(chunk)
            if got is None:
                got = self._segment(chunk)
                if len(chunk) <= KEPT_CHARS:
                    if len(known) >= self.rows:
                        known.clear()
                    known[chunk] = got
            ids.append(got[0])
            decoded.append(got[1])
        whole = b"".join(decoded)
        return b"".join(ids), whole[1:] if whole.startswith(b" ") else whole


def encode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Each whole text's ids, with begin and end ids, and the text they decode to.

    Returns (id, n_tokens, ids, decoded, ids_sha256, decoded_sha256); ``ids`` is array<int>. With
    ``keep_ids=False`` ids and decoded are left out. A null text counts as empty and has the begin
    and end ids alone; ids may repeat or be null, every row has a row in the result.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in in_parts(it):
            if table is None:
                table = ChunkTable(model_path)
                first, last = (i.to_bytes(4, "little") for i in (table.model.bos_id(), table.model.eos_id()))
            raws, texts = [], []
            for t in b.column(1):
                ids, decoded = table.encode(t.as_py())
                raws.append(first + ids + last)
                texts.append(decoded)
            cols = {
                "id": b.column(0),
                "n_tokens": pa.array([len(r) // 4 for r in raws], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in raws]),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in texts]),
            }
            if keep_ids:
                offsets = [0]
                for r in raws:
                    offsets.append(offsets[-1] + len(r) // 4)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(raws))])
                cols["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                cols["decoded"] = pa.array([d.decode("utf-8", "replace") for d in texts])
            yield pa.RecordBatch.from_pydict(cols)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(batches, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    made = encode_documents(documents(spark, sf_dir), default_model(), keep_ids=False)
    return made.withColumnRenamed("id", "doc_id")
