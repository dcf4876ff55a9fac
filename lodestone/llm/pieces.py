"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the models served here holds a word marker after another
character, so no merge crosses from a word into the marker that follows.  A
text therefore falls apart into marked words (a run of markers and what follows
up to the next marker) that can be segmented each by itself.  A task segments
every distinct marked word once, keeps its ids in a table of bounded size and
joins ids back by position.  Decoding is the library's.
``check_model`` refuses a model for which this doesn't hold.

Cases: null and empty texts have no pieces, only the end id if one is asked
for; texts without white space are one chunk; an empty table gives an empty
result; repeated rows and all other columns stay as they are, and the new
columns take names that are free.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh, sliced, table, tokenizer_path

MARK = "▁"
#: Entries that a task's table holds before it starts anew, and the length up to which a chunk is kept.
TABLE_ROWS = 300_000
KEPT_CHARS = 64
MODEL = "piece_bpe_32k.model"

_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_loaded: dict[str, object] = {}


def processor(path: str):
    """The model at ``path``, read once in a Python worker."""
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(sp)
        _loaded[path] = sp
    return _loaded[path]


def check_model(sp) -> None:
    """Fails if a piece goes on after a word into the next marker, or spaces are not kept as they are."""
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
        raise ValueError("pieces of this model cross word markers")
    if sp.encode("a  b ", out_type=str)[0][:1] != MARK or sp.decode(sp.encode("a  b ")) != "a  b ":
        raise ValueError("this model changes white space")


def chunks_of(text: str) -> list[str]:
    """The marked words of a text, each without its first marker."""
    marked = text.replace(" ", MARK)
    if MARK + MARK not in marked and marked[:1] != MARK and marked[-1:] != MARK:
        return marked.split(MARK)
    return [c[1:] for c in _CHUNK.findall(MARK + marked)]


class Encoder:
    """Ids of texts, as bytes of little-endian int32."""

    def __init__(self, path: str) -> None:
        self.sp, self.known = processor(path), {}
        self.bare = np.array([self.sp.piece_to_id(MARK)], "<i4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > TABLE_ROWS:
            self.known = {}
        cut = [chunks_of(t) if t else [] for t in texts]
        new = list({c for cs in cut for c in cs if c not in self.known})
        long = {}
        for chunk, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True):
            (self.known if len(chunk) <= KEPT_CHARS else long)[chunk] = np.array(ids, "<i4").tobytes() if chunk else self.bare
        known = self.known
        if long:
            return [b"".join([known[c] if c in known else long[c] for c in cs]) for cs in cut]
        return [b"".join([known[c] for c in cs]) for cs in cut]


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _lists(column: pa.ListArray) -> list[list[int]]:
    """The lists of ids in a column, cut from one flat list of numbers; null lists are empty, null ids left out."""
    flat = column.flatten()
    if flat.null_count:
        return [[i for i in ids or [] if i is not None] for ids in column.to_pylist()]
    ids = flat.to_numpy().tolist()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encode_texts(df: DataFrame, text: str = "text", model: str | None = None, end: bool = False, out: str = "ids") -> DataFrame:
    """``df`` with ``out``: the ids of ``text`` as array<int>, closed by the end id if ``end``."""
    at = df.columns.index(text)
    (out,) = fresh(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model or tokenizer_path(MODEL))
        tail = np.array([encoder.sp.eos_id()], "<i4").tobytes() if end else b""
        for batch in sliced(batches, at):
            raw = [x + tail for x in encoder(_texts(batch.column(at)))]
            offsets = np.zeros(len(raw) + 1, "<i4")
            np.cumsum([len(x) // 4 for x in raw], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(raw))])
            ids = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out])

    return df.mapInArrow(run, _with(df, out, T.ArrayType(T.IntegerType())))


def decode_ids(df: DataFrame, ids: str = "ids", model: str | None = None, out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the text that the library makes of the ids in ``ids``; null counts as no ids, null ids are left out."""
    at = df.columns.index(ids)
    (out,) = fresh(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model or tokenizer_path(MODEL))
        for batch in sliced(batches, at):
            texts = sp.decode(_lists(batch.column(at)), num_threads=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, _with(df, out, T.StringType()))


def op1_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with an end id, and decoded again."""
    coded = decode_ids(encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), end=True).drop("text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
